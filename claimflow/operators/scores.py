"""Integrity scores of claims and of the baselines they are compared with."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import kernels as K
from . import frames, graph
from .joins import chained

# How the four scores are weighed, and the location scores.
FUSION = {"s_topo": 0.40, "s_curr": 0.30, "s_signal": 0.20, "s_time": 0.10}
LOCATION = {"s_lte": 0.2, "s_meg": 0.3, "s_signal": 0.5}
MOVEMENT = {"rssi_std": 0.24, "rssi_range": 0.18, "mean_abs_d1": 0.24, "p90_abs_d1": 0.14, "mean_abs_d2": 0.12, "mean_abs_md1": 0.05, "count_std": 0.03}


def weighted(weights: dict[str, float], without: str | None = None) -> Column:
    """The weighted sum of score columns; a score left out gives its weight to the others."""
    kept = {k: w for k, w in weights.items() if k != without}
    total = sum(kept.values())
    terms = [F.col(k) * F.lit(w / total) for k, w in kept.items()]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def fused(samples: DataFrame, key: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Score tables joined to all samples (missing: 0, flagged) and their weighted total."""
    return chained(samples, key, tables).withColumn("s_total", weighted(FUSION))


def mean_by_key(scores: DataFrame, key: str, score: str) -> DataFrame:
    """Mean score and number of rows, null scores counted in the latter."""
    return scores.groupBy(key).agg(F.avg(score).alias(score), F.count("*").alias("row_count"))


def current_score(random: Column, tail: Column, jump: Column, reachable: Column) -> Column:
    """Of heading checks at random places and at the tail, and the topology jump; -1 where the jump can't be reached."""
    post = F.when(random.isNull(), tail).when(tail.isNull(), random).otherwise(0.2 * random + 0.8 * tail)
    return F.when(~reachable, F.lit(-1.0)).otherwise(0.8 * post + 0.2 * jump)


def heading_transition(boundary: Column, mean: Column, profile: Column) -> Column:
    """1 less the weighted turns at a seam, each over 180 degrees."""
    return C.unit(1 - (0.5 * boundary + 0.3 * mean + 0.2 * profile) / 180.0)


def seams(trace: DataFrame, window: int, tail: int, samples: int = 2) -> DataFrame:
    """(trace_id, seam, start): ``samples`` keyed places with a whole window on both sides, and the place ``tail`` rows before the end; short traces have none."""
    size = trace.groupBy("trace_id").agg(F.count("*").alias("n"))
    drawn = size.where(F.col("n") >= 2 * window).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    drawn = drawn.select("trace_id", F.concat(F.lit("random"), F.col("j").cast("string")).alias("seam"), (window + C.keyed(F.col("n") - 2 * window + 1, F.lit("seam"), "trace_id", "j")).alias("start"))
    last = size.where(F.col("n") >= tail + window).select("trace_id", F.lit("tail").alias("seam"), (F.col("n") - tail).alias("start"))
    return drawn.unionByName(last)


def seam_scores(trace: DataFrame, places: DataFrame, heading: str, window: int) -> DataFrame:
    """(trace_id, seam, start, transition): the headings of the ``window`` rows before a seam against those of the rows after it.

    Missing headings are filled both ways first. Only rows of a window are joined, by trace and row number.
    """
    trace = frames.filled(trace, heading, heading)
    asked = places.withColumn("offset", F.explode(F.sequence(F.lit(-window), F.lit(window - 1)))).withColumn("row_idx", F.col("start") + F.col("offset"))
    rows = asked.join(trace.select("trace_id", "row_idx", F.col(heading).alias("h")), ["trace_id", "row_idx"])
    keys = ["trace_id", "seam", "start"]
    pairs = rows.groupBy(*keys, F.pmod("offset", F.lit(window)).alias("at")).agg(F.max(F.when(F.col("offset") < 0, F.col("h"))).alias("before"), F.max(F.when(F.col("offset") >= 0, F.col("h"))).alias("current"))
    told = pairs.groupBy(*keys).agg(
        F.avg(C.circular_difference("before", "current")).alias("profile"),
        F.max(F.when(F.col("at") == window - 1, F.col("before"))).alias("last"),
        F.max(F.when(F.col("at") == 0, F.col("current"))).alias("first"),
        C.circular_mean("before").alias("mean_before"),
        C.circular_mean("current").alias("mean_current"),
    )
    score = heading_transition(C.circular_difference("last", "first"), C.circular_difference("mean_before", "mean_current"), F.col("profile"))
    return told.select(*keys, score.alias("transition"))


def topology(sequence: Column, whole: Column, reached: Column) -> Column:
    return F.when(reached, 0.5 * sequence + 0.5 * whole).otherwise(0.0)


def location_gate(df: DataFrame, claimed: str, allowed: str) -> DataFrame:
    """Claims whose regions meet those of the matched node get the weighted score, the others -1."""
    passes = F.arrays_overlap(claimed, allowed)
    return df.withColumn("topology_passed", F.coalesce(passes, F.lit(False))).withColumn("s_location", F.when(F.col("topology_passed"), F.round(weighted(LOCATION), 6)).otherwise(F.lit(-1.0)))


def rule_time(claimed: Column, actual: Column) -> Column:
    return F.exp(-(F.abs(claimed - actual) / F.greatest(actual, F.lit(1.0))) / 0.25)


def rule_speed(jumps: Column, seconds: Column, grid: float = 10.0, fastest: float = 2.0) -> Column:
    """Speed of a region walk against walking pace; without time or steps 0."""
    metres = F.aggregate(jumps, F.lit(0.0), lambda a, x: a + F.greatest(x, F.lit(1)).cast("double")) * grid
    speed = metres / seconds
    return F.when((seconds <= 0) | (F.size(jumps) == 0), F.lit(0.0)).when(speed <= fastest, F.lit(1.0)).otherwise(F.exp(-(speed - fastest) / fastest))


def rule_total(time: Column, speed: Column, continuity: Column, route: Column) -> Column:
    return 0.3 * time + 0.3 * speed + 0.2 * continuity + 0.2 * route


def spikes(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """By trace: median absolute deviation of the steps, the share of steps beyond six of it, and the share of missing values."""
    w = Window.partitionBy(*keys).orderBy("row_idx")
    steps = df.withColumn("__d", F.abs(F.col(value) - F.lag(value).over(w)))
    middle = steps.groupBy(*keys).agg(F.median("__d").alias("__m"))
    mad = steps.join(middle, list(keys)).groupBy(*keys).agg(F.median(F.abs(F.col("__d") - F.col("__m"))).alias("mad"), F.first("__m").alias("median_step"))
    near = steps.join(mad, list(keys))
    spike = (F.col("__d") > F.col("median_step") + 6 * F.greatest(F.col("mad"), F.lit(1e-6))).cast("int")
    return near.groupBy(*keys).agg(F.first("mad").alias("mad"), F.avg(spike).alias("spike_ratio"), F.avg(F.col(value).isNull().cast("int")).alias("missing_ratio"))


def continuity(spike: Column, missing: Column, activity: Column) -> Column:
    """1 less what is missing, too little activity, and spikes."""
    idle = F.when(activity < 0.01, F.lit(0.4)).when(activity < 0.05, F.lit(0.2)).otherwise(F.lit(0.0))
    return C.unit(1 - (missing + idle + F.least(F.lit(0.5), 5 * spike)))


def fingerprint(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """By trace and cell: the mean over channels of the channel's median strength."""
    by = cells.groupBy(*keys, "cell_id", "channel").agg(F.median("rssi").alias("m"))
    return by.groupBy(*keys, "cell_id").agg(F.avg("m").alias("rssi"))


def magnetic(trace: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """By trace the four statistics of the field (``meg``): mean, deviation, mean step and the spread between the tenths."""
    w = Window.partitionBy(*keys).orderBy("row_idx")
    steps = trace.withColumn("__step", F.abs(F.col(value) - F.lag(value).over(w)))
    tenths = F.percentile(value, [0.1, 0.9])
    return steps.groupBy(*keys).agg(F.array(F.avg(value), F.stddev_pop(value), F.coalesce(F.avg("__step"), F.lit(0.0)), tenths[1] - tenths[0]).alias("meg"))


def fingerprint_distances(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    """Distances of fingerprints (``ids`` with ``rssi``, and ``meg``): root mean square over the cells of either, an absent cell being the floor, and the field's part."""
    known = np.unique(np.concatenate([np.asarray(x, np.int64) for x in (*left["ids"], *right["ids"])]))

    def spread(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        strength, there = np.full((len(rows), len(known)), float(C.MISSING_RSSI)), np.zeros((len(rows), len(known)))
        for i, (ids, rssi) in enumerate(zip(rows["ids"], rows["rssi"], strict=True)):
            at = np.searchsorted(known, ids)
            strength[i, at], there[i, at] = rssi, 1.0
        return strength, there

    (a, in_a), (b, in_b) = spread(left), spread(right)
    either = in_a.sum(1)[:, None] + in_b.sum(1)[None] - in_a @ in_b.T
    signal = np.where(either > 0, K.straight(a, b) / np.sqrt(np.maximum(either, 1)) / 18.0, 2.0)
    x, y = (np.stack(rows["meg"].to_numpy()).astype(float) for rows in (left, right))
    return 0.85 * signal + 0.15 * K.straight(x, y) / np.sqrt(x.shape[1]) / 25.0


def length_scores(legs: DataFrame, edges: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """(key, s_length): the summed ``walked`` length of each claim's legs (src, dst) against the shortest way through ``edges``.

    A leg between nodes that are not connected is an error; without ``strict`` its claim scores 0.
    """
    ways = graph.path_lengths(edges, legs.select("src", "dst").distinct(), strict)
    both = legs.join(ways, ["src", "dst"]).groupBy(key).agg(F.sum("walked").alias("walked"), F.sum("length").alias("way"), (F.count("length") == F.count("*")).alias("whole"))
    return both.select(key, F.when(F.col("whole"), C.relative_score("walked", "way")).otherwise(0.0).alias("s_length"))


def per_second(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """By second: the strongest cell, the mean of the rows' means and of the rows' cell counts (a mean of means)."""
    by_row = df.groupBy(*keys, "second", "ms").agg(F.max("rssi").alias("top"), F.avg("rssi").alias("mean"), F.count("rssi").alias("n"))
    return by_row.groupBy(*keys, "second").agg(F.max("top").alias("strongest"), F.avg("mean").alias("mean_rssi"), F.avg("n").alias("mean_count"))


def movement(seconds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Movement features of the strongest signal by second; fewer than three seconds give none."""
    w = Window.partitionBy(*keys).orderBy("second")
    d = seconds.withColumn("d1", F.col("strongest") - F.lag("strongest").over(w)).withColumn("m1", F.col("mean_rssi") - F.lag("mean_rssi").over(w))
    d = d.withColumn("d2", F.col("d1") - F.lag("d1").over(w))
    out = d.groupBy(*keys).agg(
        F.count("*").alias("n_seconds"),
        F.stddev_pop("strongest").alias("rssi_std"),
        (F.max("strongest") - F.min("strongest")).alias("rssi_range"),
        F.avg(F.abs("d1")).alias("mean_abs_d1"),
        F.percentile(F.abs("d1"), 0.9).alias("p90_abs_d1"),
        F.avg(F.abs("d2")).alias("mean_abs_d2"),
        F.avg(F.abs("m1")).alias("mean_abs_md1"),
        F.stddev_pop("mean_count").alias("count_std"),
    )
    raw = None
    for name, weight in MOVEMENT.items():
        term = weight * F.log1p(F.greatest(F.col(name), F.lit(0.0)))
        raw = term if raw is None else raw + term
    return out.where("n_seconds >= 3").withColumn("raw_movement", raw)


def robust(values: Column, median: Column, q25: Column, q75: Column, deviation: Column) -> Column:
    """The sigmoid of a value against median and quartile range (else deviation, else 1)."""
    scale = F.when(q75 - q25 > 0, q75 - q25).when(deviation > 0, deviation).otherwise(1.0)
    return C.sigmoid((values - median) / scale)
