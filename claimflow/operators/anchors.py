"""Detection of environment states in merged traces: magnetic activity and cell changes in sliding windows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import kernels as K
from ..session import stored
from . import frames, intervals, series
from .frames import KEYS


@dataclass(frozen=True)
class Detection:
    """Fixed values of the detector: window and step in rows, distance of peaks, and the thresholds."""

    size: int = 400
    step: int = 10
    spacing: int = 50
    smooth: int = 5
    wobble_rows: int = 20
    activity_factor: float = 0.07
    peak_factor: float = 0.6
    valley_factor: float = 1.0
    least_wobble: float = 0.08
    rssi_deviation: float = 2.0
    id_rate: float = 0.02
    gap: int = 600


def activity(df: DataFrame, value: str, smooth: int = 5) -> DataFrame:
    """Adds ``z``, the standardised trailing mean of differences, and its magnitude ``az``."""
    d = frames.trailing_mean(frames.difference(df, value, "__d"), "__d", "__m", smooth)
    return frames.zscore(d, "__m", "z").withColumn("az", F.abs("z")).drop("__d", "__m")


def extremes(wobble: int):
    """A vectorised function of lists: the highest peak, the lowest valley (0 without one) and the mean trailing deviation."""

    @F.pandas_udf("top double, bottom double, wobble double")
    def of(lists: pd.Series) -> pd.DataFrame:
        out, sizes = np.zeros((len(lists), 3)), np.array([len(v) for v in lists], int)
        # Lists of one length are one table, some thousand at a time.
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            for i in range(0, len(at), 4_096):
                some = at[i : i + 4_096]
                x = np.array([lists.iloc[k] for k in some], float).reshape(len(some), size)
                out[some] = np.stack([K.highest_peaks(x), -K.highest_peaks(-x), K.mean_trailing_deviations(x, wobble)], 1)
        return pd.DataFrame(out, columns=["top", "bottom", "wobble"])

    return of


def peak_bounds(trace: DataFrame, value: str, how: Detection) -> DataFrame:
    """(trace_id, peak_bound, valley_bound): mean of a trace's peaks plus, of its valleys less, so many sample deviations; fewer than two give none."""

    def bound(sign: int, factor: float, name: str) -> DataFrame:
        at = series.find_peaks(trace.select(*frames.KEYS, "row_idx", (sign * F.col(value)).alias("__v")).where("__v is not null"), "__v", how.spacing)
        level = sign * F.avg("height") + sign * factor * F.stddev_samp("height")
        return at.groupBy(*frames.KEYS).agg(F.when(F.count("*") > 1, level).alias(name))

    return bound(1, how.peak_factor, "peak_bound").join(bound(-1, how.valley_factor, "valley_bound"), list(frames.KEYS), "full")


def flagged_windows(trace: DataFrame, value: str, rssi: list[str], ids: list[str], how: Detection = Detection(), both: bool = False) -> DataFrame:
    """Windows that show a change: magnetic (activity, peaks, valleys and wobble all beyond their bounds) or, with ``both`` and, cellular.

    A channel without any deviation to take leaves the cellular flag unset. A
    list holds one window; of a whole trace only its peaks' statistics are kept.
    """
    z = activity(trace, value, how.smooth)
    for c in (*rssi, *ids):
        z = frames.filled(z, c, c)
    for c in rssi:
        z = frames.trailing_mean(z, c, c, how.smooth)
    for c in ids:
        z = frames.changes(z, [c], f"__new_{c}")
    z = stored(z.select(*frames.KEYS, "row_idx", "z", "az", *rssi, *[f"__new_{c}" for c in ids]), "activity")
    bounds = z.groupBy(*frames.KEYS).agg((F.avg("az") + how.activity_factor * F.stddev_samp("az")).alias("activity_bound"))
    bounds = bounds.join(peak_bounds(z, "z", how), list(frames.KEYS), "left")
    parts: dict[str, Column] = {"mean_activity": F.avg("az"), "items": F.collect_list(F.struct(F.col("row_idx"), F.col("z")))}
    parts |= {f"__sd_{c}": F.stddev_samp(c) for c in rssi}
    parts |= {f"__n_{c}": F.sum(f"__new_{c}") for c in ids} | {f"__f_{c}": F.first(f"__new_{c}") for c in ids}
    w = frames.sliding_windows(z, how.size, how.step, parts, series.RANGE // how.step).join(bounds, list(frames.KEYS))
    w = w.withColumn("__x", extremes(how.wobble_rows)(F.filter(F.transform(F.array_sort("items"), lambda x: x["z"]), lambda v: v.isNotNull())))
    magnetic = (F.col("mean_activity") >= F.col("activity_bound")) & (F.col("__x.top") >= F.col("peak_bound")) & (F.col("__x.bottom") <= F.col("valley_bound")) & (F.col("__x.wobble") >= how.least_wobble)
    deviation, changed = F.lit(0.0), F.lit(0)
    for c in rssi:
        deviation = deviation + F.col(f"__sd_{c}") / len(rssi)
    for c in ids:
        changed = changed + F.col(f"__n_{c}") - F.col(f"__f_{c}")
    cellular = (deviation > how.rssi_deviation) | (changed / (max(len(ids), 1) * (how.size - 1)) > how.id_rate)
    magnetic, cellular = F.coalesce(magnetic, F.lit(False)), F.coalesce(cellular, F.lit(False))
    return w.where(magnetic & cellular if both else magnetic | cellular).select(*frames.KEYS, "start_row", "end_row")


def anchor_segments(trace: DataFrame, value: str, rssi: list[str], ids: list[str], how: Detection = Detection(), both: bool = False) -> DataFrame:
    """States of each trace: flagged windows merged, recentred on the strongest activity, near neighbours joined in pairs and recentred."""
    z = activity(trace, value, how.smooth)
    merged = intervals.merged(flagged_windows(trace, value, rssi, ids, how, both))
    first = intervals.recentred(merged, z, "az", how.size).drop("score")
    return intervals.recentred(intervals.paired_off(first, how.gap), z, "az", how.size)


def anchor_features(trace: DataFrame, segments: DataFrame, value: str, size: int = 400, around: int = 12, lead: int = 4, cells: list[str] = ()) -> DataFrame:
    """The values inside each segment, before and after it, and ``around`` cell rows from ``lead`` before its start; short lists are filled with nulls."""
    # A trace's rows lie in blocks of ``size`` and each segment asks for the few blocks that its parts touch, so no trace is gathered.
    s, e = F.col("start_row"), F.col("end_row")
    low = F.greatest(s - lead, F.lit(0))
    spans = {"cur": (s, F.least(e, s + size)), "pre": (s - size, s), "post": (e, e + size)} | ({"cells": (low, s - lead + around)} if cells else {})
    most = {"cur": size, "pre": size, "post": size, "cells": around}
    columns = [value, *cells]
    block = lambda row: F.floor(row / size).cast("bigint")
    blocks = trace.groupBy(*KEYS, block(F.col("row_idx")).alias("block")).agg(F.collect_list(F.struct("row_idx", *columns)).alias("__rows"))
    touched = [F.when(b > a, F.sequence(block(a), block(b - 1))).otherwise(F.array().cast("array<bigint>")) for a, b in spans.values()]
    asked = segments.select(*KEYS, "start_row", "end_row", F.explode(F.array_distinct(F.concat(*touched))).alias("block"))
    lists = asked.join(blocks, [*KEYS, "block"], "left").groupBy(*KEYS, "start_row", "end_row").agg(F.flatten(F.collect_list("__rows")).alias("__rows"))

    def placed(part: str) -> Column:
        """(place, columns) of a part in order, with nulls where the trace has no row."""
        a, b = spans[part]
        within = F.filter("__rows", lambda x: (x["row_idx"] >= a) & (x["row_idx"] < b))
        have = F.transform(within, lambda x: F.struct((x["row_idx"] - a).cast("int").alias("place"), *[x[c].alias(c) for c in columns]))
        blank = lambda i: F.struct(i.alias("place"), *[F.lit(None).cast(trace.schema[c].dataType).alias(c) for c in columns])
        return C.bound(have, lambda h: F.sort_array(F.concat(h, F.transform(F.array_except(F.sequence(F.lit(0), F.lit(most[part] - 1)), F.transform(h, lambda x: x["place"])), blank))))

    parts = lists.select(*KEYS, "start_row", "end_row", *[placed(p).alias(f"__{p}") for p in spans])
    of = lambda c: lambda x: x[c]
    out = [F.transform(f"__{p}", of(value)).alias(p) for p in ("cur", "pre", "post")]
    out += [F.transform("__cells", of(c)).alias(c) for c in cells]
    return parts.select(*KEYS, "start_row", "end_row", *out)
