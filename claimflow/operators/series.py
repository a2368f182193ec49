"""Operators on long series: a trace is cut into ranges of rows with a margin on both sides, so that one long trace is many tasks.

Rows carry trace_id and row_idx (0, 1, ... without gaps). What a range cannot
settle by itself (a plateau or a chain of near peaks over its end, a median) is
settled from a few rows of all ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..session import stored
from . import frames

KEYS = frames.KEYS
#: Rows of a range.
RANGE = 20_000


def ranges(df: DataFrame, columns: Sequence[str], size: int, margin: int) -> DataFrame:
    """Rows copied to their own range of ``size`` rows (``part``) and to those whose margin they lie in."""
    low = F.greatest(F.lit(0), F.floor((F.col("row_idx") - margin) / size))
    parts = F.sequence(low.cast("bigint"), F.floor((F.col("row_idx") + margin) / size).cast("bigint"))
    return df.select(*KEYS, "row_idx", *columns, F.explode(parts).alias("part"))


def by_range(df: DataFrame, columns: Sequence[str], size: int, margin: int, f: Callable[[pd.DataFrame, int, int], pd.DataFrame], schema: str) -> DataFrame:
    """``f`` of the rows of each range with its margins, in order, and the range's first row and end; ``f`` returns columns after trace_id."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("row_idx", kind="stable")
        start = int(t["part"].iloc[0]) * size
        out = f(t, start, start + size)
        out.insert(0, "trace_id", t["trace_id"].iloc[0])
        return out

    return ranges(df, columns, size, margin).groupBy(*KEYS, "part").applyInPandas(run, f"trace_id {dict(df.dtypes)['trace_id']}, {schema}")


# -- peaks ---------------------------------------------------------------------


def plateaus(df: DataFrame, value: str, size: int = RANGE) -> DataFrame:
    """(trace_id, row_idx, height): strict maxima, a plateau at its middle; its ends are found where values change, so it may be of any length."""
    w = frames.over()
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    rows = df.select(*KEYS, "row_idx", F.col(value).alias("height"), before.alias("l"), after.alias("r"))
    # Only rows beside a change can begin or end a maximum; the end of a run is the row after its last beginning.
    ends = rows.where("l is null or r is null or l <> height or r <> height").withColumn("begin", F.coalesce(F.col("l") != F.col("height"), F.lit(True)))
    up = F.last(F.when(F.col("begin"), F.struct("row_idx", (F.col("l") < F.col("height")).alias("rises"))), True).over(frames.rows(None, 0))
    tops = ends.withColumn("run", up).where(F.col("run.rises") & (F.col("r") < F.col("height")))
    return tops.select(*KEYS, F.floor((F.col("run.row_idx") + F.col("row_idx")) / 2).alias("row_idx"), "height")


def shoulders(df: DataFrame, value: str) -> DataFrame:
    """(trace_id, row_idx, height): rows that are no lower than both neighbours."""
    w = frames.over()
    return df.select(*KEYS, "row_idx", F.col(value).alias("height"), F.lag(value).over(w).alias("l"), F.lead(value).over(w).alias("r")).where("height >= l and height >= r").drop("l", "r")


def spaced(candidates: DataFrame, rank: Column, tie: Column, distance: int, size: int = RANGE) -> DataFrame:
    """Of ``candidates`` (trace_id, row_idx, ...) those that stay when the highest ``rank`` (then ``tie``) goes first and drops all nearer than ``distance``.

    In a round each range decides what it can: a candidate stays when every
    higher one within the distance has gone, and goes when one of them stays.
    Only what hangs on undecided candidates in a margin waits for the next
    round, so there are about as many rounds as ranges that one chain crosses.
    """
    names = candidates.columns
    # 0: undecided, 1: stays, 2: gone.
    now = stored(candidates.withColumn("__rank", rank.cast("double")).withColumn("__tie", tie.cast("double")).withColumn("__state", F.lit(0)), "candidates")
    size = max(size, 2 * distance)

    def decide(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values([*KEYS, "part", "row_idx"], kind="stable")
        at, part = t["row_idx"].to_numpy(), t["part"].to_numpy()
        own = (at >= part * size) & (at < (part + 1) * size)
        # Ranges lie so far apart that they don't meet.
        nth = t.groupby([*KEYS, "part"], sort=False).ngroup().to_numpy()
        apart = at - at.min() + nth * (at.max() - at.min() + 2 * distance)
        state = K.suppressed(apart, t["__rank"].to_numpy(), t["__tie"].to_numpy(), t["__state"].to_numpy(), own, distance)
        return pd.DataFrame({"trace_id": t["trace_id"].to_numpy()[own], "row_idx": at[own], "__state": state[own]})

    while True:
        # Many short ranges go to one call: about as many rows as a long one has.
        left = now.where("__state < 2")
        calls = max(1, -(-left.count() // size))
        told = ranges(left, ["__rank", "__tie", "__state"], size, distance - 1).withColumn("__call", F.pmod(F.xxhash64(*KEYS, "part"), F.lit(calls)))
        told = told.groupBy("__call").applyInPandas(decide, f"trace_id {dict(candidates.dtypes)['trace_id']}, row_idx long, __state int")
        now = stored(now.where("__state < 2").drop("__state").join(told, [*KEYS, "row_idx"]), "candidates")
        if now.where("__state = 0").isEmpty():
            return now.where("__state = 1").select(*names)


def find_peaks(df: DataFrame, value: str, distance: int, height: Column | None = None, size: int = RANGE) -> DataFrame:
    """(trace_id, row_idx, height): peaks of at least ``height``, the highest first and none nearer than ``distance`` to a higher one; of equal ones the later goes first."""
    tops = plateaus(df, value, size)
    if height is not None:
        least = df.groupBy(*KEYS).agg(height.alias("__least"))
        tops = tops.join(least, list(KEYS)).where("height >= __least").drop("__least")
    return spaced(tops, F.col("height"), F.col("row_idx"), distance, size)


def kept_peaks(df: DataFrame, value: str, distance: int, valleys: bool = False, size: int = RANGE) -> DataFrame:
    """(trace_id, row_idx, height): the detector's own rule, by magnitude and plateaus counting at every row; of equal ones the earlier goes first."""
    turned = df.withColumn("__v", -F.col(value) if valleys else F.col(value))
    return spaced(shoulders(turned, "__v"), F.abs("height"), -F.col("row_idx"), distance, size)


# -- medians and wavelets --------------------------------------------------------


def medians(df: DataFrame, keys: Sequence[str], value: str, few: int = 10_000, bins: int = 1024) -> DataFrame:
    """(keys, median): exact medians by counting.

    A group's values are counted in ``bins`` between its ends, the bin that
    holds the middle is cut into bins again, and once a bin holds ``few`` values
    or a single one these are listed. No task gets a group whole. Nulls do not count.
    """
    keys = list(keys)
    rows = stored(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v")), "values")
    ends = rows.groupBy(*keys).agg(F.count("*").alias("__size"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    # A span of values, how many lie in and below it, and the ranks of the two middle ones (from 0).
    span = [*keys, "__low", "__high", "__size", "__below", "__a", "__b"]
    spans = stored(ends.withColumn("__below", F.lit(0).cast("bigint")).withColumn("__a", F.expr("(__size - 1) div 2")).withColumn("__b", F.expr("__size div 2")).select(*span), "median-spans")
    narrow, found = [], []
    while True:
        done = (F.col("__size") <= few) | (F.col("__low") == F.col("__high"))
        narrow.append(spans.where(done))
        wide = spans.where(~done)
        if wide.isEmpty():
            break
        share = (F.col("__v") - F.col("__low")) / (F.col("__high") - F.col("__low"))
        inside = rows.join(wide.drop("__size"), keys).where((F.col("__v") >= F.col("__low")) & (F.col("__v") <= F.col("__high"))).withColumn("__bin", F.least(F.floor(share * bins), F.lit(bins - 1)))
        counts = inside.groupBy(*keys, "__bin", "__below", "__a", "__b").agg(F.count("*").alias("__size"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
        run = F.coalesce(F.sum("__size").over(Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        hit = counts.withColumn("__below", F.col("__below") + run).where((F.col("__below") <= F.col("__b")) & (F.col("__below") + F.col("__size") > F.col("__a")))
        # Where the middle ones fall into two bins, they are the last of one and the first of the other.
        parts = [F.min("__high").alias("__left"), F.max("__low").alias("__right"), F.count("*").alias("__bins"), *[F.min(c).alias(c) for c in ("__low", "__size", "__below")], F.max("__high").alias("__high")]
        told = stored(hit.groupBy(*keys, "__a", "__b").agg(*parts), "median-spans")
        found.append(told.where("__bins > 1").select(*keys, ((F.col("__left") + F.col("__right")) / 2).alias("median")))
        spans = told.where("__bins = 1").select(*span)
    narrow = reduce(DataFrame.unionByName, narrow)
    found.append(narrow.where("__low = __high").select(*keys, F.col("__low").alias("median")))
    listed = rows.join(narrow.where("__low < __high"), keys).where((F.col("__v") >= F.col("__low")) & (F.col("__v") <= F.col("__high")))
    lists = listed.groupBy(*keys, "__below", "__a", "__b").agg(F.array_sort(F.collect_list("__v")).alias("__x"))
    at = lambda i: F.element_at("__x", (F.col(i) - F.col("__below") + 1).cast("int"))
    found.append(lists.select(*keys, ((at("__a") + at("__b")) / 2).alias("median")))
    return reduce(DataFrame.unionByName, found)


def with_length(df: DataFrame) -> DataFrame:
    return df.join(df.groupBy(*KEYS).agg((F.max("row_idx") + 1).alias("__length")), list(KEYS))


def denoised(df: DataFrame, value: str, out: str, level: int = 3, factor: float = 0.5, size: int = RANGE) -> DataFrame:
    """(trace_id, row_idx, ``out``): :func:`kernels.denoised` of each trace, range by range.

    A range is transformed with a margin longer than the filters of all levels
    reach, cut at places where all levels keep their step; the threshold is the
    median of the finest band of the whole trace. Null counts as 0.
    """
    step = 2**level
    size, margin = -(-size // step) * step, 3 * len(K.DB6) * step
    rows = with_length(df.select(*KEYS, "row_idx", F.coalesce(F.col(value), F.lit(0.0)).alias("__v")))

    def finest(t: pd.DataFrame, start: int, end: int) -> pd.DataFrame:
        n = int(t["__length"].iloc[0])
        d = K.details(t["__v"].to_numpy()) if n > 1 else np.empty(0)
        # Ranges and margins are even, so coefficients of all ranges fall on the same places.
        at = int(t["row_idx"].iloc[0]) + 2 * np.arange(len(d)) + 1
        # A coefficient belongs to the range of its last row; those beyond the end to the last range.
        own = (at >= start) & ((at < end) | (end >= n)) & (start < n)
        return pd.DataFrame({"d": np.abs(d[own])})

    cut = medians(by_range(rows, ["__v", "__length"], size, margin, finest, "d double"), KEYS, "d").select(*KEYS, (F.col("median") * factor / 0.6745).alias("__cut"))
    cut_rows = rows.join(cut, list(KEYS), "left").withColumn("__cut", F.coalesce("__cut", F.lit(0.0)))

    def smooth(t: pd.DataFrame, start: int, end: int) -> pd.DataFrame:
        at = t["row_idx"].to_numpy()
        y = K.denoised(t["__v"].to_numpy(), level, factor, float(t["__cut"].iloc[0]))
        own = (at >= start) & (at < end)
        return pd.DataFrame({"row_idx": at[own], out: y[own]})

    return by_range(cut_rows, ["__v", "__length", "__cut"], size, margin, smooth, f"row_idx long, {out} double")


def magnetic(df: DataFrame, value: str, out: str, sigma: float = 2.0) -> DataFrame:
    """(trace_id, row_idx, ``out``): filled both ways (nothing to fill with: 0), denoised, smoothed, standardised by the sample deviation."""
    filled = frames.filled(df, value, "__f")
    smooth = frames.gaussian(denoised(filled, "__f", "__d"), "__d", "__g", sigma)
    return frames.zscore(smooth, "__g", out, sample=True).select(*KEYS, "row_idx", out)


# -- turns ---------------------------------------------------------------------


def polynomial_smooth(df: DataFrame, value: str, out: str, window: int, order: int) -> DataFrame:
    """Adds ``out``: each row's value of the polynomial of ``order`` fitted to the ``window`` rows around it; at the ends, of the first or last window's.

    Weights are fixed, so each row is a weighted sum over a window; a shorter trace stays as it is.
    """
    half, t = window // 2, np.arange(window) - window // 2
    design = np.vander(t, order + 1, increasing=True)
    # Row i: the weights that give the polynomial's value at place i of a window.
    weights = design @ np.linalg.pinv(design)
    w = Window.partitionBy(*KEYS).orderBy("row_idx")
    n, at = F.col("__length"), F.col("row_idx")
    place = F.when(at < half, at).when(at >= n - half, at - (n - window)).otherwise(half)
    told = df.withColumn("__length", F.count("*").over(frames.whole())).withColumn("__place", place)
    # Places beyond the middle look back further, those before it ahead: the window of a row starts ``place`` rows before it.
    total = F.lit(0.0)
    table = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in weights])
    for shift in range(1 - window, window):
        inside = (F.col("__place") + shift >= 0) & (F.col("__place") + shift < window)
        weight = F.get(F.get(table, F.col("__place").cast("int")), (F.col("__place") + shift).cast("int"))
        near = F.lag(value, -shift).over(w) if shift < 0 else F.lead(value, shift).over(w)
        total = total + F.when(inside, weight * near).otherwise(0.0)
    return told.withColumn(out, F.when(n < window, F.col(value)).otherwise(total)).drop("__length", "__place")


def debounced(flags: DataFrame, gap: int) -> DataFrame:
    """Of flagged rows (trace_id, row_idx) the first of each trace and each next one at least ``gap`` after the one taken before.

    The next one is a function of the row, whether it is taken or not; the rows
    taken are those that the first one reaches. Pointer doubling finds them:
    each round knows twice as many steps, so rounds go with the logarithm of the flags.
    """
    # From the end: the last flag seen when the place ``gap`` after a flag is reached.
    both = flags.select(*KEYS, "row_idx", F.col("row_idx").alias("__at"), F.col("row_idx").alias("__flag")).unionByName(flags.select(*KEYS, "row_idx", (F.col("row_idx") + gap).alias("__at"), F.lit(None).cast("bigint").alias("__flag")))
    back = Window.partitionBy(*KEYS).orderBy(F.desc("__at"), F.asc_nulls_last("__flag")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = both.withColumn("next", F.last("__flag", True).over(back)).where("__flag is null")
    first = F.row_number().over(Window.partitionBy(*KEYS).orderBy("row_idx")) == 1
    now = stored(ahead.select(*KEYS, "row_idx", "next", first.alias("taken")), "flags")
    while True:
        # What a taken row points to is taken, and all pointers skip twice as far.
        hit = now.where("taken and next is not null").select(*KEYS, F.col("next").alias("row_idx"), F.lit(True).alias("__hit"))
        far = now.select(*KEYS, F.col("row_idx").alias("next"), F.col("next").alias("__far"))
        step = now.join(hit, [*KEYS, "row_idx"], "left").join(far, [*KEYS, "next"], "left")
        step = step.select(*KEYS, "row_idx", F.col("__far").alias("next"), (F.col("taken") | F.coalesce("__hit", F.lit(False))).alias("taken"))
        now = stored(step, "flags")
        if now.where("next is not null").isEmpty():
            return now.where("taken").select(*KEYS, "row_idx")


# -- clusters on a line ----------------------------------------------------------


def complete_linkage(df: DataFrame, value: str, cut: float) -> DataFrame:
    """Adds ``cluster``: labels, ascending by value, of clusters joined while their farthest members are within ``cut``.

    Equal values count once, and neighbours further apart than ``cut`` never
    share a cluster: between such gaps each piece of the line is clustered by itself.
    """
    once = df.select(*KEYS, F.col(value).cast("double").alias("__v")).where("__v is not null").distinct()
    w = Window.partitionBy(*KEYS).orderBy("__v")
    gap = F.coalesce((F.col("__v") - F.lag("__v").over(w) > cut).cast("int"), F.lit(0))
    pieces = once.withColumn("__gap", gap).withColumn("__piece", F.sum("__gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    @F.pandas_udf("array<double>")
    def link(lists: pd.Series) -> pd.Series:
        return pd.Series([x[K.linked_starts(x, cut)] for x in map(np.asarray, lists)])

    # A piece that spans no more than ``cut`` is one cluster: only the others, many to a call, are linked.
    pieces = pieces.groupBy(*KEYS, "__piece").agg(F.array_sort(F.collect_list("__v")).alias("__x"))
    one = F.element_at("__x", -1) - F.get("__x", F.lit(0)) <= cut
    whole = pieces.where(one).select(*KEYS, F.explode("__x").alias("__v"), F.get("__x", F.lit(0)).alias("__first"))
    cut_up = pieces.where(~one).select(*KEYS, "__x", link("__x").alias("__y")).select(*KEYS, F.explode(F.arrays_zip("__x", "__y")).alias("z"))
    told = whole.unionByName(cut_up.select(*KEYS, F.col("z.__x").alias("__v"), F.col("z.__y").alias("__first")))
    named = told.withColumn("cluster", (F.dense_rank().over(Window.partitionBy(*KEYS).orderBy("__first")) - 1).cast("bigint"))
    return df.withColumn("__v", F.col(value).cast("double")).join(named.drop("__first"), [*KEYS, "__v"], "left").drop("__v")
