"""Frame operators over ordered traces: every window is partitioned by trace, so no task sees the whole table."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import stored

KEYS = ("trace_id",)


def over(keys: Sequence[str] = KEYS, order: str = "row_idx") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def rows(start: int | None, end: int | None, keys: Sequence[str] = KEYS, order: str = "row_idx") -> WindowSpec:
    return over(keys, order).rowsBetween(Window.unboundedPreceding if start is None else start, Window.unboundedFollowing if end is None else end)


def whole(keys: Sequence[str] = KEYS) -> WindowSpec:
    return Window.partitionBy(*keys)


def with_row_index(df: DataFrame, order: Sequence[str], keys: Sequence[str] = KEYS, name: str = "row_idx") -> DataFrame:
    """Numbers the rows of each trace from 0: file order, made explicit once."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("bigint"))


def difference(df: DataFrame, value: str, out: str) -> DataFrame:
    return df.withColumn(out, F.col(value) - F.lag(value).over(over()))


def trailing_mean(df: DataFrame, value: str, out: str, n: int = 5) -> DataFrame:
    return df.withColumn(out, F.avg(value).over(rows(1 - n, 0)))


def centred_mean(df: DataFrame, value: str, out: str, n: int = 5) -> DataFrame:
    return df.withColumn(out, F.avg(value).over(rows(-(n // 2), n // 2)))


def trailing_sum(df: DataFrame, value: str, out: str, n: int = 200) -> DataFrame:
    return df.withColumn(out, F.sum(value).over(rows(1 - n, 0)))


def filled(df: DataFrame, value: str, out: str) -> DataFrame:
    """Forward, then backward fill; both are running windows, the second from the end, so that each row is looked at once."""
    back = Window.partitionBy(*KEYS).orderBy(F.desc("row_idx")).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.coalesce(F.last(value, True).over(rows(None, 0)), F.last(value, True).over(back)))


def filled_up_to(df: DataFrame, value: str, out: str, n: int = 100) -> DataFrame:
    """Forward fill over at most ``n`` rows, the value's own included."""
    return df.withColumn(out, F.last(value, True).over(rows(1 - n, 0)))


def filled_with_first(df: DataFrame, value: str, out: str) -> DataFrame:
    """Missing ids become the first known id of the trace."""
    return df.withColumn(out, F.coalesce(value, F.first(value, True).over(rows(None, None))))


def zscore(df: DataFrame, value: str, out: str, sample: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """Standardised by trace; a flat trace is only centred."""
    w = whole(keys)
    sd = (F.stddev_samp if sample else F.stddev_pop)(value).over(w)
    return df.withColumn(out, (F.col(value) - F.avg(value).over(w)) / F.when((sd == 0) | sd.isNull(), 1.0).otherwise(sd))


def sliding_windows(df: DataFrame, size: int, step: int, aggregates: dict[str, Column], dealt: int | None = None) -> DataFrame:
    """Complete windows of ``size`` rows every ``step`` rows: one row each with ``start_row``, ``end_row`` and the aggregates.

    Each row goes to the windows that hold it, size / step of them, and only
    these are aggregated; the aggregates must not depend on order. A trace's
    rows are together already, so nothing is shuffled again. Where they are not
    (after a table was written), ``dealt`` brings those of so many windows
    together first, so that rows are shuffled and not the lists of windows.
    """
    newest = (F.col("row_idx") - F.col("row_idx") % step).cast("bigint")
    oldest = F.greatest(F.lit(0), F.ceil((F.col("row_idx") - size + 1) / step) * step).cast("bigint")
    keys = list(KEYS)
    if dealt:
        span = dealt * step
        parts = F.when(newest >= oldest, F.sequence(F.floor(oldest / span).cast("bigint"), F.floor(newest / span).cast("bigint")))
        df = df.withColumn("__part", F.explode(parts)).repartition(*KEYS, "__part")
        oldest, newest = F.greatest(oldest, F.col("__part") * span), F.least(newest, (F.col("__part") + 1) * span - step)
        keys.append("__part")
    # With a step beyond the size some rows are in no window.
    held = F.when(newest >= oldest, F.sequence(oldest, newest, F.lit(step).cast("bigint")))
    made = df.withColumn("start_row", F.explode(held)).groupBy(*keys, "start_row").agg(F.count("*").alias("__n"), *[a.alias(k) for k, a in aggregates.items()])
    return made.where(F.col("__n") == size).select(*KEYS, "start_row", (F.col("start_row") + size).alias("end_row"), *aggregates)


def windowed_lists(df: DataFrame, value: str, size: int, step: int) -> DataFrame:
    """Windows as lists, for statistics that restart in each window."""
    return sliding_windows(df, size, step, {"items": F.collect_list(F.struct(F.col("row_idx"), F.col(value).alias("v")))}).withColumn("items", F.transform(F.array_sort("items"), lambda x: x["v"]))


def rolling_deviation_mean(items: str, n: int) -> Column:
    """Mean of the trailing sample deviations over ``n`` items inside a list; the first, which has none, is skipped."""
    v = F.col(items)

    def deviation(i: Column) -> Column:
        part = F.slice(v, F.greatest(i - n + 2, F.lit(1)), F.least(i + 1, F.lit(n)))
        mean = C.array_mean(part)
        return F.sqrt(F.aggregate(F.transform(part, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x) / (F.size(part) - 1))

    return C.array_mean(F.transform(F.sequence(F.lit(1), F.size(v) - 1), deviation))


def changes(df: DataFrame, columns: Sequence[str], out: str) -> DataFrame:
    """1 where any of the columns differs from the row before, else 0."""
    now, before = F.struct(*columns), F.lag(F.struct(*columns)).over(over())
    return df.withColumn(out, F.when(before.isNotNull() & (now != before), 1).otherwise(0))


def consecutive_pairs(df: DataFrame, value: str) -> DataFrame:
    """(``left``, ``right``) of each pair of consecutive rows."""
    return df.withColumn("right", F.lead(value).over(over())).where(F.col("right").isNotNull()).withColumnRenamed(value, "left")


def cumulative_path(df: DataFrame, length: str, heading: str) -> DataFrame:
    """Positions after each step from the origin."""
    r = F.radians(heading)
    return df.withColumn("x", F.sum(F.col(length) * F.cos(r)).over(rows(None, 0))).withColumn("y", F.sum(F.col(length) * F.sin(r)).over(rows(None, 0)))


def rate_limited(df: DataFrame, heading: str, out: str, most: float = 20.0) -> DataFrame:
    """A heading whose turns are cut to ``most`` degrees a sample."""
    turn = C.wrap180(F.col(heading) - F.lag(heading).over(over()))
    cut = F.greatest(F.least(F.coalesce(turn, F.lit(0.0)), F.lit(most)), F.lit(-most))
    return df.withColumn("__cut", cut).withColumn(out, F.first(heading).over(rows(None, 0)) + F.sum("__cut").over(rows(None, 0))).drop("__cut")


def bounds(df: DataFrame, value: str, factor: float = 0.07, sample: bool = True) -> DataFrame:
    """Upper and lower bound of each trace: mean plus or minus ``factor`` deviations of the absolute values."""
    sd = F.stddev_samp if sample else F.stddev_pop
    return df.groupBy(*KEYS).agg((F.avg(F.abs(value)) + factor * sd(F.abs(value))).alias("upper"), (F.avg(F.abs(value)) - factor * sd(F.abs(value))).alias("lower"))


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "position") -> DataFrame:
    """Adds ``name``, the place of each row from 0 in the order of all: one range sort, then places in a task plus counts by task."""
    rows = stored(df.orderBy(*order).withColumn("__mono", F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumn("__task", F.shiftright("__mono", 33)).withColumn("__nth", F.col("__mono").bitwiseAND((1 << 33) - 1))
    # A row a task.
    before = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = rows.groupBy("__task").agg(F.count("*").alias("__n")).select("__task", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return rows.join(F.broadcast(tasks), "__task").withColumn(name, F.col("__start") + F.col("__nth")).select(*df.columns, name)


def gaussian(df: DataFrame, value: str, out: str, sigma: float, truncate: float = 4.0) -> DataFrame:
    """(trace_id, row_idx, ``out``): the Gaussian mean of each row's neighbourhood, reflected at both ends of a trace; null counts as 0.

    Each row gives its weighted value to the places around it, as itself and as
    its mirror images, and a place adds up what it gets; no trace is gathered.
    """
    reach = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(reach + 1)]
    weights = F.array(*[F.lit(x / (raw[0] + 2 * sum(raw[1:]))) for x in raw])
    n = F.col("__n")
    times = F.ceil(F.lit(reach) / (2 * n)).cast("bigint") + 1
    images = F.flatten(F.transform(F.sequence(-times, times), lambda m: F.array(2 * n * m + F.col("row_idx"), 2 * n * m - 1 - F.col("row_idx"))))
    near = F.filter(images, lambda p: (p >= -reach) & (p < n + reach))
    rows = df.select(*KEYS, "row_idx", F.coalesce(F.col(value), F.lit(0.0)).alias("__v"), F.count("*").over(whole()).alias("__n"))
    given = rows.select(*KEYS, "__v", "__n", F.explode(near).alias("__p"))
    places = F.sequence(F.greatest(F.lit(0), F.col("__p") - reach), F.least(n - 1, F.col("__p") + reach))
    given = given.select(*KEYS, "__v", "__p", F.explode(places).alias("row_idx"))
    term = F.col("__v") * F.element_at(weights, (F.abs(F.col("__p") - F.col("row_idx")) + 1).cast("int"))
    return given.groupBy(*KEYS, "row_idx").agg(F.sum(term).alias(out))


def aligned(points: DataFrame, target: int, steps: int = 10) -> DataFrame:
    """Paths (trace_id, row_idx, x, y) moved to the start of the path ``target`` and turned by its heading over the first ``steps`` steps: adds u, v.

    A path, or a target, of fewer points is only moved. Without the target
    there is nothing to align to, which is an error.
    """
    ends = points.groupBy(*KEYS).agg(
        *[F.max(F.when(F.col("row_idx") == i, F.col(c))).alias(f"__{c}{k}") for k, i in (("a", 0), ("b", steps)) for c in ("x", "y")],
    )
    # One row.
    goal = ends.where(F.col("trace_id") == target).select(*[F.col(c).alias(f"__t{c[2:]}") for c in ends.columns if c.startswith("__")])
    if goal.isEmpty():
        raise ValueError(f"no path {target} to align to")
    both = ends.crossJoin(F.broadcast(goal))
    angle = F.atan2(F.col("__tyb") - F.col("__tya"), F.col("__txb") - F.col("__txa")) - F.atan2(F.col("__yb") - F.col("__ya"), F.col("__xb") - F.col("__xa"))
    both = both.withColumn("__turn", F.coalesce(angle, F.lit(0.0)))
    dx, dy = F.col("x") - F.col("__xa"), F.col("y") - F.col("__ya")
    moved = points.join(both, list(KEYS)).withColumn("u", F.col("__txa") + dx * F.cos("__turn") - dy * F.sin("__turn")).withColumn("v", F.col("__tya") + dx * F.sin("__turn") + dy * F.cos("__turn"))
    return moved.select(*points.columns, "u", "v")


def in_time_window(df: DataFrame, ms: str, start: int, end: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows from ``start`` to ``end`` (milliseconds) by the clock; where a trace's clock does not meet the window, by the time since the trace's start."""
    w = whole(keys)
    t, first, last = F.col(ms), F.min(ms).over(w), F.max(ms).over(w)
    day = 86_400_000
    over = end + day if end < start else end
    apart = (first > over) | (last < start)
    marked = df.withColumn("__apart", apart).withColumn("__since", t - first)
    return marked.where(F.when(F.col("__apart"), F.col("__since").between(start, over)).otherwise(C.between_clock(t, F.lit(start), F.lit(end)))).drop("__apart", "__since")
