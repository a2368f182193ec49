"""Interval and segment operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .frames import KEYS


def merged(df: DataFrame, start: str = "start_row", end: str = "end_row", keys: Sequence[str] = KEYS) -> DataFrame:
    """Overlapping or touching intervals of a trace as one (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("__new", F.when(reach.isNull() | (reach < F.col(start)), 1).otherwise(0))
    marked = marked.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def recentred(segments: DataFrame, trace: DataFrame, value: str, width: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Segments longer than ``width`` become that wide around their first maximum, cut at the segment's ends; ``score`` is the maximum."""
    s, t = segments.alias("s"), trace.alias("t")
    on = [F.col(f"s.{k}") == F.col(f"t.{k}") for k in keys] + [F.col("t.row_idx") >= F.col("s.start_row"), F.col("t.row_idx") < F.col("s.end_row")]
    top = s.join(t, on).groupBy(*[F.col(f"s.{k}").alias(k) for k in keys], "start_row", "end_row").agg(F.max(F.struct(F.col(value).alias("v"), (-F.col("row_idx")).alias("at"))).alias("__top"))
    centre = -F.col("__top.at")
    low = F.greatest(F.col("start_row"), centre - width // 2)
    long = F.col("end_row") - F.col("start_row") > width
    return top.select(*keys, F.when(long, low).otherwise(F.col("start_row")).alias("start_row"), F.when(long, F.least(low + width, F.col("end_row"))).otherwise(F.col("end_row")).alias("end_row"), F.col("__top.v").alias("score"))


def paired_off(df: DataFrame, gap: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Two neighbours at most ``gap`` apart become one, two at a time and not transitively.

    In a chain of segments that each lie near the one before, the first joins
    the second, the third the fourth, and an odd last one stays: the place in
    the chain tells it.
    """
    w = Window.partitionBy(*keys).orderBy("start_row", "end_row")
    apart = F.coalesce((F.col("start_row") - F.lag("end_row").over(w) > gap).cast("int"), F.lit(1))
    chained = df.withColumn("__apart", apart).withColumn("__chain", F.sum("__apart").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy(*keys, "__chain").orderBy("start_row", "end_row")) - 1
    pairs = chained.withColumn("__pair", F.floor(place / 2)).groupBy(*keys, "__chain", "__pair")
    return pairs.agg(F.min("start_row").alias("start_row"), F.max(F.struct("start_row", "end_row"))["end_row"].alias("end_row")).select(*keys, "start_row", "end_row")


def greedy_peaks(df: DataFrame, value: str, height: Column, distance: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Local maxima of at least ``height`` from left to right: one within ``distance`` of the last replaces it if it is higher."""
    w = Window.partitionBy(*keys).orderBy("row_idx")
    tops = df.withColumn("__l", F.lag(value).over(w)).withColumn("__r", F.lead(value).over(w)).where((F.col(value) >= height) & (F.col(value) > F.col("__l")) & (F.col(value) >= F.col("__r")))
    listed = tops.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("row_idx", F.col(value).alias("v")))).alias("__t"))

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        near = last.isNotNull() & (x["row_idx"] - last["row_idx"] < distance)
        swapped = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(x))
        return F.when(near & (x["v"] > last["v"]), swapped).when(near, acc).otherwise(F.concat(acc, F.array(x)))

    kept = F.aggregate("__t", F.array().cast("array<struct<row_idx:bigint,v:double>>"), step)
    return listed.select(*keys, F.explode(kept).alias("x")).select(*keys, "x.row_idx", F.col("x.v").alias(value))


def between_cuts(steps: DataFrame, cuts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Path length between consecutive cut points of a trace: the rounded sum of the steps in between."""
    w = Window.partitionBy(*keys).orderBy("row_idx")
    spans = cuts.withColumn("next_row", F.lead("row_idx").over(w)).where("next_row is not null").withColumnRenamed("row_idx", "cut_row")
    run = steps.withColumn("__run", F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda name: run.select(*keys, F.col("row_idx").alias(name), F.col("__run").alias(f"__{name}"))
    both = spans.join(at("cut_row"), [*keys, "cut_row"]).join(at("next_row"), [*keys, "next_row"])
    return both.select(*keys, "cut_row", "next_row", F.bround(F.col("__next_row") - F.col("__cut_row"), 0).cast("bigint").alias("path_length"))


def reversed_path(parts: Column | str) -> Column:
    """A path walked the other way: order reversed, turns negated."""
    return F.transform(F.reverse(parts), lambda x: F.struct((-x["turn"]).alias("turn"), x["length"].alias("length")))


def contiguous_sample(df: DataFrame, n: int, seed: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """``n`` consecutive rows of each trace that has as many, from a keyed start."""
    count = F.count("*").over(Window.partitionBy(*keys))
    start = C.keyed(F.col("__n") - n + 1, F.lit(seed), *keys)
    some = df.withColumn("__n", count).where(F.col("__n") >= n).withColumn("__s", start)
    return some.where((F.col("row_idx") >= F.col("__s")) & (F.col("row_idx") < F.col("__s") + n)).withColumn("sample_row", F.col("row_idx") - F.col("__s")).drop("__n", "__s")


def appended(target: DataFrame, extra: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``extra`` rows (with ``sample_row``) behind each target trace, numbered on."""
    ends = target.groupBy(*keys).agg((F.max("row_idx") + 1).alias("__end"))
    tail = extra.join(ends, list(keys)).withColumn("row_idx", F.col("__end") + F.col("sample_row")).drop("__end", "sample_row")
    return target.withColumn("appended", F.lit(False)).unionByName(tail.withColumn("appended", F.lit(True)))
