"""Error-rate tables and statistics by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLDS = (0.77, 0.78, 0.79, 0.80, 0.81, 0.82)


def with_thresholds(scores: DataFrame, thresholds: Sequence[float], name: str = "threshold") -> DataFrame:
    """Each row with each threshold: an expansion by their fixed number, made before the aggregation combines it away."""
    return scores.withColumn(name, F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))


def false_accepts(scores: DataFrame, attack: str, score: str, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """(attack, threshold, total_count, accepted_count, far); a null score is rejected."""
    ok = F.coalesce(F.col(score) >= F.col("threshold"), F.lit(False)).cast("int")
    out = with_thresholds(scores, thresholds).groupBy(attack, "threshold").agg(F.count("*").alias("total_count"), F.sum(ok).alias("accepted_count"))
    return out.withColumn("far", F.round(F.col("accepted_count") / F.col("total_count"), 6))


def wide(far: DataFrame, attack: str, names: Sequence[str]) -> DataFrame:
    """One column for each attack; an attack without samples counts 0."""
    return far.groupBy("threshold").pivot(attack, list(names)).agg(F.first("far")).na.fill(0.0)


def accepted(scores: DataFrame, score: str, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    for t in thresholds:
        scores = scores.withColumn(f"accepted_at_{t:.2f}".replace(".", "_"), F.coalesce(F.col(score) >= t, F.lit(False)))
    return scores


def calibrated(genuine: DataFrame, attacks: DataFrame, attack: str, score: str, rates: Sequence[float]) -> DataFrame:
    """Thresholds at which a share of genuine samples is rejected, and the attacks then accepted, in percent."""
    cuts = genuine.agg(F.percentile(score, [float(r) for r in rates]).alias("q")).select(F.posexplode("q").alias("i", "threshold")).withColumn("frr", F.element_at(F.array(*[F.lit(float(r)) for r in rates]), F.col("i") + 1))
    hit = (F.col(score) >= F.col("threshold")).cast("int")
    return attacks.crossJoin(F.broadcast(cuts)).groupBy(attack, "frr", "threshold").agg((F.avg(hit) * 100).alias("far_percent"))


def fenced(df: DataFrame, group: str, value: str, low: float = 0.2, high: float = 0.8, reach: float = 0.5) -> DataFrame:
    """Rows within their group's quantile fences, both ends included."""
    q = df.groupBy(group).agg(F.percentile(value, [low, high]).alias("__q"))
    span = F.col("__q")[1] - F.col("__q")[0]
    return df.join(q, group).where((F.col(value) >= F.col("__q")[0] - reach * span) & (F.col(value) <= F.col("__q")[1] + reach * span)).drop("__q")


def large_groups(df: DataFrame, group: str, more_than: int = 2) -> DataFrame:
    """Rows of groups with more than so many members."""
    kept = df.groupBy(group).count().where(F.col("count") > more_than).select(group)
    return df.join(kept, group, "left_semi")


def outliers(df: DataFrame, value: str, keys: Sequence[str], k: float = 1.0) -> DataFrame:
    """Flags values above the group's mean plus ``k`` population deviations."""
    w = Window.partitionBy(*keys)
    return df.withColumn("is_outlier", F.col(value) > F.avg(value).over(w) + k * F.stddev_pop(value).over(w))


def relabelled(df: DataFrame, label: str, value: str) -> DataFrame:
    """Labels numbered from 0 in the order of the groups' medians (ties: the old label)."""
    medians = df.groupBy(label).agg(F.median(value).alias("median_value"))
    order = Window.orderBy("median_value", label)  # one row a label
    return df.join(medians.withColumn("new_label", (F.row_number().over(order) - 1).cast("bigint")), label)


def top_k(df: DataFrame, keys: Sequence[str], item: str, k: int = 5) -> DataFrame:
    """The most frequent items of each group, ties to the smaller; counts are combined before they are ranked."""
    counts = df.groupBy(*keys, item).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), item))
    return counts.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)


def smallest_mean(df: DataFrame, keys: Sequence[str], label: str, distance: str, k: int) -> DataFrame:
    """Mean of the ``k`` smallest distances by group and label, and the label where it is least."""
    w = Window.partitionBy(*keys, label).orderBy(distance)
    means = df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).groupBy(*keys, label).agg(F.avg(distance).alias("mean_distance"))
    best = F.min(F.struct("mean_distance", label))
    return means.groupBy(*keys).agg(best.alias("__b")).select(*keys, F.col(f"__b.{label}").alias(label), F.col("__b.mean_distance").alias("mean_distance"))


def id_statistics(df: DataFrame, keys: Sequence[str], item: str, k: int = 3) -> DataFrame:
    """Valid and distinct ids of each group, and its most frequent ones with their shares (filled up with 0)."""
    counts = df.where(F.col(item).isNotNull()).groupBy(*keys, item).agg(F.count("*").alias("n"))
    listed = counts.groupBy(*keys).agg(F.sum("n").alias("valid"), F.count("*").alias("distinct_ids"), F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), F.col(item).alias("id")))), 1, k).alias("top"))
    out = listed
    for i in range(k):
        one = F.get("top", F.lit(i))
        out = out.withColumn(f"top{i + 1}_id", F.coalesce(one["id"].cast("bigint"), F.lit(0).cast("bigint"))).withColumn(f"top{i + 1}_ratio", F.coalesce(-one["neg"] / F.col("valid"), F.lit(0.0)))
    return out.drop("top")


def area_under_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """Accuracy at 0.5 and the area under the ROC curve by rank sums, ties at their mean rank; scores are rounded to six places and counted before they are ranked, so a million rows are ranked at most."""
    counts = df.withColumn(score, F.round(score, 6)).groupBy(score).agg(F.sum(F.col(label)).alias("pos"), F.count("*").alias("n"), F.sum((F.col(label) == (F.col(score) >= 0.5).cast("int")).cast("int")).alias("right"))
    below = F.coalesce(F.sum("n").over(Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.withColumn("rank", below + (F.col("n") + 1) / 2)
    total = ranked.agg(F.sum("n").alias("n"), F.sum("pos").alias("p"), F.sum(F.col("rank") * F.col("pos")).alias("s"), F.sum("right").alias("right"))
    return total.select((F.col("right") / F.col("n")).alias("accuracy"), ((F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))).alias("auc"))


def minmax(value: str, w) -> Column:
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(0.0)
