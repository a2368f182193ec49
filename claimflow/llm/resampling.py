"""Importance resampling of documents towards the words of a target corpus.

A document's features are hashed into buckets by higher-order functions, so
that it stays one row: its words become one array of bucket numbers, and its
weight is an aggregate of that array over a literal array of gains. What is
shuffled are totals: counts by bucket, counts by score, and the drawn rows,
which are sorted for their ranks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import lowered, need, numbered, stored, text_or_empty, word_array

BUCKETS = 10_000
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20


def runs_of_words(words: Column, longest: int) -> Column:
    """All runs of 1 to ``longest`` consecutive words, joined by one space."""

    def runs(n: int) -> Column:
        ahead = lambda w, i: F.concat_ws(" ", w, *[F.get(words, i + k) for k in range(1, n)])
        return F.slice(F.transform(words, ahead), F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(0)))

    return F.concat(words, *[runs(n) for n in range(2, longest + 1)]) if longest > 1 else words


def bucketed(rows: DataFrame, buckets: int = BUCKETS, longest: int = 1) -> DataFrame:
    """(the columns of ``rows`` but text, n_words, buckets): the bucket of each feature of a text, in order."""
    kept = [c for c in rows.columns if c != "text"]
    told = rows.select(*kept, word_array(lowered(text_or_empty())).alias("__words"))
    bucket = lambda w: (F.crc32(w.cast("binary")) % buckets).cast("int")
    return told.select(*kept, F.size("__words").cast("long").alias("n_words"), F.transform(runs_of_words(F.col("__words"), longest), bucket).alias("buckets"))


def bucket_counts(rows: DataFrame) -> dict[int, int]:
    """How often each bucket occurs: as many rows as there are buckets, however many documents."""
    return {r["bucket"]: r["n"] for r in rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).collect()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Thousandths of the logarithm of target share by source share of each bucket, one added to every count; floors."""
    s_all, t_all = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(1000 * math.log((target.get(b, 0) + 1) * s_all / ((source.get(b, 0) + 1) * t_all))) for b in range(buckets)]


def literal(values: list[int]) -> Column:
    """An array that the optimizer folds into one literal: two expressions instead of one for each value."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of Gumbel noise, keyed by the seed and doc_id; floors."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = 1, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Draws ``percent`` of the documents of ``least_words`` words or more, those like ``target`` first.

    Takes ``docs`` (doc_id, text) and ``target`` (text); other columns are
    ignored. Returns for every row of ``docs`` doc_id, n_features, weight (the
    floored mean gain of its features, none: 0), score (weight and keyed noise)
    and rank, 1 for the highest score, ties to the smaller doc_id (null last);
    null where it is not drawn. Null text has no features. A null doc_id takes
    the noise of an empty one. Repeated rows are scored, and may be drawn, once
    each. An empty target has the same gain for all unseen buckets; an empty
    ``docs`` gives no rows.
    """
    need(docs, ["doc_id", "text"])
    need(target, ["text"])
    # Texts are read once: a number a word stays, which both the counts and the scores are made of.
    rows = stored(bucketed(docs.select(F.col("doc_id").cast("long"), "text"), buckets, longest), "buckets")
    told = literal(gains(bucket_counts(rows), bucket_counts(bucketed(target.select("text"), buckets, longest)), buckets))
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(told, b + 1))
    sums = rows.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), total.alias("total"))
    weight = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(0)
    scored = sums.select("doc_id", "n_words", "n_features", weight.cast("long").alias("weight")).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = stored(scored, "scores")
    # Scores are whole numbers within the bounds of gains and noise: some ten thousand values, however many documents.
    by_score = sorted(((r["score"], r["n"]) for r in scored.where(F.col("n_words") >= least_words).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    quota, above, cut = percent * sum(n for _, n in by_score) // 100, 0, None
    for score, n in by_score:
        if above >= quota:
            break
        above, cut = above + n, score
    names = ["doc_id", "n_features", "weight", "score"]
    no_rank = F.lit(None).cast("long").alias("rank")
    if cut is None:
        return scored.select(*names, no_rank)
    first = (F.col("n_words") >= least_words) & (F.col("score") >= cut)
    placed = numbered(scored.where(first).select(*names), [F.desc("score"), F.asc_nulls_last("doc_id")], "__place")
    rank = F.when(F.col("__place") < quota, F.col("__place") + 1)
    return scored.where(~first).select(*names, no_rank).unionByName(placed.select(*names, rank.alias("rank")))
