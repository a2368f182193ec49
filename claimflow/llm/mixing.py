"""Mixing sources to target weights by pivotal dependent rounding.

Each document should be taken a fractional number of times. The whole part is
taken outright; the fractional parts are rounded in dependence on each other:
two documents of a source meet, and one moves words to the other until one of
the two is in or out entirely, at random so that expectations hold and the
source's words stay what they were. What is left over of a bucket of documents
meets what is left of others in a reduction tree of fixed fan-in, so a source
ends with one undecided document, however many tasks it was spread over. That
one is cut, or drawn by itself.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import free_prefix, need, stored, text_or_empty

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_COPIES = 2.0
#: Documents of one bucket, on average, and buckets that meet in one node of the tree.
BUCKET_ROWS = 20_000
FAN_IN = 64
WORD = r"[^\x20\x09-\x0D]+"

#: What an undecided row carries through the tree.
ROW = "doc_id long, nth int, source string, size long, u long, p double"


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """Adds ``target`` to (source, source_size).

    Sources in code point order, null last, get the weights in turn and share
    ``share`` of all words by weight; a target stops at ``most`` times its
    source's words and the excess goes to the others by weight until none is
    above. That is the one level at which each uncapped target is its weight
    times the same factor, found by accumulating sources in the order in which
    they reach their cap.
    """
    everywhere = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    caps = sources.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    fills = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    told = (
        caps.withColumn("all", F.sum("source_size").over(everywhere) * F.lit(float(share)))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(fills), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(everywhere) - F.coalesce(F.sum("w").over(fills), F.lit(0.0)))
        .withColumn("level", F.greatest((F.col("all") - F.col("cap_before")) / F.col("w_left"), F.lit(0.0)))
    )
    # The first source whose cap is above the level at which all later ones would be filled sets the level.
    told = told.withColumn("final", F.min(F.when(F.col("cap") / F.col("w") >= F.col("level"), F.struct("cap_before", "level"))).over(everywhere)["level"])
    return told.select("source", "source_size", F.least("cap", F.coalesce(F.col("final") * F.col("w"), F.col("cap"))).alias("target"))


def _uniform(u: np.ndarray, salt: int) -> np.ndarray:
    z = u.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53


def pivot(p: np.ndarray, size: np.ndarray, chance: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounds the fractions ``p`` of documents of ``size`` words so that the sum of p * size holds.

    Returns the fractions, all 0 or 1 but one at most, and the place of that
    one (-1: none). A document without words has none to give: it is rounded by itself.
    """
    out, at = p.astype(float).copy(), -1
    for j in range(len(out)):
        if out[j] <= 0.0 or out[j] >= 1.0:
            continue
        if size[j] <= 0:
            out[j] = float(chance[j] < out[j])
            continue
        if at < 0:
            at = j
            continue
        a, b, sa, sb = out[at], out[j], size[at], size[j]
        up, down = min((1.0 - a) * sa, b * sb), min(a * sa, (1.0 - b) * sb)
        if chance[j] * (up + down) < down:
            filled = (1.0 - a) * sa <= b * sb
            a, b = (1.0, b - up / sb) if filled else (a + up / sa, 0.0)
        else:
            emptied = a * sa <= (1.0 - b) * sb
            a, b = (0.0, b + down / sb) if emptied else (a - down / sa, 1.0)
        out[at], out[j] = np.clip(a, 0.0, 1.0), np.clip(b, 0.0, 1.0)
        if 0.0 < out[at] < 1.0:
            continue
        at = j if 0.0 < out[j] < 1.0 else -1
    return out, at


def _round(last: bool, salt: int, cut: bool):
    def bucket(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["u", "doc_id", "nth"], kind="stable").reset_index(drop=True)
        p, chance = rows["p"].to_numpy(float).copy(), _uniform(rows["u"].to_numpy(np.int64), salt)
        for _, at in rows.groupby("source", dropna=False, sort=False).indices.items():
            p[at], left = pivot(p[at], rows["size"].to_numpy(np.int64)[at], chance[at])
            if last and left >= 0 and not cut:
                k = at[left]
                p[k] = float(_uniform(rows["u"].to_numpy(np.int64)[k : k + 1], salt + 1)[0] < p[k])
        return rows.assign(p=p)

    return bucket


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, seed: int = 7, cut_last: bool = True, bucket_rows: int = BUCKET_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """Decides how often each row of ``docs`` (doc_id, text, source; other columns are ignored) is taken.

    Returns one row for each: doc_id, nth (0, 1, ... among the rows that share
    doc_id, source and size), source, size, source_size, target, copies (0 to
    ``most`` rounded up) and taken, the words it gives. The one document of a
    source that is undecided in the end gives a part of its words, so that the
    source meets its target to a word; without ``cut_last`` it is drawn like the others. Null text has size 0, null
    is a source of its own, sources without words have target 0 and are taken 0
    times. All randomness is keyed by doc_id, source and size, so reruns agree on any layout.
    Rows that repeat doc_id, source and size count as that many documents. A
    null doc_id is a key like any other. An empty table gives no rows.
    """
    need(docs, ["doc_id", "text", "source"])
    sized = docs.select(F.col("doc_id").cast("long"), "source", words(text_or_empty()).alias("size"))
    # Repeated rows are counted before they are spread out again: no task sees all copies of a key.
    counted = stored(sized.groupBy("doc_id", "source", "size").agg(F.count("*").cast("int").alias("n")), "mix-sizes")
    sources = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    level = stored(targets(sources, weights, share, most), "mix-targets")
    rows = counted.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("nth"))
    rows = rows.withColumn("u", F.xxhash64(F.lit(seed), "doc_id", "source", "size", "nth"))
    joined = rows.alias("r").join(level.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select("doc_id", "nth", "r.source", "size", "u", "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = joined.withColumn("whole", F.floor(rate).cast("int")).withColumn("p", rate - F.floor(rate))
    total = counted.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total // bucket_rows))
    here = rated.select("doc_id", "nth", "source", "size", "u", "p").withColumn("bucket", F.pmod("u", F.lit(buckets)))
    done, salt = [], 1
    while True:
        last = buckets == 1
        out = here.groupBy("bucket").applyInPandas(_round(last, seed * 1000 + salt, cut_last), f"{ROW}, bucket long")
        out = stored(out, "mix-level")
        if last:
            done.append(out)
            break
        done.append(out.where("p <= 0 or p >= 1"))
        buckets, salt = -(-buckets // fan_in), salt + 2
        here = out.where("p > 0 and p < 1").withColumn("bucket", F.expr(f"bucket div {fan_in}"))
    decided = done[0]
    for more in done[1:]:
        decided = decided.unionByName(more)
    final = decided.alias("d").join(level.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    copies = (whole + F.floor("p")).cast("int")
    part = F.when((F.col("p") > 0) & (F.col("p") < 1), F.round(F.col("size") * F.col("p"))).otherwise(0).cast("long")
    return final.select("doc_id", "nth", "d.source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies + part).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as :func:`mix` takes it whole, with all its columns."""
    p = free_prefix(docs)
    told = stored(mix(docs, cut_last=False, **options), "mix-copies").select(*[F.col(c).alias(p + c) for c in ("doc_id", "source", "size", "nth", "copies")])
    key = [f"{p}{c}" for c in ("doc_id", "source", "size")]
    rows = docs.withColumn(f"{p}words", words(text_or_empty()))
    on = F.col("doc_id").eqNullSafe(F.col(key[0])) & F.col("source").eqNullSafe(F.col(key[1])) & (F.col(f"{p}words") == F.col(key[2]))

    def taken(some: DataFrame) -> DataFrame:
        return some.where(F.col(f"{p}copies") > 0).withColumn(f"{p}copy", F.explode(F.sequence(F.lit(1), F.col(f"{p}copies")))).select(*docs.columns)

    repeated = stored(told.groupBy(*key).agg(F.max(f"{p}nth").alias(f"{p}last")).where(F.col(f"{p}last") > 0), "mix-repeated")
    if repeated.isEmpty():
        # The narrow side is hashed, so that texts are dealt out but never sorted.
        return taken(rows.join(told.hint("shuffle_hash"), on))
    same = Window.partitionBy("doc_id", "source", f"{p}words").orderBy(F.xxhash64(text_or_empty()))
    placed = rows.withColumn(f"{p}place", F.row_number().over(same) - 1)
    # Not an equality of keys, so that both sides stay dealt by the columns of the window.
    return taken(placed.join(told, on & (F.col(f"{p}place") <= F.col(f"{p}nth")) & (F.col(f"{p}place") >= F.col(f"{p}nth"))))
