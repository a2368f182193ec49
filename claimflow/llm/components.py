"""Connected components by alternating large-star and small-star steps.

All links stay distributed: each step is one aggregation (with map-side
combining, so that a hub is no single task) and one join that adaptive
execution may split. The links shrink to stars in O(log^2 n) steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ._shared import stored


def _mark(edges: DataFrame) -> Row:
    return edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("child", "parent").cast("decimal(38,0)")).alias("s")).first()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("child").alias("u"), F.col("parent").alias("v")).union(edges.select(F.col("parent").alias("u"), F.col("child").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("child"), F.col("m").alias("parent")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("child").agg(F.min("parent").alias("m"))
    down = edges.join(least, "child").where("parent <> m").select(F.col("parent").alias("child"), F.col("m").alias("parent"))
    return down.union(least.select("child", F.col("m").alias("parent"))).distinct()


def connected_components(edges: DataFrame, most_steps: int = 60) -> DataFrame:
    """Components of the links (``a``, ``b``), both long and not null.

    Returns (node, component) for every node that is not the smallest of its
    component; ``component`` is the smallest node reachable. Self links, null
    ends and repeated links change nothing; no links give no rows.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent")).distinct()
    edges = stored(edges, "links")
    mark = _mark(edges)
    for _ in range(most_steps):
        if not mark["n"]:
            break
        edges = stored(_small_star(_large_star(edges)), "links")
        old, mark = mark, _mark(edges)
        if old == mark:
            break
    else:
        raise RuntimeError(f"links did not settle in {most_steps} steps")
    return edges.select(F.col("child").alias("node"), F.col("parent").alias("component"))
