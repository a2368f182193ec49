"""Operators on the transition graph.

The graph has one node per environment state, a few dozen in all. Searches go
by frontier: each round joins what the last one reached with the links and
keeps what is new, stored in the shared folder, until nothing is. A round costs
a join of the frontier only, walks are never listed, and no depth is set.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_path, stored


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of each link once, without self links."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    return symmetric(edges).groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))


def _starts(edges: DataFrame, sources: DataFrame | None) -> DataFrame:
    """The nodes of the graph that searches start from: all, or those in ``sources`` (src)."""
    nodes = edges.select("src").union(edges.select("dst")).distinct()
    return nodes if sources is None else nodes.join(sources.select("src").distinct(), "src", "left_semi")


def _rounds(start: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], back: int | None = 2) -> DataFrame:
    """All rows of ``start`` and of the rounds of ``step`` (frontier, what is known) until one adds nothing.

    What is known are the last ``back`` rounds: a link leads from a node to
    nodes at most one link nearer or farther, so a search by fewest links meets
    none of an earlier round again, and each row is read a fixed number of times.
    ``None``: all rounds, for searches that may come back to a node.
    """
    spark, schema, base = start.sparkSession, start.schema, shared_path(start.sparkSession, "frontier")
    read = lambda first, last: spark.read.schema(schema).parquet(*[f"{base}/round={k}" for k in range(first, last + 1)])
    at = 0
    start.write.parquet(f"{base}/round={at}")
    while True:
        front = read(at, at)
        if front.isEmpty():
            return spark.read.schema(schema).parquet(base).select(*schema.names)
        new = step(front, read(0 if back is None else max(0, at + 1 - back), at)).select(*schema.names)
        at += 1
        new.write.parquet(f"{base}/round={at}")


def _onward(front: DataFrame, links: DataFrame, *more: Column) -> DataFrame:
    """The frontier one link on: src, the new dst and ``more`` columns of both (``f`` and ``l``)."""
    return front.alias("f").join(links.alias("l"), F.col("f.dst") == F.col("l.src")).select(F.col("f.src"), F.col("l.dst"), *more)


def hops(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(src, dst, distance): fewest links between each reachable pair; 0 to itself."""
    links = stored(symmetric(edges), "links")
    start = _starts(edges, sources).select("src", F.col("src").alias("dst"), F.lit(0).alias("distance"))

    def step(front: DataFrame, so_far: DataFrame) -> DataFrame:
        return _onward(front, links, (F.col("f.distance") + 1).alias("distance")).distinct().join(so_far.select("src", "dst"), ["src", "dst"], "left_anti")

    return _rounds(start, step)


def shortest_paths(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(src, dst, path): of the paths with fewest links the first in node order, which is what a breadth-first search by sorted neighbours finds."""
    links = stored(symmetric(edges), "links")
    start = _starts(edges, sources).select("src", F.col("src").alias("dst"), F.array("src").alias("path"))

    def step(front: DataFrame, so_far: DataFrame) -> DataFrame:
        # The part of a first path up to any node is that node's first path, so one path a pair is enough.
        walked = _onward(front, links, F.concat("f.path", F.array("l.dst")).alias("path")).groupBy("src", "dst").agg(F.min("path").alias("path"))
        return walked.join(so_far.select("src", "dst"), ["src", "dst"], "left_anti")

    return _rounds(start, step)


def weighted(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(src, dst, length): shortest lengths over links with a ``length`` of 0 or more; pairs that improve go on to the next round."""
    both = edges.select("src", "dst", "length").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "length")).where("src <> dst")
    links = stored(both.groupBy("src", "dst").agg(F.min("length").alias("length")), "links")
    start = _starts(edges, sources).select("src", F.col("src").alias("dst"), F.lit(0.0).alias("length"))

    def step(front: DataFrame, so_far: DataFrame) -> DataFrame:
        best = so_far.groupBy("src", "dst").agg(F.min("length").alias("best"))
        found = _onward(front, links, (F.col("f.length") + F.col("l.length")).alias("length")).groupBy("src", "dst").agg(F.min("length").alias("length"))
        return found.join(best, ["src", "dst"], "left").where("best is null or length < best")

    return _rounds(start, step, back=None).groupBy("src", "dst").agg(F.min("length").alias("length"))


def path_lengths(edges: DataFrame, pairs: DataFrame, strict: bool = True) -> DataFrame:
    """``pairs`` (src, dst, ...) with their shortest length; where one is not connected raises, or without ``strict`` gives null."""
    told = stored(pairs.join(weighted(edges, pairs.select("src")), ["src", "dst"], "left"), "path-lengths")
    apart = told.where("length is null").select("src", "dst").limit(3).collect() if strict else []
    if apart:
        raise ValueError("not connected: " + ", ".join(f"{r['src']} and {r['dst']}" for r in apart))
    return told


def expanded_path(visits: DataFrame, paths: DataFrame, keys: list[str]) -> DataFrame:
    """A visited node sequence with the nodes in between, up to the first pair without a path."""
    w = Window.partitionBy(*keys).orderBy("seq")
    pairs = visits.withColumn("next", F.lead("node").over(w))
    known = pairs.join(paths.select(F.col("src").alias("node"), F.col("dst").alias("next"), "path"), ["node", "next"], "left")
    broken = F.max(F.when(F.col("next").isNotNull() & F.col("path").isNull(), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    kept = known.withColumn("__broken", F.coalesce(broken, F.lit(0))).where("__broken = 0")
    part = F.coalesce(F.slice("path", F.lit(1), F.size("path") - 1), F.array("node"))
    lists = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", F.when(F.col("path").isNotNull() & (F.size("path") == 1), F.array().cast("array<bigint>")).otherwise(part).alias("part")))).alias("__p"))
    return lists.select(*keys, F.flatten(F.transform("__p", lambda x: x["part"])).alias("node_path"))


def merged_nodes(nodes: DataFrame, paths: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (node, features array) relabelled by (old, new); labels outside the mapping stay.

    Returns the nodes with the features of all that became one, their links in
    both directions, and ``paths`` (src, dst, ...) between the new labels; what
    would lead from a node to itself goes.
    """
    to = lambda df, c: df.join(mapping.select(F.col("old").alias(c), F.col("new").alias("__new")), c, "left").withColumn(c, F.coalesce("__new", c)).drop("__new")
    merged = to(nodes, "node").select("node", F.explode_outer("features").alias("f")).groupBy("node").agg(F.array_sort(F.collect_set("f")).alias("features"))
    moved = to(to(paths, "src"), "dst").where("src <> dst")
    return merged, symmetric(moved), moved


def layout(paths: DataFrame, start: int = 0) -> DataFrame:
    """(node, x, y): positions of nodes by walking the graph from ``start`` at the origin, heading along x.

    ``paths`` (src, dst, seq, turns): turns lists (turn, length) pieces, a turn
    of 1 being 90 degrees to the right and -1 to the left. A path read from its
    end has its pieces in reverse order and its turns the other way. A node is
    placed by the path that a breadth-first search in the order of ``seq`` comes
    by first, and keeps the heading on arrival; what is not reached is at (9999, 9999).
    """
    back = F.transform(F.reverse("turns"), lambda t: F.struct((-t["turn"]).alias("turn"), t["length"].alias("length")))
    both = paths.select("src", "dst", "seq", "turns").unionByName(paths.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "seq", back.alias("turns"))).where("src <> dst")
    links = stored(both, "links")
    nodes = links.select(F.col("src").alias("node")).distinct()
    zero = F.lit(0.0)
    begin = nodes.where(F.col("node") == start).select(F.col("node").alias("src"), F.col("node").alias("dst"), F.array().cast("array<bigint>").alias("came"), F.struct(zero.alias("x"), zero.alias("y"), zero.alias("heading")).alias("at"))

    def walk(at: Column, piece: Column) -> Column:
        heading = at["heading"] - 90 * piece["turn"]
        along = F.radians(heading)
        return F.struct((at["x"] + piece["length"] * F.cos(along)).alias("x"), (at["y"] + piece["length"] * F.sin(along)).alias("y"), heading.alias("heading"))

    def step(front: DataFrame, so_far: DataFrame) -> DataFrame:
        onward = _onward(front, links, F.concat("f.came", F.array(F.col("l.seq").cast("bigint"))).alias("came"), F.aggregate("l.turns", F.col("f.at"), walk).alias("at"))
        first = onward.groupBy("src", "dst").agg(F.min_by(F.struct("came", "at"), "came").alias("one"))
        return first.select("src", "dst", "one.came", "one.at").join(so_far.select("src", "dst"), ["src", "dst"], "left_anti")

    reached = _rounds(begin, step).select(F.col("dst").alias("node"), "at")
    return nodes.join(reached, "node", "left").select("node", F.coalesce("at.x", F.lit(9999.0)).alias("x"), F.coalesce("at.y", F.lit(9999.0)).alias("y"))
