"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample and every vector is filed under a leaf.
A query visits leaves best bin first: a priority queue holds the branches not
taken, nearest centre first. How many leaves are visited is calibrated: against
brute force over all vectors for a bounded set of queries, visits widen until
the wanted recall is reached. Equal vectors are one entry with their smallest
ids, so that copies make no leaf large and lose no tie.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import need, small_batches, stored

#: Vectors that the tree is fitted on at most (drawn by a hash of vec_id), and queries that calibrate it at most.
SAMPLE = 40_000
CALIBRATION = 200
BRANCH = 12
LEAF_ROWS = 150
RECALL = 0.95
#: Entries that meet queries in one task: neighbouring leaves are bundled up to this number, a larger leaf is dealt over several bundles.
BUNDLE_ROWS = 4_000
#: Queries that a bundle meets in one task, about: a bundle asked by more is copied to blocks of them.
BLOCK_QUERIES = 16_000
SALTS = 64


@dataclass
class Tree:
    """children[i]: node numbers below node i (empty: a leaf); centres[i]: their unit vectors, one a row."""

    children: list[list[int]] = field(default_factory=list)
    centres: list[np.ndarray] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def _add(self) -> int:
        self.children.append([])
        self.centres.append(np.empty((0, 0)))
        self.leaf.append(-1)
        return len(self.children) - 1

    def place(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of each vector: at each node on to the nearest centre."""
        out, todo = np.zeros(len(unit), np.int64), [(0, np.arange(len(unit)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            near = (unit[rows] @ self.centres[node].T).argmax(1)
            todo += [(child, rows[near == i]) for i, child in enumerate(self.children[node])]
        return out

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves, best bin first."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            while self.children[node]:
                far = 1.0 - self.centres[node] @ query
                first = int(far.argmin())
                for i, child in enumerate(self.children[node]):
                    if i != first:
                        heapq.heappush(queue, (float(far[i]), child))
                node = self.children[node][first]
            out.append(self.leaf[node])
        return out


def _kmeans(unit: np.ndarray, k: int, rng: np.random.Generator, steps: int = 10) -> tuple[np.ndarray, np.ndarray]:
    centres = unit[rng.choice(len(unit), k, replace=False)]
    for _ in range(steps):
        near = (unit @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, unit)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-12), centres)
    return centres, (unit @ centres.T).argmax(1)


def grow(unit: np.ndarray, leaf_rows: int, branch: int = BRANCH, seed: int = 5) -> Tree:
    """A tree over unit vectors whose leaves hold about ``leaf_rows`` of them."""
    tree, rng = Tree(), np.random.default_rng(seed)
    todo = [(tree._add(), np.arange(len(unit)))]
    while todo:
        node, rows = todo.pop()
        k = min(branch, -(-len(rows) // max(1, leaf_rows)))
        parts: list[np.ndarray] = []
        if k > 1:
            centres, near = _kmeans(unit[rows], k, rng)
            used = [i for i in range(k) if (near == i).any()]
            parts = [rows[near == i] for i in used]
        if len(parts) < 2:
            tree.leaf[node], tree.leaves = tree.leaves, tree.leaves + 1
            continue
        tree.centres[node] = centres[used]
        for part in parts:
            child = tree._add()
            tree.children[node].append(child)
            todo.append((child, part))
    return tree


def _matrix(column: pa.Array | pd.Series) -> np.ndarray:
    values = column.to_pylist() if isinstance(column, pa.Array) else column.tolist()
    return np.array(values, np.float64).reshape(len(values), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    # Scaled by the largest component first: squares neither overflow nor vanish.
    x = x / np.abs(x).max(1, keepdims=True) if len(x) else x
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of q and each row of x in double precision; the same vector always gives the same number.

    Vectors are scaled by a power of two first, which changes no digit, so that squares neither overflow nor vanish.
    """
    q = np.ldexp(q, -np.frexp(np.abs(q).max())[1])
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None]) if len(x) else x
    return (x * q).sum(1) / (np.sqrt((q * q).sum()) * np.sqrt((x * x).sum(1)))


def _best(queries: np.ndarray, x: np.ndarray, least: np.ndarray, k: int, allowed: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the rows of x that may be among its k nearest, and their exact cosines; ``allowed``: which rows count for which query."""
    near = _unit(queries) @ _unit(x).T
    if allowed is not None:
        near[~allowed] = -2.0
    out = []
    for q, row in zip(queries, near, strict=True):
        low = np.partition(row, -k)[-k] - 1e-9 if len(row) > k else -1.5
        at = np.flatnonzero(row >= max(low, -1.5))
        score = cosines(q, x[at])
        keep = np.lexsort((least[at], -score))[:k]
        out.append((at[keep], score[keep]))
    return out


def bundles(counts: dict[int, int], rows: int = BUNDLE_ROWS) -> dict[int, tuple[int, int]]:
    """(first bundle, number of bundles) of each leaf: neighbouring small leaves share one."""
    out, bundle, held = {}, 0, 0
    for leaf in sorted(counts):
        c = counts[leaf]
        if held and held + c > rows:
            bundle, held = bundle + 1, 0
        parts = max(1, -(-c // rows))
        out[leaf] = (bundle, parts)
        if parts > 1:
            bundle, held = bundle + parts, 0
        else:
            held += c
    return out


def entries(vectors: DataFrame, keep: int) -> DataFrame:
    """Distinct usable vectors: (key, v, ids: the smallest ``keep`` vec_ids with exactly this vector).

    Vectors that are null, empty or zero or hold null or non-finite components, and rows without vec_id, are left out.
    """
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(finite & F.exists(v, lambda x: x != 0))
    rows = usable.select(F.col("vec_id").cast("long"), F.col("embedding").alias("v"))
    first = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, keep)
    salted = rows.groupBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).alias("salt")).agg(first(F.collect_list("vec_id")).alias("ids"))
    merged = salted.groupBy("v").agg(first(F.flatten(F.collect_list("ids"))).alias("ids"))
    return merged.select(F.element_at("ids", 1).alias("key"), "v", "ids")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, recall: float = RECALL, sample: int = SAMPLE, calibration: int = CALIBRATION, leaf_rows: int = LEAF_ROWS, block: int = BLOCK_QUERIES) -> DataFrame:
    """The ``k`` nearest of ``vectors`` (vec_id, embedding) found for each row of ``queries`` (the same columns).

    Nearest by cosine in double precision, ties to the smaller vec_id; a query's
    own vec_id is no candidate. Returns (query_id, rank, vec_id, score) with at
    most ``k`` rows a query, fewer if there are fewer other vectors. Unusable
    vectors (see :func:`entries`) take no part, as queries neither; so do
    vectors whose length differs from that of most. Rows that repeat a vec_id
    and vector count once; a vec_id with two vectors takes the nearer. Other columns are
    ignored; an empty table gives no rows.
    """
    need(vectors, ["vec_id", "embedding"])
    need(queries, ["vec_id", "embedding"])
    spark = vectors.sparkSession
    small_batches(spark)
    out = "query_id long, rank int, vec_id long, score double"
    keep = k + 1
    base = stored(entries(vectors, keep), "ann-entries")
    sizes = base.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], out)
    dim, n = sizes[0]["d"], sizes[0]["n"]
    base = base.where(F.size("v") == dim)
    asked = queries.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding")).distinct()
    keyed = entries(queries, 1).where(F.size("v") == dim).select(F.col("key").alias("q"), "v")
    keyed = stored(keyed, "ann-queries")
    # The same blocks for all bundles: a query visits at most all of them, so no block of a bundle holds more than its share of the queries.
    blocks = max(1, -(-keyed.count() // block))
    chosen = base.orderBy(F.xxhash64("key"), "key").limit(sample).select("v").toPandas()
    tree = grow(_unit(_matrix(chosen["v"])), max(2, round(leaf_rows * min(1.0, len(chosen) / n))))
    model = spark.sparkContext.broadcast(tree)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = model.value.place(_unit(_matrix(b.column("v")))) if b.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], ["key", "v", "ids", "leaf"])

    filed = stored(base.mapInArrow(file, "key long, v array<float>, ids array<long>, leaf long".replace("float", dict(base.dtypes)["v"][6:-1])), "ann-leaves")
    visits = _calibrated(filed, keyed, tree, keep, recall, calibration)
    counts = {r["leaf"]: r["n"] for r in filed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # one row a leaf: bounded by the sample
    places = bundles(counts)
    dealt = spark.createDataFrame([(leaf, first, n) for leaf, (first, n) in places.items()], "leaf long, first int, parts int")
    split = filed.join(F.broadcast(dealt), "leaf").withColumn("bundle", F.col("first") + F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    split = split.select("bundle", "leaf", "key", "v", "ids")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, bundle, leaves = [], [], []
            for i, q in enumerate(_unit(_matrix(b.column("v"))) if b.num_rows else ()):
                asked: dict[int, list[int]] = {}
                for x in model.value.visits(q, visits):
                    first, n = places.get(x, (0, 0))
                    for j in range(first, first + n):
                        asked.setdefault(j, []).append(x)
                at += [i] * len(asked)
                bundle += asked.keys()
                leaves += asked.values()
            pick = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("q").take(pick), b.column("v").take(pick), pa.array(bundle, pa.int32()), pa.array(leaves, pa.list_(pa.int64()))], ["q", "v", "bundle", "leaves"])

    routed = keyed.mapInArrow(route, f"q long, v {dict(keyed.dtypes)['v']}, bundle int, leaves array<long>").withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int"))
    # Entries go where a block of queries asks for their bundle, and nowhere else.
    routed = stored(routed, "ann-routes")
    asking = routed.select("bundle", F.col("block").alias("asking")).distinct()
    split = split.join(asking, "bundle").select(F.col("bundle").alias("bundle"), F.col("asking").alias("block"), "leaf", "key", "v", "ids")

    def meet(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "ids": pd.Series(dtype=object), "score": pd.Series(dtype=float)})
        ids, rows, least = x["ids"].to_numpy(), _matrix(x["v"]), x["key"].to_numpy()
        once, of_row = np.unique(x["leaf"].to_numpy(), return_inverse=True)
        names, found_ids, scores = [], [], []
        for at in range(0, len(q), 500):
            some = q.iloc[at : at + 500]
            visited = np.stack([np.isin(once, leaves) for leaves in some["leaves"]])
            for one, (found, score) in zip(some["q"], _best(_matrix(some["v"]), rows, least, keep, visited[:, of_row]), strict=True):
                names += [one] * len(found)
                found_ids += list(ids[found])
                scores += score.tolist()
        return pd.DataFrame({"q": np.array(names, np.int64), "ids": found_ids, "score": np.array(scores, float)})

    met = routed.groupBy("bundle", "block").cogroup(split.groupBy("bundle", "block")).applyInPandas(meet, "q long, ids array<long>, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    near = met.select("q", "score", F.explode("ids").alias("vec_id")).groupBy("q", "vec_id").agg(F.max("score").alias("score"))
    near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)
    # Each row of a query vector takes the list of its vector, without itself.
    listed = near.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found")).join(keyed, "q").select("v", "found")
    rows = asked.join(listed, asked["embedding"] == listed["v"]).where("query_id is not null")
    own = rows.select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    # A query_id that comes with several vectors takes the nearest of all its lists.
    flat = own.select("query_id", F.explode("found").alias("f")).groupBy("query_id", F.col("f.vec_id").alias("vec_id")).agg(F.max("f.score").alias("score"))
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = flat.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _calibrated(filed: DataFrame, keyed: DataFrame, tree: Tree, keep: int, recall: float, most: int) -> int:
    """The fewest leaf visits at which the calibration queries find ``recall`` of their true neighbours."""
    some = keyed.orderBy(F.xxhash64("q", F.lit(1)), "q").limit(most).toPandas()
    if not len(some):
        return 1
    x = _matrix(some["v"])
    held, own = keyed.sparkSession.sparkContext.broadcast(x), some["q"].to_numpy()

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            leaf = b.column("leaf").to_numpy()
            got = _best(held.value, _matrix(b.column("v")), b.column("key").to_numpy(), keep)
            at = np.repeat(np.arange(len(got)), [len(f) for f, _ in got])
            rows = np.concatenate([f for f, _ in got])
            other = b.column("key").to_numpy()[rows] != own[at]  # a query finds itself at the first leaf
            yield pa.RecordBatch.from_arrays([pa.array(at[other]), pa.array(leaf[rows][other]), pa.array(np.concatenate([s for _, s in got])[other])], ["q", "leaf", "score"])

    order = Window.partitionBy("q").orderBy(F.desc("score"), "leaf")
    true = filed.select("key", "v", "leaf").mapInArrow(brute, "q long, leaf long, score double").withColumn("place", F.row_number().over(order)).where(F.col("place") < keep).toPandas()
    places = []
    for q, rows in true.groupby("q"):
        at = {leaf: i for i, leaf in enumerate(tree.visits(_unit(x[q : q + 1])[0], tree.leaves))}
        places += [at[leaf] + 1 for leaf in rows["leaf"]]
    if not places:
        return 1
    places.sort()
    return places[min(len(places) - 1, int(np.ceil(recall * len(places))) - 1)]
