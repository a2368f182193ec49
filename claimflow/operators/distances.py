"""Distances between rows, block against block: all rows of a group meet all others, whatever the group's size.

Rows are dealt into blocks by a hash of their key, each two blocks of a group
meet in one task, and what leaves it are sums, extremes and the nearest few of
each row by label. No pair is ever listed, and a group that holds many rows is
spread over as many tasks as it has pairs of blocks. A row is copied once for
each block of its group, so there are at most COPIES of them and what is
shuffled grows with the rows; a task goes through its two blocks tile by tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import kernels as K

#: Least rows of one side of a pair of blocks (of a tile in it: all); blocks of a group, unless they would pass MOST rows.
BLOCK = 1_000
COPIES, MOST = 16, 50_000
#: Rows of the two sides of a tile.
TILE = (250, 2_000)

#: Bytes of a strip of a whole matrix and of a piece of it at most, and rows whose distances to centres are added up at a time.
STRIP, PIECE, RUN = 112 << 20, 4 << 20, 200

#: Distances of the rows of one block (left) to those of another (right): a matrix.
Measure = Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]


def _stack(rows: pd.DataFrame, name: str) -> np.ndarray:
    return np.stack(rows[name].to_numpy()).astype(float)


def euclidean(name: str, normalised: bool = False) -> Measure:
    """Straight distance of two array columns; normalised: over the root of their length."""

    def measure(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
        x, y = _stack(left, name), _stack(right, name)
        return K.straight(x, y) / (np.sqrt(max(x.shape[1], 1)) if normalised else 1.0)

    return measure


def warped_starts(name: str, n: int) -> Callable[[pd.DataFrame, pd.DataFrame], list[np.ndarray]]:
    """Warped distances of the first ``n`` values of a longer array column, and of the whole of it, in one go."""
    return lambda left, right: K.warped(_stack(left, name), _stack(right, name), starts=(n,))


def warped(name: str, squared: bool = False) -> Measure:
    """Warped distance of two array columns of any, but one, length."""
    return lambda left, right: K.warped(_stack(left, name), _stack(right, name), squared)


def likeness(measure: Measure, scale: float = 1.0) -> Measure:
    """1 / (1 + d / scale) of a distance, or of several at once; 0 where that is not finite."""

    def like(d: np.ndarray) -> np.ndarray:
        d = d / scale
        return np.where(np.isfinite(d), 1.0 / (1.0 + np.maximum(d, 0.0)), 0.0)

    def of(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray | list[np.ndarray]:
        d = measure(left, right)
        return [like(x) for x in d] if isinstance(d, list) else like(d)

    return of


def both_ways(measure: Measure, left: pd.DataFrame, right: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Distances of the left rows to the right ones and of the right ones to the left, of a measure that is not symmetric."""
    of = getattr(measure, "both_ways", None)
    return of(left, right) if of else (measure(left, right), measure(right, left))


def scaled(measure: Measure, low: str | None, high: str, by_right: bool) -> Measure:
    """A (symmetric) distance between its least (0 without ``low``) and largest, which are columns of the right or of the left row; 0 where they agree."""

    def over(d: np.ndarray, left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
        side = right if by_right else left
        a, b = side[low].to_numpy(float) if low else np.zeros(len(side)), side[high].to_numpy(float)
        a, b = (a[None], b[None]) if by_right else (a[:, None], b[:, None])
        return np.where(b > a, (d - a) / np.where(b > a, b - a, 1.0), 0.0)

    def of(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
        return over(measure(left, right), left, right)

    def of_both(left: pd.DataFrame, right: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        d = measure(left, right)
        return over(d, left, right), over(d.T, right, left)

    of.both_ways = of_both
    return of


def fused(first: Measure, second: Measure, alpha: float = 0.3) -> Measure:
    """Root of summed squares of two distances, weighed ``alpha`` and the rest."""
    over = lambda x, y: np.sqrt((alpha * x) ** 2 + ((1 - alpha) * y) ** 2)

    def of(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
        return over(first(left, right), second(left, right))

    def of_both(left: pd.DataFrame, right: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return tuple(over(x, y) for x, y in zip(both_ways(first, left, right), both_ways(second, left, right), strict=True))

    of.both_ways = of_both
    return of


def fused_by_row(warp: str, line: str, alpha: float = 0.3) -> Measure:
    """Warped distance of one column and straight distance of another, each scaled between its {column}_low and {column}_high of the left row, and fused.

    For the nearest few the straight part is worked out for all pairs, and the
    warped one for those whose lower bound does not rule them out.
    """
    of = fused(scaled(warped(warp), f"{warp}_low", f"{warp}_high", False), scaled(euclidean(line), f"{line}_low", f"{line}_high", False), alpha)

    def lazily(left: pd.DataFrame, right: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, Callable]:
        x, y = _stack(left, warp), _stack(right, warp)
        least, straight = K.least_warped(x, y) * (1 - 1e-9) - 1e-12, K.straight(_stack(left, line), _stack(right, line))
        xt, yt = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)

        def unit(d: np.ndarray, side: pd.DataFrame, name: str, at: np.ndarray | slice) -> np.ndarray:
            a, b = (side[f"{name}_{end}"].to_numpy(float)[at] for end in ("low", "high"))
            a, b = (a[:, None], b[:, None]) if d.ndim == 2 else (a, b)
            return np.where(b > a, (d - a) / np.where(b > a, b - a, 1.0), 0.0)

        def bound(w: np.ndarray, e: np.ndarray, side: pd.DataFrame) -> np.ndarray:
            every = slice(None)
            return np.sqrt((alpha * np.maximum(unit(w, side, warp, every), 0.0)) ** 2 + ((1 - alpha) * unit(e, side, line, every)) ** 2) * (1 - 1e-12)

        def exact(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            w, e = np.empty(len(i)), straight[i, j]
            for at in range(0, len(i), 2_048):
                w[at : at + 2_048] = K.warped_of(xt[:, i[at : at + 2_048]], yt[:, j[at : at + 2_048]])
            return tuple(np.sqrt((alpha * unit(w, side, warp, at)) ** 2 + ((1 - alpha) * unit(e, side, line, at)) ** 2) for side, at in ((left, i), (right, j)))

        return bound(least, straight, left), bound(least.T, straight.T, right).T, exact

    of.lazily = lazily
    return of


def _sized(rows: DataFrame, block: int, copies: int | None) -> DataFrame:
    n = F.count("*")
    blocks = F.ceil(n / block)
    if copies is not None:
        blocks = F.greatest(F.least(blocks, F.lit(copies).cast("bigint")), F.ceil(n / max(block, MOST)))
    return rows.groupBy("by").agg(blocks.cast("int").alias("blocks"))


def _own(blocks: str) -> Column:
    return F.pmod(F.xxhash64("key"), F.col(blocks)).cast("int")


def dealt(df: DataFrame, key: str, by: str | None, label: str | None, payload: Sequence[str], block: int = BLOCK, right: DataFrame | None = None, copies: int | None = COPIES) -> DataFrame:
    """Rows copied to the pairs of blocks in which they meet others of their ``by``: (by, one, two, left, on_right, key, label, payload).

    Without ``right`` a table meets itself and each two blocks come once, one <= two.
    Blocks hold ``block`` rows, or more where a group would have more than ``copies`` of them.
    Rows without ``by`` or ``label`` meet none. A pair of blocks is few bytes
    and much to compute, so pairs are dealt over all partitions, whatever their size.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = lambda t: t.select((F.col(by) if by else F.lit(0)).alias("by"), F.col(key).cast("long").alias("key"), (F.col(label) if label else F.lit("")).alias("label"), *payload).where("by is not null and label is not null")
    rows = columns(df)
    if right is None:
        own = rows.join(_sized(rows, block, copies), "by").withColumn("own", _own("blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        one, two = F.least("own", "other"), F.greatest("own", "other")
        met_in = own.select("by", one.alias("one"), two.alias("two"), (F.col("own") == one).alias("left"), (F.col("own") == two).alias("on_right"), "key", "label", *payload)
        return met_in.repartition(parts, "by", "one", "two")
    others = columns(right)
    sizes = _sized(rows, block, copies).withColumnRenamed("blocks", "a").join(_sized(others, block, copies).withColumnRenamed("blocks", "b"), "by")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left_rows = rows.join(sizes, "by").withColumn("one", _own("a")).withColumn("two", every("b"))
    right_rows = others.join(sizes, "by").withColumn("two", _own("b")).withColumn("one", every("a"))
    names = ["by", "one", "two", "left", "on_right", "key", "label", *payload]
    left_rows = left_rows.withColumn("left", F.lit(True)).withColumn("on_right", F.lit(False)).select(*names)
    right_rows = right_rows.withColumn("left", F.lit(False)).withColumn("on_right", F.lit(True)).select(*names)
    return left_rows.unionByName(right_rows).repartition(parts, "by", "one", "two")


class _Kept:
    """What rows keep of their distances to others, by the others' label, gathered tile by tile; rows and others are in order of (label, key)."""

    def __init__(self, rows: pd.DataFrame, others: pd.DataFrame, measures: Sequence[str], stats: Sequence[str], nearest: int):
        self.rows, self.keys, self.nearest, self.stats = rows, others["key"].to_numpy(), nearest, stats
        names = others["label"].to_numpy()
        begin = np.concatenate([[True], names[1:] != names[:-1]])
        self.labels, self.code = names[begin], np.cumsum(begin) - 1
        shape = (len(rows), len(self.labels))
        self.n = np.zeros(shape, np.int64)
        self.kept = {(m, x): np.full(shape, empty) for m in measures for x, empty in (("total", 0.0), ("least", np.inf), ("most", -np.inf)) if x in stats}
        # Row with label, distance and place of the nearest so far, and the distance that a nearer one must not exceed.
        self.near, self.worst = (np.empty(0, int), np.empty(0), np.empty(0, int)), np.full(shape, np.inf)

    def seeds(self, at: slice, to: slice, least: np.ndarray) -> np.ndarray:
        """Of rows ``at`` that lack a nearest few of some label among the others ``to``, the few that may be nearest by what they are ``least`` away."""
        out, code = np.zeros(least.shape, bool), self.code[to]
        for label in np.unique(code):
            part, rows = slice(*np.searchsorted(code, [label, label + 1])), np.flatnonzero(np.isinf(self.worst[at, label]))
            few = min(self.nearest, part.stop - part.start)
            out[rows[:, None], part.start + np.argpartition(least[rows, part], few - 1, axis=1)[:, :few]] = True
        return out & np.isfinite(least)

    def may(self, at: slice, to: slice, least: np.ndarray) -> np.ndarray:
        """Pairs of rows ``at`` and others ``to`` that may be among the nearest, by what they are ``least`` away."""
        return (least <= self.worst[at][:, self.code[to]]) & np.isfinite(least)

    def add(self, at: slice, to: slice, ok: np.ndarray | None, found: dict[str, np.ndarray], count: bool = True) -> None:
        """Distances of rows ``at`` to the others ``to``; ``ok`` marks those that count (all, if None), unless they were counted before."""
        code = self.code[to]
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        parts = [(code[a], slice(a, b)) for a, b in zip(starts, [*starts[1:], len(code)], strict=True)]
        here = at, slice(code[0], code[-1] + 1)
        # Long runs of one label are quicker one by one.
        over = lambda f, v: f.reduceat(v, starts, axis=1) if len(parts) > len(code) // 32 else np.stack([f.reduce(v[:, part], axis=1) for _, part in parts], 1)
        if count:
            self.n[here] += np.bincount(code - code[0]) if ok is None else over(np.add, ok.astype(np.int64))
        for m, d in found.items():
            for x, empty, f in (("total", 0.0, np.add), ("least", np.inf, np.minimum), ("most", -np.inf, np.maximum)):
                if x in self.stats:
                    kept = self.kept[m, x]
                    kept[here] = f(kept[here], over(f, d if ok is None else np.where(ok, d, empty)))
        if self.nearest:
            d = next(iter(found.values()))
            self._nearer(at, to, d if ok is None else np.where(ok, d, np.inf), parts)

    def _nearer(self, at: slice, to: slice, d: np.ndarray, parts: list[tuple[int, slice]]) -> None:
        k, size, more = self.nearest, len(self.labels), []
        for label, part in parts:
            v, most = d[:, part], self.worst[at, label]
            if v.shape[1] > k and np.isinf(most).any():
                most = np.minimum(most, np.partition(v, k - 1, axis=1)[:, k - 1])
            i, j = np.nonzero((v <= most[:, None]) & (v < np.inf))
            more.append(((i + at.start) * size + label, v[i, j], j + part.start + to.start))
        group, far, place = (np.concatenate(x) for x in zip(*more, strict=True))
        if not len(group):
            return
        # Only rows and labels that something new is near to are put in order again.
        new = np.zeros(len(self.rows) * size, bool)
        new[group] = True
        again = new[self.near[0]]
        group, far, place = (np.concatenate([x[again], y]) for x, y in zip(self.near, (group, far, place), strict=True))
        order = np.lexsort((self.keys[place], far, group))
        group, far, place = group[order], far[order], place[order]
        first = np.concatenate([[True], group[1:] != group[:-1]])
        rank = np.arange(len(group)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        self.near = tuple(np.concatenate([x[~again], y[rank < k]]) for x, y in zip(self.near, (group, far, place), strict=True))
        full = rank == k - 1
        self.worst.ravel()[group[full]] = far[full]

    def table(self) -> pd.DataFrame:
        row, label = np.nonzero(self.n)
        out = {"key": self.rows["key"].to_numpy()[row], "label": self.rows["label"].to_numpy()[row], "other_label": self.labels[label], "n": self.n[row, label]}
        out |= {f"{m}_{x}": v[row, label] for (m, x), v in self.kept.items()}
        if self.nearest:
            group, far, place = self.near
            order = np.lexsort((self.keys[place], far, group))
            group, far, near_k = group[order], far[order], self.keys[place[order]]
            low, high = (np.searchsorted(group, row * len(self.labels) + label, side) for side in ("left", "right"))
            out |= {"near_d": [far[a:b] for a, b in zip(low, high, strict=True)], "near_k": [near_k[a:b] for a, b in zip(low, high, strict=True)]}
        return pd.DataFrame(out)


def met(
    df: DataFrame,
    key: str,
    label: str,
    payload: Sequence[str],
    measures: dict[str | tuple[str, ...], Measure],
    by: str | None = None,
    nearest: int = 0,
    block: int = BLOCK,
    right: DataFrame | None = None,
    symmetric: bool = True,
    stats: Sequence[str] = ("total", "least", "most"),
) -> DataFrame:
    """(key, label, other_label, n, for each measure its _total, _least and _most as ``stats`` names them, near): every row against the others, itself left out.

    ``by`` restricts it to rows of one group, ``right`` makes them meet another
    table. ``measures`` that look at columns of one side only are not
    ``symmetric``; one that gives several matrices has a tuple of names.
    ``near`` lists the ``nearest`` others by the first measure as (distance,
    other), ties to the smaller key. Rows of one key do not meet.
    """
    types = dict(df.dtypes) if right is None else dict(right.dtypes)
    flat = [m for k in measures for m in ([k] if isinstance(k, str) else k)]
    stats = [x for x in ("total", "least", "most") if x in stats]
    schema = f"key long, label {dict(df.dtypes)[label]}, other_label {types[label]}, n long" + "".join(f", {m}_{x} double" for m in flat for x in stats) + (", near_d array<double>, near_k array<bigint>" if nearest else "")
    names, alone = [x.split(" ")[0] for x in schema.split(", ")], right is None
    # Where only the nearest are asked for, a measure that knows lower bounds is worked out for few pairs.
    lazy = getattr(next(iter(measures.values())), "lazily", None) if nearest and not stats and len(flat) == 1 else None

    def of(a: pd.DataFrame, b: pd.DataFrame) -> dict[str, np.ndarray]:
        found = {}
        for k, f in measures.items():
            found |= {k: f(a, b)} if isinstance(k, str) else dict(zip(k, f(a, b), strict=True))
        return found

    def meet(t: pd.DataFrame) -> pd.DataFrame:
        a, b = (t[t[side]].sort_values(["label", "key"], kind="stable") for side in ("left", "on_right"))
        if not len(a) or not len(b):
            return pd.DataFrame({c: [] for c in names})
        apart = alone and t["one"].iloc[0] != t["two"].iloc[0]
        ours, theirs = _Kept(a, b, flat, stats, nearest), _Kept(b, a, flat, stats, nearest) if apart else None
        x, y = a["key"].to_numpy(), b["key"].to_numpy()
        # A block against itself, both ways at once: its tiles on and above the diagonal.
        half = alone and not apart and symmetric and not lazy
        for i in range(0, len(a), TILE[0]):
            at = slice(i, min(i + TILE[0], len(a)))
            for j in [i, *range(at.stop, len(b), TILE[1])] if half else range(0, len(b), TILE[1]):
                to = at if half and j == i else slice(j, min(j + TILE[1], len(b)))
                p, q = a.iloc[at], b.iloc[to]
                # Two blocks of one table share no key.
                ok = None if apart else x[at, None] != y[None, to]
                if lazy:
                    there, back, exact = lazy(p, q)
                    if not apart:
                        there = np.where(ok, there, np.inf)
                    seen = None
                    # A few that may be nearest give limits, and most of the others then lie beyond them.
                    for ask in ("seeds", "may"):
                        want = getattr(ours, ask)(at, to, there)
                        if theirs:
                            want |= getattr(theirs, ask)(to, at, back.T).T
                        want = want if seen is None else want & ~seen
                        i, j = np.nonzero(want)
                        one_way, other_way = (np.full(want.shape, np.inf) for _ in range(2))
                        one_way[i, j], other_way[i, j] = exact(i, j)
                        ours.add(at, to, ok, {flat[0]: one_way}, seen is None)
                        if theirs:
                            theirs.add(to, at, None, {flat[0]: other_way.T}, seen is None)
                        seen = want
                    continue
                if theirs and not symmetric:
                    pairs = {m: both_ways(f, p, q) for m, f in measures.items()}
                    ours.add(at, to, ok, {m: v for m, (v, _) in pairs.items()})
                    theirs.add(to, at, None, {m: v for m, (_, v) in pairs.items()})
                    continue
                found = of(p, q)
                ours.add(at, to, ok, found)
                if theirs:
                    theirs.add(to, at, None, {m: v.T for m, v in found.items()})
                elif half and j > i:
                    ours.add(to, at, ok.T, {m: v.T for m, v in found.items()})
        return pd.concat([x.table() for x in (ours, theirs) if x])[names]

    out = dealt(df, key, by, label, payload, block, right).groupBy("by", "one", "two").applyInPandas(meet, schema)
    f = {"total": F.sum, "least": F.min, "most": F.max}
    parts = [F.sum("n").alias("n")] + [f[x](f"{m}_{x}").alias(f"{m}_{x}") for m in flat for x in stats]
    if nearest:
        parts.append(F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip(F.col("near_d").alias("distance"), F.col("near_k").alias("other"))))), 1, nearest).alias("near"))
    return out.groupBy("key", "label", "other_label").agg(*parts)


def near_mean() -> Column:
    """Mean distance of the nearest few that :func:`met` lists."""
    return C.array_mean(F.transform("near", lambda x: x["distance"]))


def warped_neighbours(df: DataFrame, key: str, vector: str, label: str, k: int = 3, block: int = BLOCK) -> DataFrame:
    """(key, label, near): the ``k`` nearest of each row among the others of its label by warped distance, without warping most pairs.

    Lower bounds come first: of two series their ends always meet, and each
    value costs at least what it lies outside the other's range. Only pairs
    whose bound is within the distance of the k-th so far are warped, and
    those are given up as soon as they exceed it.
    """

    def meet(t: pd.DataFrame) -> pd.DataFrame:
        a, b = (t[t[side]].sort_values("key", kind="stable") for side in ("left", "on_right"))
        parts = [pd.DataFrame({c: [] for c in ("key", "label", "near_d", "near_k")})]
        for x, y in ((a, b),) if t["one"].iloc[0] == t["two"].iloc[0] else ((a, b), (b, a)):
            if len(x) and len(y):
                others, keys, v, w = y["key"].to_numpy(), x["key"].to_numpy(), _stack(x, vector), _stack(y, vector)
                # Some rows against the whole block, so that what they have found gives up the more pairs.
                tall = max(1, min(len(x), BLOCK * BLOCK // len(y)))
                found = [one for i in range(0, len(x), tall) for one in K.nearest_warped(v[i : i + tall], w, k, keys[i : i + tall, None] == others[None])]
                parts.append(pd.DataFrame({"key": x["key"], "label": x["label"], "near_d": [d for _, d in found], "near_k": [others[at] for at, _ in found]}))
        return pd.concat(parts[1:] or parts)

    out = dealt(df, key, label, label, [vector], block).groupBy("by", "one", "two").applyInPandas(meet, f"key long, label {dict(df.dtypes)[label]}, near_d array<double>, near_k array<bigint>")
    near = F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip(F.col("near_d").alias("distance"), F.col("near_k").alias("other"))))), 1, k)
    return out.groupBy("key", "label").agg(near.alias("near"))


def drawn(df: DataFrame, key: str, label: str, most: int, seed: str = "drawn") -> DataFrame:
    """At most ``most`` rows of each label, drawn by a keyed hash: the bounded sample of templates that a caller may ask for."""
    order = Window.partitionBy(label).orderBy(F.xxhash64(F.lit(seed), key), key)
    return df.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= most).drop("__r")


def silhouette(by_label: DataFrame, noise: str | None = None, measure: str = "dist") -> DataFrame:
    """Mean silhouette (and number) of the rows of :func:`met` over all labels; rows labelled ``noise`` are left out on both sides."""
    if noise is not None:
        by_label = by_label.where((F.col("label") != noise) & (F.col("other_label") != noise))
    mean, own = F.col(f"{measure}_total") / F.col("n"), F.col("label") == F.col("other_label")
    one = by_label.groupBy("key").agg(F.min(F.when(own, mean)).alias("a"), F.min(F.when(~own, mean)).alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return one.agg(F.avg(s).alias("silhouette"), F.count("*").alias("n"))


def medoids(within: DataFrame, total: str = "dist_total") -> DataFrame:
    """(label, medoid, total_distance): the row of each label with the least summed distance to the others, ties to the smaller key."""
    best = within.groupBy("label").agg(F.min(F.struct(total, "key")).alias("b"))
    return best.select("label", F.col("b.key").alias("medoid"), F.col(f"b.{total}").alias("total_distance"))


# -- a whole matrix in tiles ---------------------------------------------------


def tiles(df: DataFrame, key: str, payload: Sequence[str], measure: Measure, block: int = BLOCK) -> DataFrame:
    """(rows, cols, row_keys, cells): the matrix of ``measure`` cut into tiles, keys ascending inside a block, 0 on the diagonal.

    ``measure`` may look at columns of one side, so both tiles of two blocks are made.
    """

    def meet(t: pd.DataFrame) -> pd.DataFrame:
        one, two = int(t["one"].iloc[0]), int(t["two"].iloc[0])
        a, b = (t[t[side]].sort_values("key", kind="stable") for side in ("left", "on_right"))
        if not len(a) or not len(b):
            return pd.DataFrame({c: [] for c in ("rows", "cols", "row_keys", "cells")})
        x, y = a["key"].to_numpy(), b["key"].to_numpy()
        if one == two:
            out = [(one, two, x, np.where(x[:, None] == y[None], 0.0, measure(a, b)).tobytes())]
        else:
            # Two blocks share no key.
            there, back = both_ways(measure, a, b)
            out = [(one, two, x, there.tobytes()), (two, one, y, back.tobytes())]
        return pd.DataFrame(out, columns=["rows", "cols", "row_keys", "cells"])

    return dealt(df, key, None, None, payload, block, copies=None).groupBy("by", "one", "two").applyInPandas(meet, "rows int, cols int, row_keys array<bigint>, cells binary")


def _strips(matrix: DataFrame, sizes: dict[int, int], width: int) -> DataFrame:
    """(strip, cells): a matrix in :func:`tiles` cut into strips of ``width`` columns and all rows, blocks and rows in order; a strip comes in pieces, column by column."""
    begin = dict(zip(sizes, np.cumsum([0, *sizes.values()]).tolist(), strict=False))
    n = sum(sizes.values())

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, j, cells in zip(b["rows"], b["cols"], b["cells"], strict=True):
                x, at = np.frombuffer(cells).reshape(sizes[i], sizes[j]), begin[j]
                while at < begin[j] + sizes[j]:
                    to = min((at // width + 1) * width, begin[j] + sizes[j])
                    yield pd.DataFrame({"strip": [at // width], "row": [begin[i]], "col": [at % width], "cells": [x[:, at - begin[j] : to - begin[j]].tobytes()], "n": [sizes[i]]})
                    at = to

    def joined(t: pd.DataFrame) -> pd.DataFrame:
        strip = int(t["strip"].iloc[0])
        x, few = np.empty((min(width, n - strip * width), n)), max(1, PIECE // (8 * n))
        for i, j, cells, rows in zip(t["row"], t["col"], t["cells"], t["n"], strict=True):
            part = np.frombuffer(cells).reshape(rows, -1)
            x[j : j + part.shape[1], i : i + rows] = part.T
        return pd.DataFrame({"strip": strip, "cells": [x[at : at + few].tobytes() for at in range(0, len(x), few)]})

    return matrix.select("rows", "cols", "cells").mapInPandas(cut, "strip int, row long, col int, cells binary, n int").groupBy("strip").applyInPandas(joined, "strip int, cells binary")


def kmeans_rows(matrix: DataFrame, k: int, starts: int = 20, most_rounds: int = 100, store: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """(key, state): k-means on the rows of a matrix in :func:`tiles`, the best of ``starts`` by its cost; states are numbered by their least key.

    A row of the matrix is as long as the table and is never put together: the
    matrix is kept in strips of columns, a strip gives its columns of the
    centres and at once its part of the products of all rows and these
    centres, and the parts are added up by rows. So a round reads the matrix
    once and moves none of it; what each strip is sent are the rows' states (a
    byte a row and start). A start begins with the ``k`` rows that come first by a
    hash of (key, start), and is done when its states stay as they are. A state that
    loses all rows is gone. What the driver sees is as large as ``starts``
    times ``k``, and a number for each block of rows.
    """
    from ..session import stored

    store = store or stored
    matrix = store(matrix, "tiles")
    blocks = matrix.where("rows = cols").select(F.col("rows").alias("block"), "row_keys")
    sizes = {r["block"]: r["n"] for r in blocks.select("block", F.size("row_keys").alias("n")).orderBy("block").collect()}
    n = sum(sizes.values())
    # A strip for each core, or more and smaller ones.
    width = max(1, min(-(-n // matrix.sparkSession.sparkContext.defaultParallelism), STRIP // (8 * max(n, 1))))
    strips = stored(_strips(matrix, sizes, width), "strips", maxRecordsPerFile=str(-(-width // max(1, PIECE // (8 * max(n, 1))))), compression="none")
    kind = np.int8 if k < 128 else np.int16

    def first_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for keys, hashes in zip(b["row_keys"], b["hashes"], strict=True):
                h = np.stack(hashes)
                for s in range(starts):
                    at = np.lexsort((keys, h[:, s]))[:k]
                    yield pd.DataFrame({"start": s, "h": h[at, s], "key": keys[at]})

    hashes = F.transform("row_keys", lambda x: F.transform(F.sequence(F.lit(0), F.lit(starts - 1)), lambda s: F.xxhash64(x, s)))
    few = blocks.select("row_keys", hashes.alias("hashes")).mapInPandas(first_rows, "start int, h long, key long")
    # Some rows of each block are ranked, not all.
    ranked = few.withColumn("slot", F.row_number().over(Window.partitionBy("start").orderBy("h", "key")) - 1).where(F.col("slot") < k)
    chosen = {(r["start"], r["key"]): r["slot"] for r in ranked.collect()}

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block, keys in zip(b["block"], b["row_keys"], strict=True):
                codes = np.array([[chosen.get((s, int(x)), -1) for x in keys] for s in range(starts)], kind)
                for at in range(0, len(keys), RUN):
                    yield pd.DataFrame({"block": block, "run": at // RUN, "start": range(starts), "codes": [c[at : at + RUN].tobytes() for c in codes], "cost": 0.0})

    def products(active: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Of the strips of a task their part of the squared distances of rows to centres, less what is the same for all centres."""
        slots = len(active) * k

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            member, far, runs = None, None, []
            for b in batches:
                if member is None:
                    codes = {(g["block"], g["run"], g["start"]): np.frombuffer(g["codes"], kind) for g in b["given"][0].as_py()}
                    runs = sorted({(block, run) for block, run, _ in codes})
                    told = np.stack([np.concatenate([codes[block, run, s] for block, run in runs]) for s in active], 1)
                    member = (told[:, :, None] == np.arange(k, dtype=kind)).reshape(len(told), slots).astype(float)
                    number, lengths = member.sum(0), [len(codes[block, run, active[0]]) for block, run in runs]
                    far = np.zeros((len(told), slots))
                # Columns of the matrix, one after another.
                x = np.concatenate([np.frombuffer(c.as_buffer()) for c in b["cells"]]).reshape(-1, len(member))
                centre = (x @ member) / np.maximum(number, 1)
                far += np.where(number > 0, (centre**2).sum(0), np.inf) - 2 * (x.T @ centre)
            if runs:
                ends = np.cumsum(lengths)
                yield pa.RecordBatch.from_pydict({"block": pa.array([r[0] for r in runs], pa.int32()), "run": pa.array([r[1] for r in runs], pa.int32()), "part": pa.array([far[e - m : e].tobytes() for e, m in zip(ends, lengths, strict=True)], pa.binary())})

        return of

    def nearest(active: list[int]) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def of(t: pd.DataFrame) -> pd.DataFrame:
            total = np.frombuffer(t["part"].iloc[0]).copy()
            for x in t["part"].iloc[1:]:
                total += np.frombuffer(x)
            d = total.reshape(-1, len(active), k)
            return pd.DataFrame({"block": t["block"].iloc[0], "run": t["run"].iloc[0], "start": active, "codes": [c.tobytes() for c in d.argmin(2).T.astype(kind)], "cost": d.min(2).sum(0)})

        return of

    schema, marks, done, active = "block int, run int, start int, codes binary, cost double", {}, {}, list(range(starts))
    codes = store(blocks.mapInPandas(begin, schema), "codes")
    for _ in range(most_rounds if n else 0):
        given = codes.where(F.col("start").isin(active)).agg(F.collect_list(F.struct("block", "run", "start", "codes")).alias("given"))
        parts = strips.select("cells").crossJoin(F.broadcast(given)).mapInArrow(products(active), "block int, run int, part binary")
        codes = store(parts.groupBy("block", "run").applyInPandas(nearest(active), schema), "codes")
        told = codes.groupBy("start").agg(F.sum(F.xxhash64("block", "run", "codes").cast("decimal(38,0)")).alias("mark"), F.sum("cost").alias("cost")).collect()
        done |= {r["start"]: (r["cost"], codes) for r in told}
        active = sorted(r["start"] for r in told if r["mark"] != marks.get(r["start"]))
        marks = {r["start"]: r["mark"] for r in told}
        if not active:
            break
    best = min(done, key=lambda s: (done[s][0], s), default=0)
    codes = (done[best][1] if done else codes).where(F.col("start") == best)

    def of_block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for keys, runs in zip(b["row_keys"], b["runs"], strict=True):
                yield pd.DataFrame({"key": keys, "slot": np.concatenate([np.frombuffer(x["codes"], kind).astype(np.int32) for x in runs])})

    runs = codes.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("run", "codes"))).alias("runs"))
    rows = blocks.join(runs, "block").select("row_keys", "runs").mapInPandas(of_block, "key long, slot int")
    order = rows.groupBy("slot").agg(F.min("key").alias("first")).withColumn("state", (F.row_number().over(Window.orderBy("first")) - 1).cast("int"))
    return rows.join(F.broadcast(order), "slot").select("key", "state")
