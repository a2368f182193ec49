"""Near-duplicate groups by SimHash and pivot distance tables.

A text's word shingles vote on the bits of its fingerprint. Fingerprints are
cut into blocks of bits, and for each block the Hamming distances to several
fixed reference fingerprints (pivots) are tabulated. Two fingerprints that
differ in few bits agree in all pivot distances of several blocks; these tuples
are the join keys that bring candidates together. Where links are held against
the similarity of shingle sets, the keys come from minima of the sets under
hash functions instead. Within a key the pairs whose
pivot distances over the whole fingerprint differ by more than the bound in any
coordinate are discarded (triangle inequality), and survivors are verified on
their true Hamming distance. Links become groups by distributed connected
components; fingerprints, links and groups never reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import free_prefix, need, small_batches, stored, text_or_empty
from .components import connected_components

#: A run of equal keys up to this length reports each of its links; a longer one reports a spanning forest of them.
SHORT_RUN = 32
#: Rows of one key that meet in one task at most. A key with more is dealt into chunks, and each two chunks meet in a task.
LONGEST_RUN = 20_000
#: Shingle sets that meet in one task at most, likewise.
LONGEST_SETS = 800
#: Places over which the members of one cluster are dealt where they meet what is known of the cluster.
SALTS = 64
KEEP_SALTS = 16


@dataclass(frozen=True)
class Scheme:
    """What is fingerprinted and when fingerprints link.

    ``shingle`` words vote on 64 * ``words`` bits that count for the distance.
    ``distinct``: a repeated shingle votes once. ``blocks`` blocks of the bits
    are joined ``together`` at a time. With ``bands`` the join keys are as many
    hashes of ``minima`` minima of the shingle set each, and the fingerprint
    ends in a digest of the set, so that only equal sets share one. With
    ``cosine`` links are also held against the true similarity of their
    shingle sets: the shared shingles by the geometric mean of the sizes.
    """

    shingle: int = 3
    words: int = 1
    distinct: bool = False
    most_bits: int = 3
    blocks: int = 6
    together: int = 3
    bands: int = 0
    minima: int = 0
    pivots: int = 16
    block_pivots: int = 5
    seed: int = 42
    cosine: float = 0.0

    @property
    def width(self) -> int:
        return self.words + bool(self.bands)

    def combos(self) -> list[tuple[int, ...]]:
        return list(combinations(range(self.blocks), self.together))

    def masks(self) -> np.ndarray:
        """One row of key words for each block."""
        n = 64 * self.words
        out = np.zeros((self.blocks, n // 64), np.uint64)
        for bit in range(n):
            out[bit * self.blocks // n, bit // 64] |= np.uint64(1) << np.uint64(bit % 64)
        return out

    def references(self, n: int, words: int) -> np.ndarray:
        return np.random.default_rng(self.seed).integers(0, 2**64, (n, words), np.uint64)


#: Exact for its bound: of six blocks at most three can hold the three differing bits, so three others agree.
THREE_BITS = Scheme()

#: Five-word shingles, and a cosine of the sets of them of 0.8 or more: the similarity that SimHash estimates, and one that no pair with a
#: Jaccard similarity of 0.8 fails. At exactly 0.8 the Jaccard similarity is from 0.64 (one set holds the other) to 0.67 (equal sizes), and a pair
#: shares one of the 32 keys of four minima but for a chance of (1 - 0.64^4)^32 = 0.003 at worst. Large sets of that cosine differ in 52 of 256
#: bits on average (standard deviation 6.5), so 84 bits lose one such pair in 2e6. What links is checked on the sets.
NEAR_80 = Scheme(shingle=5, words=4, distinct=True, most_bits=84, bands=32, minima=4, pivots=16, cosine=0.8)


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Further 64-bit words from a hash (the finaliser of splitmix64)."""
    z = h + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _vote(h: np.ndarray) -> int:
    """The bits set in over half of the hashes; no hash: zero."""
    n, total = len(h), np.zeros(64, np.int64)
    for at in range(0, n, 255 * 64):
        bits = np.unpackbits(h[at : at + 255 * 64].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        lanes = bits.view(np.uint64)  # eight counters of a byte each in a lane; 255 rows cannot overflow one
        for k in range(0, len(lanes), 255):
            total += np.add.reduce(lanes[k : k + 255], axis=0).view(np.uint8)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 with seed 42 of the ``k``-word shingles, repeats included; fewer words: of all of them together."""
    if not words:
        return np.empty(0, np.uint64)
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([hashed(joined, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-k]]).tolist()
    return np.array([hashed(joined[a:b], 42) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)], np.uint64)


@cache
def _factors(scheme: Scheme) -> np.ndarray:
    return np.random.default_rng(scheme.seed).integers(0, 2**64, (scheme.bands * scheme.minima, 1), np.uint64) | np.uint64(1)


def band_keys(h: np.ndarray, scheme: Scheme) -> np.ndarray:
    """The join keys of a set of shingle hashes: each mixes its own few minima of the set under multiplication by odd factors."""
    factors = _factors(scheme)
    least = np.full(len(factors), 2**64 - 1, np.uint64)
    for at in range(0, len(h), 512):
        least = np.minimum(least, (factors * h[at : at + 512]).min(1))
    key = np.arange(1, scheme.bands + 1, dtype=np.uint64)
    for k, column in enumerate(least.reshape(scheme.bands, scheme.minima).T):
        key = _mixed(key ^ column, k + 1)
    return key


def _print_and_keys(text: str | None, scheme: Scheme) -> tuple[bytes, bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = shingle_hashes(words, scheme.shingle)
    if scheme.distinct:
        h = np.unique(h)
    out = [_vote(h if not i else _mixed(h, i)) for i in range(scheme.words)]
    if not scheme.bands:
        return np.array(out, "<u8").tobytes(), b""
    out.append(xxhash.xxh64_intdigest(h.tobytes(), 42))
    return np.array(out, "<u8").tobytes(), band_keys(h, scheme).astype("<u8").tobytes()


def fingerprint(text: str | None, scheme: Scheme = THREE_BITS) -> bytes:
    """Little-endian words; ASCII letters count as lower case, words are split at ASCII white space."""
    return _print_and_keys(text, scheme)[0]


def fingerprints(docs: DataFrame, scheme: Scheme = THREE_BITS) -> DataFrame:
    """(doc_id, text_hash long, fp binary, and with bands keys binary) for every row; null text counts as empty and has the zero fingerprint."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "text_hash", "fp", *(["keys"] if scheme.bands else [])]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [_print_and_keys(t.as_py(), scheme) for t in b.column(1)]
            columns = [b.column(0), b.column(2), *(pa.array([x[k] for x in both], pa.binary()) for k in range(len(names) - 2))]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64(text_or_empty()))
    return rows.mapInArrow(each, "doc_id long, text_hash long, fp binary" + (", keys binary" if scheme.bands else ""))


def _words(fp: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(fp.to_pylist()), "<u8").reshape(-1, width).astype(np.uint64)


def pivot_keys(fps: np.ndarray, scheme: Scheme) -> np.ndarray:
    """The join keys of each fingerprint: a row of them, one for each combination of blocks."""
    refs = scheme.references(scheme.block_pivots, fps.shape[1])
    tables = []
    for mask in scheme.masks():
        packed = np.zeros(len(fps), np.uint64)
        for ref in refs:
            packed = (packed << np.uint64(5)) | np.bitwise_count((fps ^ ref) & mask).sum(1, dtype=np.uint64)
        tables.append(packed)
    out = np.empty((len(fps), len(combos := scheme.combos())), np.uint64)
    for c, combo in enumerate(combos):
        key = np.full(len(fps), c + 1, np.uint64)
        for block in combo:
            key = _mixed(key ^ tables[block], block + 1)
        out[:, c] = key
    return out


def _near(table: np.ndarray, fps: np.ndarray, a: np.ndarray, b: np.ndarray, scheme: Scheme) -> np.ndarray:
    """Which of the pairs a, b (row numbers) survive the pivot table and then are near in truth."""
    keep = np.flatnonzero(np.abs(table[a] - table[b]).max(1) <= scheme.most_bits) if len(a) else np.empty(0, int)
    far = np.bitwise_count(fps[a[keep], : scheme.words] ^ fps[b[keep], : scheme.words]).sum(1)
    return keep[far <= scheme.most_bits]


def pivot_table(fps: np.ndarray, scheme: Scheme) -> np.ndarray:
    """Hamming distances of each fingerprint to the reference fingerprints."""
    refs = scheme.references(scheme.pivots, scheme.words)
    return np.stack([np.bitwise_count(fps[:, : scheme.words] ^ r).sum(1) for r in refs], 1).astype(np.int16)


def _forest(ids: np.ndarray, fps: np.ndarray, table: np.ndarray, scheme: Scheme) -> list[tuple[int, int]]:
    """Links that connect what the near pairs of one long run connect: at most one for each member."""
    left, edges = np.arange(len(ids)), []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            hit = _near(table, fps, np.full(len(left), x), left, scheme)
            if len(hit):
                edges += [(int(ids[x]), int(ids[y])) for y in left[hit]]
                front += left[hit].tolist()
                left = np.delete(left, hit)
    return edges


def run_links(key: np.ndarray, ids: np.ndarray, fps: np.ndarray, scheme: Scheme) -> list[tuple[int, int, bool]]:
    """Links (a, b, from a long run) among rows of equal key; the rows come in the order of their keys."""
    new = np.flatnonzero(np.diff(key)) + 1
    starts, ends = np.concatenate([[0], new]), np.concatenate([new, [len(key)]])
    wide = ends - starts > 1
    starts, ends = starts[wide], ends[wide]
    if not len(starts):
        return []
    table, edges = pivot_table(fps, scheme), []
    for s, e in zip(starts[ends - starts > SHORT_RUN], ends[ends - starts > SHORT_RUN], strict=True):
        edges += [(a, b, True) for a, b in _forest(ids[s:e], fps[s:e], table[s:e], scheme)]
    short = ends - starts <= SHORT_RUN
    starts, ends = starts[short], ends[short]
    rows = np.concatenate([np.arange(s, e) for s, e in zip(starts, ends, strict=True)]) if len(starts) else np.empty(0, int)
    last = np.repeat(ends, ends - starts)
    for step in range(1, SHORT_RUN):
        on = rows + step < last
        rows, last = rows[on], last[on]
        if not len(rows):
            break
        hit = _near(table, fps, rows, rows + step, scheme)
        edges += [(a, b, False) for a, b in zip(ids[rows[hit]].tolist(), ids[rows[hit] + step].tolist(), strict=True)]
    return edges


def near_links(nodes: DataFrame, scheme: Scheme = THREE_BITS, longest: int = LONGEST_RUN) -> DataFrame:
    """Links (a, b, far_reaching) between rows of ``nodes`` (id long, fp binary, and with bands keys binary; each fp once).

    A key's rows are sorted together, never crossed: a run of up to SHORT_RUN
    rows reports its near pairs, a longer one a spanning forest of them. A run
    holds ``longest`` rows at most: a key with more is counted first and its
    rows dealt into chunks that meet two by two. Equal fingerprints were merged before.
    """
    spark = nodes.sparkSession
    width = scheme.width

    def keys_of(b: pa.RecordBatch) -> np.ndarray:
        return _words(b.column(2), scheme.bands) if scheme.bands else pivot_keys(_words(b.column(1), width), scheme)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = keys_of(b)
                again = pa.array(np.repeat(np.arange(b.num_rows), keys.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), *(c.take(again) for c in b.columns[:2])], ["key", "id", "fp"])

    def keys_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(keys_of(b).ravel().view(np.int64))], ["key"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key, ids, fps):
            edges = run_links(key, ids, fps, scheme)
            a, b, far = zip(*edges, strict=True) if edges else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(far, pa.bool_())], ["a", "b", "far_reaching"])

        parts = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, width), np.uint64))]
        for b in batches:
            if not b.num_rows:
                continue
            parts.append((b.column(0).to_numpy(), b.column(1).to_numpy(), _words(b.column(2), width)))
            if parts[-1][0][0] == parts[-1][0][-1]:
                continue  # one key so far: its run goes on
            key, *rest = (np.concatenate(x) for x in zip(*parts, strict=True))
            cut = int(np.flatnonzero(key != key[-1])[-1]) + 1
            yield out(key[:cut], *(x[:cut] for x in rest))
            parts = [(key[cut:].copy(), *(x[cut:].copy() for x in rest))]
        yield out(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    small_batches(spark)
    source = nodes.select("id", "fp", *(["keys"] if scheme.bands else []))
    rows = source.mapInArrow(keyed, "key long, id long, fp binary")
    counts = source.mapInArrow(keys_only, "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > longest)
    hot = stored(counts.select("key", F.ceil(F.col("n") * 2 / longest).cast("int").alias("chunks")), "hot-keys")
    if not hot.isEmpty():
        own = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
        met = F.when(F.col("chunks").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
        dealt = rows.join(hot, "key", "left").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
        rows = dealt.select(met.alias("key"), "id", "fp")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(linked, "a long, b long, far_reaching boolean")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "far_reaching").groupBy("a", "b").agg(F.max("far_reaching").alias("far_reaching"))


def _shingle_sets(docs: DataFrame, nodes: DataFrame, links: DataFrame, scheme: Scheme) -> DataFrame:
    """(id, held): the sorted shingle hashes of every node that has a link."""
    ends = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).distinct()
    asked = ends.join(nodes.select("id", F.col("text_hash").alias("asked")), "id")
    texts = docs.select("text", F.xxhash64(text_or_empty()).alias("text_hash")).join(asked.hint("shuffle_hash"), F.col("text_hash") == F.col("asked")).select("id", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [np.unique(shingle_hashes((t.as_py() or "").encode("utf-8", "surrogatepass").lower().split(), scheme.shingle)).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.binary())], ["id", "held"])

    small_batches(docs.sparkSession)
    return stored(texts.mapInArrow(sets, "id long, held binary").dropDuplicates(["id"]), "shingle-sets")


def _compared(links: DataFrame, held: DataFrame) -> DataFrame:
    """``links`` with the true similarity of the two shingle sets as ``likeness``."""
    both = links.join(held.select(F.col("id").alias("a"), F.col("held").alias("left")), "a").join(held.select(F.col("id").alias("b"), F.col("held").alias("right")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            likeness = []
            for x, y in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                shared = len(np.intersect1d(x, y, assume_unique=True))
                likeness.append(shared / (len(x) * len(y)) ** 0.5 if len(x) and len(y) else float(len(x) == len(y)))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(likeness, pa.float64())], ["a", "b", "far_reaching", "likeness"])

    return stored(both.select("a", "b", "far_reaching", "left", "right").mapInArrow(compare, "a long, b long, far_reaching boolean, likeness double"), "compared")


def set_forest(ids: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links that connect what pairs of sets with a cosine of ``least`` or more connect: fewer than there are sets.

    The sets that share a shingle are listed once; a set then meets all others
    by counting through the lists of its own shingles.
    """
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    shingle, of = np.unique(np.concatenate(sets) if len(sets) else np.empty(0), return_inverse=True)
    order = np.argsort(of, kind="stable")
    lists, ends = owner[order], np.cumsum(np.bincount(of, minlength=len(shingle)))
    starts, first = np.concatenate([[0], ends[:-1]]), np.concatenate([[0], np.cumsum(size)])
    left, edges = np.ones(len(sets), bool), []
    for seed in range(len(sets)):
        if not left[seed]:
            continue
        left[seed], front = False, [seed]
        while front:
            x = front.pop()
            mine = of[first[x] : first[x + 1]]
            shared = np.bincount(np.concatenate([lists[starts[k] : ends[k]] for k in mine]), minlength=len(sets)) if len(mine) else np.zeros(len(sets), int)
            hit = np.flatnonzero(left & (shared >= least * np.sqrt(size * float(size[x])) - 1e-9) & ((shared > 0) | (size + size[x] == 0)))
            left[hit] = False
            edges += [(int(ids[x]), int(ids[y])) for y in hit]
            front += hit.tolist()
    return edges


def _exact_links(members: DataFrame, asked: DataFrame, scheme: Scheme, longest: int = LONGEST_SETS) -> DataFrame:
    """Links (a, b) that connect each ``asked`` cluster of ``members`` (cluster, id, held) as all its pairs would.

    Large clusters are dealt into chunks that meet two by two. What is known of
    a cluster is copied to a fixed number of places first, so that no task gets
    all members of one.
    """
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"))
    chunks = asked.join(sizes, "cluster").select("cluster", F.when(F.col("n") > longest, F.ceil(F.col("n") * 2 / longest)).otherwise(1).cast("int").alias("chunks"))
    places = chunks.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = members.withColumn("place", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(SALTS)).cast("int")).join(places, ["cluster", "place"])
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), "chunks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))

    def connect(rows: pd.DataFrame) -> pd.DataFrame:
        edges = set_forest(rows["id"].to_numpy(), [np.frombuffer(x, "<u8") for x in rows["held"]], scheme.cosine)
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    keyed = dealt.select("cluster", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "id", "held")
    return keyed.groupBy("cluster", "one", "two").applyInPandas(connect, "a long, b long")


def _checked_components(docs: DataFrame, nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """Components of links whose shingle sets are as similar as the scheme asks."""
    links = stored(near_links(nodes, scheme), "near-links")
    held = _shingle_sets(docs, nodes, links, scheme)
    told = _compared(links, held)
    true = told.where(F.col("likeness") >= scheme.cosine - 1e-9).select("a", "b")
    broken = told.where(F.col("far_reaching") & (F.col("likeness") < scheme.cosine - 1e-9)).select("a", "b")
    if broken.isEmpty():
        return connected_components(true)
    # A long run linked its rows through a forest, and the check broke a tree of it: its cluster is compared set by set.
    clusters = connected_components(links.select("a", "b"))
    named = stored(held.join(clusters, held["id"] == clusters["node"], "left").select("id", "held", F.coalesce("component", "id").alias("cluster")), "near-clusters")
    asked = broken.select(F.col("a").alias("id")).distinct().join(named.select("id", "cluster"), "id").select("cluster").distinct()
    exact = _exact_links(named, asked, scheme)
    return connected_components(true.unionByName(exact))


def near_groups(docs: DataFrame, scheme: Scheme = THREE_BITS) -> DataFrame:
    """Near-duplicate groups of ``docs`` (doc_id long, text; other columns are ignored).

    Returns (doc_id, text_hash, fp, component_id, root) for every row: rows link when their
    fingerprints differ in at most ``scheme.most_bits`` bits (and, with ``scheme.cosine``,
    their shingle sets are that similar), and component_id is
    the smallest doc_id that links reach, the row's own included. Null text
    counts as empty; texts without words share the zero fingerprint and link
    like any other. Rows that repeat a doc_id all come back. component_id being a
    doc_id, unrelated texts under one doc_id may carry the same; ``root``, which
    names a group by its fingerprints, tells them apart. A null doc_id comes
    back with the component of its fingerprint. An empty table gives no rows.
    """
    need(docs, ["doc_id", "text"])
    prints = stored(fingerprints(docs, scheme), "fingerprints")
    # Nodes are fingerprints, numbered by a key of their own: a doc_id may come with several texts.
    of_set = ["fp", *(["keys"] if scheme.bands else [])]
    nodes = prints.groupBy(*of_set).agg(F.min("doc_id").alias("least"), F.min("text_hash").alias("text_hash"))
    nodes = stored(nodes.select(F.xxhash64("fp").alias("id") if scheme.width > 1 else _as_long("fp").alias("id"), *of_set, "least", "text_hash"), "nodes")
    found = _checked_components(docs, nodes, scheme) if scheme.cosine else connected_components(near_links(nodes, scheme))
    of = nodes.join(found, nodes["id"] == found["node"], "left").select("id", "fp", "least", F.coalesce("component", "id").alias("root"))
    # Only roots of several nodes have to be told their least doc_id; each is copied to a few places over which its nodes are dealt.
    several = of.groupBy("root").agg(F.min("least").alias("told"), F.count("*").alias("n")).where("n > 1").drop("n")
    several = several.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(KEEP_SALTS - 1))))
    dealt = of.withColumn("place", F.pmod(F.xxhash64("id"), F.lit(KEEP_SALTS)).cast("int"))
    named = stored(dealt.join(several, ["root", "place"], "left").select("fp", F.coalesce("told", "least").alias("component_id"), "root"), "near-names")
    return prints.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id", "root")


def _as_long(name: str):
    """The 64 bits of a fingerprint of one word as a signed number."""
    return F.conv(F.hex(name), 16, -10).cast("long")


def fingerprint_hex(name: str = "fp"):
    """16 lowercase hex digits of a fingerprint of one word, most significant first."""
    return F.lower(F.concat(*[F.substring(F.hex(name), i, 2) for i in range(15, 0, -2)]))


def near_dedup(docs: DataFrame, scheme: Scheme = NEAR_80) -> DataFrame:
    """The rows of ``docs`` that stay: of each near-duplicate group the one with the smallest doc_id.

    Groups are those of linked texts: a doc_id that comes with unrelated texts
    is in several, and each keeps a row. Of rows of a group that share this
    doc_id the one with the smallest text hash stays; of rows that repeat both
    doc_id and text, one. Rows with a null doc_id stay. All columns are kept.
    """
    groups = stored(near_groups(docs, scheme), "near-groups")
    several = groups.where("doc_id is not null").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("keep"), F.count("*").alias("n")).where("n > 1").drop("n")
    # A group's row that stays is copied to a few places over which its members are dealt: no task gets all of a large group.
    several = several.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(KEEP_SALTS - 1))))
    gone = groups.withColumn("place", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(KEEP_SALTS)).cast("int")).join(several, ["root", "place"]).where("struct(doc_id, text_hash) <> keep")
    gone = gone.select(F.col("doc_id").alias("__gone"), F.col("text_hash").alias("__hash")).distinct()
    here = F.xxhash64(text_or_empty())
    # The narrow side is hashed, so that texts are dealt out but never sorted.
    gone = gone.hint("shuffle_hash")
    stay = docs.join(gone, (docs["doc_id"] == gone["__gone"]) & (here == gone["__hash"]), "left_anti")
    if not groups.where("doc_id is not null").groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        bare = stay.where("doc_id is null")
        name = f"{free_prefix(docs)}hash"
        stay = stay.where("doc_id is not null").withColumn(name, here).dropDuplicates(["doc_id", name]).drop(name).unionByName(bare)
    return stay
