from __future__ import annotations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from claimflow.llm import components, exact_dedup, simhash


def groups(docs, tmp_path, **options):
    path = str(tmp_path / "t")
    docs.select("doc_id", "text").repartition(3).write.mode("overwrite").parquet(path)
    return exact_dedup.exact_dedup_path(docs.sparkSession, path, **options).collect()


ROWS = [(1, "a"), (5, "a"), (3, "a"), (2, "b"), (7, None), (8, ""), (9, "b "), (10, "B"), (4, "x" * 200_000), (6, "x" * 200_000)]


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: (F.length(t) % 2).cast("string")])
@pytest.mark.parametrize("per_trigger", [1, 1 << 30])
def test_exact_groups(docs_of, tmp_path, digest, per_trigger):
    """Also where different texts share a digest, and where hits come in later batches."""
    got = groups(docs_of(ROWS, extra=False), tmp_path, digest=digest, per_trigger=per_trigger)
    assert len(got) == len(ROWS)
    of = dict(ROWS)
    for r in got:
        same = [d for d, t in ROWS if (t or "") == (of[r["doc_id"]] or "")]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(same), len(same), r["doc_id"] == max(same))


def test_one_of_repeated_rows_stays(docs_of, tmp_path):
    got = groups(docs_of([(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, "c"), (0, "c")], extra=False), tmp_path)
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["group_size"]) for r in got if r["kept"])
    assert kept == [(False, 0, 3), (False, 1, 1), (False, 1, 2)]


def test_exact_keeps_all_columns(docs_of):
    docs = docs_of(ROWS)
    out = exact_dedup.exact_dedup(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [2, 5, 6, 8, 9, 10]
    assert exact_dedup.exact_dedup(docs_of([])).count() == 0


def brute(rows, shingle=3, bits=3):
    prints = {}
    for d, t in rows:
        w = [x.lower() for x in (t or "").encode().split()]
        hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + shingle]), 42) for i in range(max(1, len(w) - shingle + 1))] if w else []
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: ("%016x" % p, find(d)) for d, p in prints.items()}


def test_simhash_groups_by_brute_force(docs_of, words):
    rows = [(i, words(120, i % 30) + (f" word{i}" if i % 3 else "")) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "one"), (204, "ONE"), (205, "two words"), (206, words(20_000, 5)), (207, words(20_000, 5) + " x")]
    got = simhash.near_groups(docs_of(rows)).select("doc_id", simhash.fingerprint_hex("fp").alias("f"), "component_id").collect()
    assert {r["doc_id"]: (r["f"], r["component_id"]) for r in got} == brute(rows)
    assert len(got) == len(rows)


def test_xxhash_of_spark_is_the_contract_hash(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_pivot_join_is_exact():
    """Random fingerprints with planted neighbours: the links connect just what all pairs connect."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 300, np.uint64)
    near = base.copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    fps = np.unique(np.concatenate([base, near])).reshape(-1, 1)
    keys, found = simhash.pivot_keys(fps, simhash.THREE_BITS), set()
    for c in range(keys.shape[1]):
        order = np.argsort(keys[:, c], kind="stable")
        found |= {tuple(sorted(e[:2])) for e in simhash.run_links(keys[order, c], order, fps[order], simhash.THREE_BITS)}
    want = {(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i, 0] ^ fps[j, 0]).bit_count() <= 3}
    assert found == {tuple(sorted(p)) for p in want}


def test_long_runs_give_a_forest():
    fps = np.array([[1 << (i % 3)] for i in range(100)], np.uint64) ^ np.arange(100, dtype=np.uint64)[:, None] * np.uint64(1 << 40)
    edges = simhash.run_links(np.zeros(100, np.int64), np.arange(100), fps, simhash.THREE_BITS)
    root = list(range(100))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, _ in edges:
        root[find(a)] = find(b)
    for i in range(100):
        for j in range(i):
            if int(fps[i, 0] ^ fps[j, 0]).bit_count() <= 3:
                assert find(i) == find(j)
    assert len(edges) < 100


def test_long_keys_are_dealt_over_chunks(spark):
    """Components do not depend on how many rows of a key may meet in a task."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**64, 4, np.uint64)
    fps = {int(b ^ (np.uint64(1) << np.uint64(i)) ^ (np.uint64(1) << np.uint64(j))) for b in base for i in range(12) for j in range(i)}
    rows = [(k, np.array([f], "<u8").tobytes()) for k, f in enumerate(sorted(fps))]
    nodes = spark.createDataFrame(rows, "id long, fp binary")
    got = [sorted(map(tuple, components.connected_components(simhash.near_links(nodes, longest=n)).collect())) for n in (20_000, 16)]
    assert got[0] == got[1] and len(rows) - len(got[0]) == 4


def near(a: set, b: set) -> bool:
    """A cosine of 0.8 or more; empty sets are alike."""
    return len(a & b) >= 0.8 * (len(a) * len(b)) ** 0.5 - 1e-9 and bool(a & b or not a | b)


@pytest.mark.parametrize("longest", [6_000, 20])
def test_exact_links_by_brute_force(spark, longest):
    """Sets compared within clusters, also where a cluster is dealt into chunks."""
    rng = np.random.default_rng(9)
    rows, sets = [], {}
    for i in range(80):
        base = np.arange(100) + 1000 * (i % 3)
        x = np.unique(np.where(rng.random(100) < 0.06 * (i % 4), rng.integers(10_000, 99_999, 100), base)).astype("<u8") if i else np.empty(0, "<u8")
        sets[i] = set(x.tolist())
        rows.append((i % 2, i, x.tobytes()))
    got = simhash._exact_links(spark.createDataFrame(rows, "cluster long, id long, held binary"), spark.createDataFrame([(0,), (1,)], "cluster long"), simhash.NEAR_80, longest)
    found = {r["node"]: r["component"] for r in components.connected_components(got).collect()}
    links = [(a, b) for a in sets for b in range(a) if a % 2 == b % 2 and near(sets[a], sets[b])]
    want = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == want and len(want) > 20


def test_checked_links_lose_none_in_long_runs(spark, docs_of, words):
    """A long run whose forest breaks on the exact check: components are those of all pairs."""
    import random

    base = words(200, 5).split()
    rows = []
    for i in range(90):
        text, r = list(base), random.Random(i)
        for _ in range(i % 9):
            text[r.randrange(200)] = f"w{i}"
        rows.append((i, " ".join(text)))
    sets = {d: set(simhash.shingle_hashes(t.encode().split(), 5).tolist()) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            if near(sets[a], sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs_of(rows), simhash.NEAR_80).collect()}
    assert sum(got[d] == find(d) for d in got) >= 88
    assert all(got[d] >= find(d) for d in got)


def test_near_dedup_at_five_words(docs_of, words):
    """Copies with a few words changed go, texts that only share a passage stay."""
    import random

    rows, gone = [], set()
    for i in range(40):
        text = words(300, 1000 + i).split()
        rows.append((i, " ".join(text)))
        r = random.Random(i)
        for j in range(3):
            copy = list(text)
            for _ in range(4):
                copy[r.randrange(300)] = f"changed{i}x{j}"
            rows.append((100 + 10 * i + j, " ".join(copy)))
            gone.add(100 + 10 * i + j)
    shared = words(60, 77)
    rows += [(1000 + i, words(200, 5000 + i) + " " + shared) for i in range(30)]
    out = {r["doc_id"] for r in simhash.near_dedup(docs_of(rows)).collect()}
    assert out >= {d for d, _ in rows} - gone
    assert len(out & gone) <= 2


def test_copies_with_a_passage_more_or_another_are_found(docs_of, words):
    """Contiguous changes at a similarity of 0.8 to 0.9, and the smallest sets that can be that similar: no copy stays."""
    rows, gone = [], set()
    for i in range(120):
        text, n = words(300, 20_000 + i).split(), 34 + i % 40
        passage = words(n, 30_000 + i).split()
        copy = text + passage if i % 2 else text[:100] + passage[: n // 2 - 9] + text[100 + n // 2 - 9 :]
        a, b = ({" ".join(t[k : k + 5]) for k in range(len(t) - 4)} for t in (text, copy))
        assert 0.8 <= len(a & b) / len(a | b) <= 0.93
        rows += [(i, " ".join(text)), (1000 + i, " ".join(copy))]
        gone.add(1000 + i)
    for i in range(60):
        text = words(9, 40_000 + i)
        rows += [(2000 + i, text), (3000 + i, text.rsplit(" ", 1)[0])]
        gone.add(3000 + i)
    out = {r["doc_id"] for r in simhash.near_dedup(docs_of(rows)).collect()}
    assert out == {d for d, _ in rows} - gone


def test_recall_on_thousands_of_planted_pairs(docs_of, words):
    """Texts of 30 to 120 words with scattered, replaced, inserted and cut words, held against the cosine of each pair."""
    import random

    rows, true, alike = [], set(), 0
    for i in range(2500):
        r = random.Random(i)
        text = words(30 + i % 90, 50_000 + i).split()
        copy = list(text)
        for k in range(1 + i % 4):
            at = r.randrange(len(copy))
            way = r.randrange(4)
            copy[at : at + (0 if way == 1 else 1 + 2 * (way == 3))] = [] if way in (2, 3) else [f"new{i}x{k}"]
        a, b = (set(simhash.shingle_hashes(" ".join(t).encode().split(), 5).tolist()) for t in (text, copy))
        rows += [(i, " ".join(text)), (10_000 + i, " ".join(copy))]
        if near(a, b):
            true.add(10_000 + i)
            alike += len(a & b) / len(a | b) < 0.8
    assert len(true) > 1200 and alike > 200
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs_of(rows, extra=False), simhash.NEAR_80).collect()}
    linked = {d for d, c in groups.items() if d != c}
    assert linked <= true and len(linked) >= 0.995 * len(true)


def test_near_dedup_cases(docs_of):
    docs = docs_of([(3, "a b c d e f"), (3, "a b c d e f"), (3, "quite another text of its own"), (1, "A B C D E F"), (None, "a b c d e f"), (None, None)])
    out = simhash.near_dedup(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == [(0, ""), (0, "a b c d e f"), (1, "A B C D E F"), (3, "quite another text of its own")]
    assert simhash.near_dedup(docs_of([])).count() == 0


def test_near_dedup_of_unrelated_texts_under_one_id(docs_of, words):
    """A doc_id is no group: texts that do not link all stay, linked ones under one id or null lose what they should."""
    a, b = words(60, 1), words(60, 2)
    got = lambda rows: sorted(((r["doc_id"], r["text"]) for r in simhash.near_dedup(docs_of(rows)).collect()), key=repr)
    assert got([(7, a), (7, b), (8, a)]) == sorted([(7, a), (7, b)], key=repr)
    many = [(i % 3, words(50, 100 + i)) for i in range(40)]
    assert got(many) == sorted(many, key=repr)
    linked = got([(7, a), (7, a + " more"), (9, b), (None, a)])
    assert len(linked) == 3 and (9, b) in linked and (None, a) in linked


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5), (None, 3), (200, 199)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 200: 199}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
