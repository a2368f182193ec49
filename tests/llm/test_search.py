from __future__ import annotations

import numpy as np
import pytest

from claimflow.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, q long, v string"


@pytest.fixture
def vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)) + rng.normal(size=(12, 16))[rng.integers(0, 12, 1500)] * 3
    rows = [(i, x[i].tolist(), 0, 1, "e") for i in range(1500)]
    rows += [(2000 + i, x[0].tolist(), 0, 1, "e") for i in range(400)]  # one very common vector
    rows += [(3000, None, 0, 1, "e"), (3050, [0.0] * 16, 0, 1, "e"), (3100, [float("nan")] + [1.0] * 15, 0, 1, "e"), (3150, [None] + [1.0] * 15, 0, 1, "e"), (3200, [float("inf")] * 16, 0, 1, "e"), (3250, [1.0, 2.0], 0, 1, "e"), (None, [1.0] * 16, 0, 1, "e"), (7, x[7].tolist(), 0, 1, "e")]
    return spark.createDataFrame(rows, SCHEMA)


def test_search_by_brute_force(vectors):
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect() if r["vec_id"] is not None and r["embedding"] and len(r["embedding"]) == 16]
    usable = {i: np.array(v, float) for i, v in rows if all(c is not None and np.isfinite(c) for c in v) and any(v)}
    ids, x = np.array(list(usable)), np.array(list(usable.values()))
    got = ann.search(vectors, vectors.where("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect()
    lists: dict = {}
    for r in got:
        lists.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = [i for i in usable if i % 50 == 0]
    assert sorted(lists) == sorted(want)
    hit = 0
    for q in want:
        s = (x @ usable[q]) / np.linalg.norm(x, axis=1) / np.linalg.norm(usable[q])
        s[ids == q] = -9
        order = np.lexsort((ids, -np.round(s, 9)))[:5]
        found = lists[q]
        assert len(found) == 5 and q not in [v for v, _ in found]
        assert all(abs(sc - s[ids == v][0]) < 1e-12 for v, sc in found)
        assert [sc for _, sc in found] == sorted((sc for _, sc in found), reverse=True)
        hit += len({v for v, _ in found} & set(ids[order].tolist()))
    assert hit / (5 * len(want)) >= 0.9
    assert [v for v, _ in lists[2000]] == [0, 2001, 2002, 2003, 2004]


def test_few_or_no_vectors(spark):
    two = spark.createDataFrame([(0, [1.0, 0.0], 0, 0, ""), (50, [1.0, 1.0], 0, 0, "")], SCHEMA)
    assert {(r["query_id"], r["vec_id"]) for r in ann.search(two, two, 5).collect()} == {(0, 50), (50, 0)}
    none = spark.createDataFrame([], SCHEMA)
    assert ann.search(none, none, 5).count() == 0
    assert ann.search(two, none, 5).count() == 0


def test_bundles_hold_every_leaf():
    places = ann.bundles({0: 10, 1: 3990, 2: 1, 3: 9000, 4: 5}, 4000)
    assert places[0] == places[1] == (0, 1) and places[2] == (1, 1)
    assert places[3] == (2, 3) and places[4][0] == 5


def test_queries_of_a_bundle_are_dealt_into_blocks(vectors, monkeypatch):
    """The same neighbours, and no group with all queries of a bundle."""
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    seen, plain = [], PandasCogroupedOps.applyInPandas

    def watched(self, f, schema):
        sizes = self._gd1._df.groupBy(*self._gd1._jgd.toString().split("grouping expressions: [")[1].split("]")[0].split(", ")).count()
        seen.append(max(r["count"] for r in sizes.collect()))
        return plain(self, f, schema)

    monkeypatch.setattr(PandasCogroupedOps, "applyInPandas", watched)
    asked = vectors.where("vec_id < 300")
    whole = sorted(map(tuple, ann.search(vectors, asked, 5).collect()))
    assert whole == sorted(map(tuple, ann.search(vectors, asked, 5, block=30).collect()))
    assert seen[0] > 250 and seen[1] <= 60


def test_cosines_of_any_size():
    """Components near the ends of doubles give the same numbers as scaled ones."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20, 8))
    plain = ann.cosines(x[0], x)
    assert np.array_equal(plain, (x * x[0]).sum(1) / (np.sqrt((x[0] * x[0]).sum()) * np.sqrt((x * x).sum(1))))
    for size in (1e200, 1e-200):
        assert np.allclose(ann.cosines(x[0] * size, x * size), plain, atol=1e-12)
        assert np.allclose(ann.cosines(x[0], x * size), plain, atol=1e-12)
