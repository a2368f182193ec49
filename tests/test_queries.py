"""Every registered query against its SQL, or against brute force, on the smallest tables."""

from __future__ import annotations

import decimal
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from claimflow.functions import columns as C
from claimflow.functions import kernels as K
from claimflow.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, (float, decimal.Decimal)):
        return "nan" if x != x else round(float(x), 6) + 0.0
    return x


def rows(names, data):
    order = [names.index(n) for n in sorted(names)]
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    said = duck.sql(catalogue.oracle_sql()[name])
    names = [d[0] for d in said.description]
    df = catalogue.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, said.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    df = catalogue.queries()[name](spark, DATA)
    assert df.count() > 0


def reduced(spark):
    """(label, 20 components) of each vector."""
    label = {r["vec_id"]: r["label"] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    return {r["vec_id"]: (label[r["vec_id"]], np.array(r["components"])) for r in catalogue.queries()["pca_reduce"](spark, DATA).collect()}


def warped(a, b):
    t = np.full((len(a) + 1, len(b) + 1), np.inf)
    t[0, 0] = 0
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1, j + 1] = abs(a[i] - b[j]) + min(t[i, j], t[i, j + 1], t[i + 1, j])
    return t[-1, -1] / (len(a) + len(b))


def matrix(v, f):
    """(ids, labels, distances) of all rows, one row of pairs at a time."""
    ids = sorted(v)
    x = np.array([v[i][1] for i in ids])
    return ids, np.array([v[i][0] for i in ids]), np.array([f(np.repeat(x[i : i + 1], len(x), 0), x) for i in range(len(x))])


def straight(a, b):
    return np.linalg.norm(a - b, axis=1)


@pytest.fixture(scope="module")
def warped_matrix(spark):
    """All pairs by the kernel for given pairs, which plain loops check in test_kernels and, on some pairs, here."""
    ids, labels, d = matrix(reduced(spark), K.dtw)
    v = reduced(spark)
    for i, j in np.random.default_rng(1).integers(0, len(ids), (300, 2)):
        assert d[i, j] == pytest.approx(warped(v[ids[i]][1], v[ids[j]][1]))
    return ids, labels, d


def test_dtw_pairs_by_brute_force(spark, warped_matrix):
    ids, labels, d = warped_matrix
    got = {r["vec_id"]: r for r in catalogue.queries()["dtw_pairs"](spark, DATA).collect()}
    assert set(got) == {i for i, k in zip(ids, labels, strict=True) if (labels == k).sum() > 1}
    for n, i in enumerate(ids):
        others = np.flatnonzero((labels == labels[n]) & (np.arange(len(ids)) != n))
        if len(others):
            r, row = got[i], d[n, others]
            assert r["n"] == len(others) and r["mean_dtw"] == pytest.approx(row.mean(), abs=2e-6) and r["least_dtw"] == pytest.approx(row.min(), abs=2e-6)
            assert r["nearest"] == ids[others[row.argmin()]]
            assert 0 < r["least_squared"] <= r["mean_squared"] <= r["most_squared"]


def test_dtw_neighbours_by_brute_force(spark, warped_matrix):
    ids, labels, d = warped_matrix
    got = {}
    for r in catalogue.queries()["dtw_neighbours"](spark, DATA).orderBy("vec_id", "rank").collect():
        got.setdefault(r["vec_id"], []).append((r["other"], r["distance"]))
    for n, i in enumerate(ids):
        others = [o for o in np.argsort(d[n], kind="stable") if o != n and labels[o] == labels[n]][:3]
        assert [x for x, _ in got.get(i, [])] == [ids[o] for o in others]
        assert [x for _, x in got.get(i, [])] == pytest.approx([d[n, o] for o in others])


def test_dtw_global_match_by_brute_force(spark, warped_matrix):
    ids, labels, w = warped_matrix
    _, _, e = matrix(reduced(spark), straight)
    got = {r["vec_id"]: (r["label"], r["mean_distance"]) for r in catalogue.queries()["dtw_global_match"](spark, DATA).collect()}
    assert set(got) == set(ids)
    for n, i in enumerate(ids):
        others = np.flatnonzero(np.arange(len(ids)) != n)
        scale = lambda x: (x - x.min()) / (x.max() - x.min())
        fused = np.sqrt((0.3 * scale(w[n, others])) ** 2 + (0.7 * scale(e[n, others])) ** 2)
        means = {k: np.sort(fused[labels[others] == k])[:3].mean() for k in set(labels[others])}
        label = min(means, key=lambda k: (means[k], k))
        assert got[i] == (label, pytest.approx(means[label], abs=1e-9))


def test_signal_scores_by_brute_force(spark):
    raw = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in raw], float)
    z = lambda a: (a - a.mean(0)) / np.where(a.std(0) == 0, 1, a.std(0))
    meg, lte = z(K.components(x, 50)), z(x[:, 32:])
    joint = np.concatenate([meg, lte], 1)
    ids, labels = [r["vec_id"] for r in raw], np.array([r["label"] for r in raw])
    got = {r["vec_id"]: r for r in catalogue.queries()["signal_scores"](spark, DATA).collect()}
    assert set(got) == set(ids)
    for n, i in enumerate(ids):
        others = np.flatnonzero((labels == labels[n]) & (np.arange(len(ids)) != n))
        mean = lambda d: (1 / (1 + np.array(d))).mean()
        assert got[i]["s_lte"] == pytest.approx(mean(np.linalg.norm(lte[others] - lte[n], axis=1) / np.sqrt(32)), abs=1e-4)
        assert got[i]["s_meg"] == pytest.approx(mean(K.dtw(np.repeat(meg[n : n + 1], len(others), 0), meg[others])), abs=1e-4)
        assert got[i]["s_signal"] == pytest.approx(mean(K.dtw(np.repeat(joint[n : n + 1], len(others), 0), joint[others])), abs=1e-4)


def test_kmeans_states_by_brute_force(spark, warped_matrix):
    """Lloyd's steps on the whole fused matrix in numpy, from the same starts."""
    from pyspark.sql import functions as F

    ids, _, w = warped_matrix
    raw = {r["vec_id"]: np.array(r["embedding"], float)[32:] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    _, _, e = matrix({i: (0, raw[i]) for i in ids}, straight)
    x = np.sqrt((0.3 * w / w.max(0)) ** 2 + (0.7 * e / e.max(0)) ** 2)
    hashes = spark.createDataFrame([(i, s) for i in ids for s in range(20)], "i long, s int").withColumn("h", F.xxhash64("i", "s")).collect()
    best = None
    for s in range(20):
        first = [i for _, i in sorted((r["h"], r["i"]) for r in hashes if r["s"] == s)[:10]]
        centres, code = x[[ids.index(i) for i in first]], None
        while True:
            d = ((x[:, None] - centres[None]) ** 2).sum(2)
            if code is not None and (d.argmin(1) == code).all():
                break
            code = d.argmin(1)
            centres = np.stack([x[code == k].mean(0) if (code == k).any() else np.full(len(ids), np.inf) for k in range(10)])
        if best is None or d.min(1).sum() < best[0] - 1e-9:
            best = d.min(1).sum(), code
    got = {r["vec_id"]: r["state"] for r in catalogue.queries()["kmeans_states"](spark, DATA).collect()}
    parts = lambda code: {frozenset(i for i, c in code.items() if c == k) for k in set(code.values())}
    assert parts(got) == parts(dict(zip(ids, best[1].tolist(), strict=True)))
    firsts = [min(i for i in got if got[i] == k) for k in range(len(set(got.values())))]
    assert firsts == sorted(firsts)


def test_components_by_brute_force(spark):
    v = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()
    want = K.components(np.array([r["embedding"] for r in v]), 20)
    got = {r["vec_id"]: np.array(r["components"]) for r in catalogue.queries()["pca_reduce"](spark, DATA).collect()}
    have = np.stack([got[r["vec_id"]] for r in v])
    assert np.allclose(np.abs(have[:, :3]), np.abs(want[:, :3]), atol=1e-4)


def test_flagship(spark):
    df = catalogue.flagship(spark, DATA)
    assert set(df.columns) == {"trace_id", "start_row", "end_row", "score"} and df.count() > 0
    assert df.where("end_row - start_row > 20").count() == 0


def plan_of(spark, name):
    return catalogue.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["wide_or_list_cells", "map_scalars", "parse_filter_cells"])
def test_scans_are_read_and_parsed_once(spark, name):
    """One pass over the lines, and each of a scan's three lists is parsed in one place (its cells refer to that)."""
    plan = plan_of(spark, name)
    assert plan.count("Relation [") == 1
    assert plan.count("from_json(") == 3


def test_last_of_equal_keys_wins(spark):
    """Cells become a map within their scan, without aggregates of cells."""
    made = spark.range(1).select(C.last_wins(F.array(F.lit(3), F.lit(5), F.lit(3), F.lit(9)), F.array(F.lit(1), F.lit(2), F.lit(None), F.lit(4))).alias("m"), C.last_wins(F.array().cast("array<int>"), F.array().cast("array<int>")).alias("none")).first()
    assert made["m"] == {3: None, 5: 2, 9: 4} and made["none"] == {}
    assert plan_of(spark, "map_scalars").count("Aggregate [") == 1


def test_missing_ids_take_one_aggregate(spark):
    """A scan's lines come together once: no window sorts them beside that."""
    plan = plan_of(spark, "null_rssi_zero_id")
    assert plan.count("Aggregate [") == 1 and "Window" not in plan


def test_route_cells_are_read_once(spark):
    """The score refers to a route's cells and jumps, and does not work them out for each use."""
    plan = plan_of(spark, "grid_route_score")
    assert plan.lower().count("rlike") + plan.count("^[a-f][1-6]$") <= 2
