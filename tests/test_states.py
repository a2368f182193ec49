"""State features, grouped models and the queries made of them, against plain numpy."""

from __future__ import annotations

import numpy as np
import pytest

from claimflow.functions import kernels as K
from claimflow.operators import embedding, states
from claimflow.plans import catalogue

DATA = "/root/testdata/sf0.001"


def plain_levels(x, k, rounds=25):
    centres = np.round(x.min() + (x.max() - x.min()) * (np.arange(k) + 0.5) / k, 9)
    for _ in range(rounds):
        code = np.abs(x[:, None] - centres[None]).argmin(1)
        new = np.array([round(x[code == c].mean(), 9) if (code == c).any() else centres[c] for c in range(k)])
        if (new == centres).all():
            break
        centres = new
    code = np.abs(x[:, None] - centres[None]).argmin(1)
    return code, centres[code]


def test_clusters_of_one_number_by_group(spark):
    rng = np.random.default_rng(1)
    groups = {1: rng.normal(size=200), 2: np.concatenate([rng.normal(0, 1, 40), rng.normal(50, 1, 60)]), 3: np.full(9, 4.0), 4: np.array([7.0])}
    rows = [(g, i, float(v)) for g, x in groups.items() for i, v in enumerate(x)] + [(1, 900, None), (5, 0, None)]
    got = states.grouped_kmeans(spark.createDataFrame(rows, "trace_id long, i long, v double"), ["trace_id"], "v", 4).collect()
    assert len(got) == len(rows)
    assert all(r["state"] is None and r["centre"] is None for r in got if r["v"] is None)
    for g, x in groups.items():
        code, centre = plain_levels(x, 4)
        mine = sorted((r["i"], r["state"], r["centre"]) for r in got if r["trace_id"] == g and r["v"] is not None)
        assert [s for _, s, _ in mine] == code.tolist() and np.allclose([c for _, _, c in mine], centre, atol=1e-8)


@pytest.mark.parametrize("block", [7, 10_000])
def test_components_by_group(spark, block):
    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(size=(40, 6)), "b": rng.normal(size=(25, 6)) * 3 + 1, "few": rng.normal(size=(3, 6))}
    rows = [(100 * n + i, g, [float(v) for v in x[i]]) for n, (g, x) in enumerate(groups.items()) for i in range(len(x))]
    got = {r["id"]: r for r in states.grouped_components(spark.createDataFrame([*rows, (999, None, [0.0] * 6)], "id long, label string, v array<double>"), "id", "label", "v", 4, block).collect()}
    assert len(got) == len(rows)
    for n, (g, x) in enumerate(groups.items()):
        mine = np.array([got[100 * n + i]["components"] for i in range(len(x))])
        k = min(4, len(x) - 1)  # the last one of as many as there are rows holds nothing
        assert np.allclose(mine[:, :k], K.components(x, k), atol=1e-8) and got[100 * n]["n"] == len(x)


def test_separate_components_by_brute_force(spark):
    raw = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()
    by = {}
    for r in raw:
        by.setdefault(r["label"], []).append(r["embedding"])
    x = {k: np.array(v, float) for k, v in by.items()}
    got = {(r["left_label"], r["right_label"]): r["distance"] for r in catalogue.queries()["separate_components"](spark, DATA).collect()}
    assert set(got) == {(a, b) for a in x for b in x if a < b}
    for (a, b), d in got.items():
        # As many components as the smaller set has rows; the last of these holds nothing in it.
        k = min(20, len(x[a]), len(x[b]))
        p, q = (np.pad(c := K.components(v, k), ((0, 0), (0, k - c.shape[1]))) for v in (x[a], x[b]))
        want = np.linalg.norm(p[:, None] - q[None], axis=2).mean()
        assert d == pytest.approx(want, rel=2e-2 if k < 20 else 1e-4)


def test_row_preparation():
    assert K.filled([None, 2, None, 5, None]).tolist() == [2, 2, 2, 5, 5] and K.filled([None]).tolist() == [0]
    assert np.allclose(K.centred_mean(np.array([1.0, 2, 3, 10]), 3), [1.5, 2, 5, 6.5])
    z = K.row_standard([1, 4, None, 9, 2, 2, 8])
    assert abs(z.mean()) < 1e-12 and z.std() == pytest.approx(1) and not K.row_standard([3, 3, 3]).any()


def test_composite_features_by_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=30).tolist(), rng.normal(size=12).tolist(), [float(v) if v > 0 else None for v in rng.normal(size=12)]) for i in range(25)]
    rows[4] = (4, [None] * 3 + rows[4][1][3:], [None] * 12, rows[4][3])
    got = {r["id"]: r for r in states.prepared(spark.createDataFrame(rows, "id long, cur array<double>, a array<double>, b array<double>"), ["id"], "cur", ["a", "b"], 5).collect()}
    meg = K.components(np.array([K.row_standard(r[1]) for r in rows]), 5)
    for r, m in zip(rows, meg, strict=True):
        part = lambda at, r=r: K.centred_mean(K.filled([*r[2][at : at + 4], *r[3][at : at + 4]]), 3)
        assert np.allclose(got[r[0]]["lte"], np.concatenate([4 * part(4), part(0), part(8)]))
        assert np.allclose(np.abs(got[r[0]]["meg"]), np.abs(m), atol=1e-6)
    found = catalogue.queries()["composite_features"](spark, DATA)
    assert found.count() > 0 and found.where("size(lte) <> 24").count() == 0


def test_location_scores_follow_the_signals(spark):
    for r in catalogue.queries()["location_score"](spark, DATA).collect():
        want = 0.2 * r["s_lte"] + 0.3 * r["s_meg"] + 0.5 * r["s_signal"] if r["topology_passed"] else -1.0
        assert r["s_location"] == pytest.approx(want, abs=1e-6)


def trustworthiness(high, low, k=10):
    """How far neighbours in a layout are neighbours indeed, from 0 to 1."""
    n = len(high)
    rank = np.argsort(np.argsort(np.linalg.norm(high[:, None] - high[None], axis=2), axis=1), axis=1)
    near = np.argsort(np.linalg.norm(low[:, None] - low[None], axis=2) + np.eye(n) * 1e18, axis=1)[:, :k]
    return 1 - np.maximum(np.take_along_axis(rank, near, 1) - k, 0).sum() * 2 / (n * k * (2 * n - 3 * k - 1))


def test_neighbours_stay_near_in_the_plane(spark):
    """More of them than in two principal components, on all vectors; a graph's weights are symmetric and at most 1."""
    from pyspark.sql import functions as F

    v = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    rows = v.orderBy("vec_id").collect()
    x = np.array([r["v"] for r in rows])
    got = {r["vec_id"]: (r["x"], r["y"]) for r in catalogue.queries()["neighbour_layout"](spark, DATA).collect()}
    flat = trustworthiness(x, K.components(x, 2))
    assert trustworthiness(x, np.array([got[r["vec_id"]] for r in rows])) > flat + 0.03
    w = {(r["a"], r["b"]): r["w"] for r in embedding.neighbour_graph(v, "vec_id", "v", 8).collect()}
    assert all(w[(b, a)] == pytest.approx(x) and 0 < x <= 1 + 1e-9 for (a, b), x in w.items())


def test_memberships_sum_to_the_logarithm():
    far = np.sort(np.random.default_rng(4).random(15)) + 1
    w = embedding.membership(far)
    assert w[0] == 1 and (np.diff(w) <= 0).all() and w.sum() == pytest.approx(np.log2(15), abs=1e-3)
    assert np.isfinite(embedding.membership(np.zeros(5))).all()
