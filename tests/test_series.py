"""Operators on ranges of long traces against the kernels, which see a whole trace."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimflow.functions import kernels as K
from claimflow.operators import series


def make(spark, traces, column="value"):
    rows = [(t, i, None if v is None or np.isnan(v) else float(v)) for t, x in traces.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, f"trace_id long, row_idx long, {column} double").repartition(3)


def bumpy(seed, n):
    """Plateaus, ties and a slope whose peaks hang on each other one after another."""
    rng = np.random.default_rng(seed)
    steps = np.repeat(rng.integers(0, 6, n), rng.integers(1, 4, n))[:n].astype(float)
    steps[n // 2 :] += np.arange(n - n // 2) * 0.01
    return steps


TRACES = {1: bumpy(1, 400), 2: bumpy(2, 61), 3: np.zeros(30), 4: np.array([1.0, 2.0, 1.0]), 5: np.array([3.0]), 6: np.concatenate([[0], np.full(95, 4.0), [0, 1, 0]])}


def rows_by_trace(df, *columns):
    out = {}
    for r in df.orderBy("trace_id", "row_idx").collect():
        out.setdefault(r["trace_id"], []).append(r["row_idx"] if not columns else tuple(r[c] for c in columns))
    return out


@pytest.mark.parametrize(("distance", "size"), [(5, 20_000), (5, 16), (1, 16), (23, 40)])
def test_peaks_by_ranges(spark, distance, size):
    df = make(spark, TRACES)
    got = rows_by_trace(series.find_peaks(df, "value", distance, size=size))
    assert got == {t: at.tolist() for t, x in TRACES.items() if len(at := K.spaced_peaks(x, distance))}


def test_high_peaks_and_own_rule(spark):
    df = make(spark, TRACES)
    got = rows_by_trace(series.find_peaks(df, "value", 4, F.avg("value") + F.stddev_pop("value"), size=16))
    assert got == {t: at.tolist() for t, x in TRACES.items() if len(at := K.spaced_peaks(x, 4, x.mean() + x.std()))}
    signed = {t: x - 2.3 for t, x in TRACES.items()}
    for valleys in (False, True):
        got = rows_by_trace(series.kept_peaks(make(spark, signed), "value", 6, valleys, size=16))
        assert got == {t: at.tolist() for t, x in signed.items() if len(at := K.kept_peaks(x, 6, valleys))}


def test_a_range_waits_for_its_margin():
    at = np.array([0, 3, 6, 9, 12])
    rank = np.array([1.0, 2, 3, 4, 5])
    own = np.array([True, True, True, False, False])
    undecided = K.suppressed(at, rank, np.zeros(5), np.zeros(5, int), own, 5)
    assert undecided.tolist() == [0] * 5
    told = K.suppressed(at, rank, np.zeros(5), np.array([0, 0, 0, 2, 1]), own, 5)
    assert told.tolist() == [1, 2, 1, 2, 1]


@pytest.mark.parametrize("few", [3, 40, 10_000])
def test_medians_by_counting(spark, few):
    rng = np.random.default_rng(3)
    groups = {1: rng.normal(size=501), 2: rng.normal(size=500) ** 9, 3: np.full(77, 2.5), 4: np.repeat([1.0, 8.0], 50), 5: np.array([7.0]), 6: np.repeat([0.0, 1.0, 5.0], [400, 1, 401])}
    got = {r["trace_id"]: r["median"] for r in series.medians(make(spark, {**groups, 7: [None]}), ["trace_id"], "value", few, 8).collect()}
    assert got == {k: pytest.approx(np.median(x), abs=1e-12) for k, x in groups.items()}


@pytest.mark.parametrize("size", [64, 20_000])
def test_wavelet_by_ranges(spark, size):
    rng = np.random.default_rng(4)
    traces = {1: np.cumsum(rng.normal(size=1500)), 2: np.sin(np.arange(333) / 9) + rng.normal(0, 0.2, 333), 3: rng.normal(size=7), 4: np.array([2.0]), 5: rng.normal(size=64), 6: rng.normal(size=65)}
    got = rows_by_trace(series.denoised(make(spark, traces), "value", "y", size=size), "row_idx", "y")
    for t, x in traces.items():
        assert [i for i, _ in got[t]] == list(range(len(x)))
        assert np.allclose([y for _, y in got[t]], K.denoised(x), atol=1e-9), t


def test_magnetic_preparation(spark):
    rng = np.random.default_rng(5)
    x = np.cumsum(rng.normal(size=700))
    x[::9] = np.nan
    x[:4] = np.nan
    traces = {1: x, 2: np.full(20, np.nan), 3: np.array([4.0, 1.0, np.nan])}
    got = rows_by_trace(series.magnetic(make(spark, traces), "value", "y"), "y")
    for t, v in traces.items():
        assert np.allclose([y for (y,) in got[t]], K.magnetic(v), atol=1e-8), t


def test_polynomial_smoothing_with_its_ends(spark):
    traces = {1: np.random.default_rng(6).normal(size=60), 2: np.arange(9.0) ** 2, 3: np.array([1.0, 5.0, 2.0])}
    got = rows_by_trace(series.polynomial_smooth(make(spark, traces), "value", "y", 9, 2), "y")
    for t, x in traces.items():
        assert np.allclose([y for (y,) in got[t]], K.polynomial_smooth(x, 9, 2), atol=1e-9), t


def test_debounced_flags(spark):
    rng = np.random.default_rng(7)
    traces = {t: rng.random(300) < p for t, p in ((1, 0.9), (2, 0.2), (3, 0.02))}
    flags = spark.createDataFrame([(t, int(i)) for t, x in traces.items() for i in np.flatnonzero(x)], "trace_id long, row_idx long")
    assert rows_by_trace(series.debounced(flags, 8)) == {t: K.debounced(x, 8) for t, x in traces.items()}
    assert series.debounced(flags.where("row_idx < 0"), 8).count() == 0


def plain_linkage(x, cut):
    """The narrowest joined span first, all spans computed anew each time."""
    groups = [[v] for v in sorted(x)]
    while len(groups) > 1:
        spans = [b[-1] - a[0] for a, b in zip(groups, groups[1:], strict=False)]
        k = int(np.argmin(spans))
        if spans[k] > cut:
            break
        groups[k : k + 2] = [groups[k] + groups[k + 1]]
    return {v: n for n, g in enumerate(groups) for v in g}


def test_clusters_on_a_line(spark):
    rng = np.random.default_rng(8)
    traces = {1: rng.integers(0, 200, 120).astype(float), 2: rng.normal(0, 30, 80), 3: np.zeros(5), 4: np.array([0.0, 10, 20, 30, 41])}
    got = series.complete_linkage(make(spark, traces), "value", 10.0).collect()
    for t, x in traces.items():
        want = plain_linkage(sorted(set(x.tolist())), 10.0)
        assert {r["value"]: r["cluster"] for r in got if r["trace_id"] == t} == want
        assert sum(r["trace_id"] == t for r in got) == len(x)


def test_many_values_on_a_line():
    import time

    x = np.sort(np.random.default_rng(9).random(100_000) * 100_000)
    began = time.perf_counter()
    starts = K.linked_starts(x, 10.0)
    assert time.perf_counter() - began < 20
    first, last = x[starts], np.append(np.flatnonzero(np.diff(starts)), len(x) - 1)
    assert (x - first <= 10.0).all() and (x[starts[last[1:]]] > x[last[:-1]]).all()


def test_short_traces_that_share_a_call_do_not_meet(spark):
    traces = {i: np.random.default_rng(i).normal(size=30) for i in range(40)}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in traces.items() for i, v in enumerate(x)], "trace_id long, row_idx long, value double")
    got = {}
    for r in series.find_peaks(df, "value", 4).collect():
        got.setdefault(r["trace_id"], set()).add(r["row_idx"])
    assert got == {k: set(K.spaced_peaks(x, 4).tolist()) for k, x in traces.items()}
