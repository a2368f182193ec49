"""Kernels against plain brute force and hand-checked values."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimflow.functions import kernels as K

numbers = st.lists(st.floats(-50, 50), min_size=1, max_size=12)


def plain_dtw(a, b):
    t = np.full((len(a) + 1, len(b) + 1), np.inf)
    t[0, 0] = 0
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1, j + 1] = abs(a[i] - b[j]) + min(t[i, j], t[i, j + 1], t[i + 1, j])
    return t[-1, -1] / (len(a) + len(b))


@given(numbers, numbers)
@settings(max_examples=60, deadline=None)
def test_dtw(a, b):
    assert K.dtw([a], [b])[0] == pytest.approx(plain_dtw(a, b))
    assert K.dtw([a], [b])[0] == pytest.approx(K.dtw([b], [a])[0])
    assert K.dtw([a], [a])[0] == 0


def test_dtw_by_hand():
    assert K.dtw([[0, 1]], [[0, 1]])[0] == 0
    assert K.dtw([[0]], [[3]])[0] == 1.5
    assert K.dtw([[0, 0]], [[3, 4]], squared=True)[0] == pytest.approx(5)


def test_all_pairs_of_rows():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(37, 6)), np.concatenate([rng.normal(size=(20, 6)), np.zeros((1, 6))])
    y[3] = x[5]
    assert np.allclose(K.straight(x, y), np.linalg.norm(x[:, None] - y[None], axis=2), atol=1e-12) and K.straight(x, y)[5, 3] == 0
    want = np.array([[plain_dtw(a, b) for b in y] for a in x])
    assert np.allclose(K.warped(x, y, at_once=50), want)
    assert (K.least_warped(x, y) <= want + 1e-12).all()


@pytest.mark.parametrize("seed", range(8))
def test_nearest_by_warping(seed):
    """Bounds and abandoning lose nothing, ties go to the first, and pairs that do not count stay out."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 4, size=(25, 5)).astype(float) if seed % 2 else np.cumsum(rng.normal(size=(25, 30)), 1)
    y = np.concatenate([x[:12], x[3:9] + 0.5])
    own = np.arange(25)[:, None] == np.arange(18)[None]
    d = np.array([[plain_dtw(a, b) for b in y] for a in x])
    d[own] = np.inf
    for i, (at, far) in enumerate(K.nearest_warped(x, y, 4, own, at_once=33)):
        order = np.argsort(np.round(d[i], 12), kind="stable")[:4]
        assert np.allclose(far, d[i][order]) and np.allclose(d[i][at], far) and i not in at[at < 12][at[at < 12] == i]
    assert all(len(at) == 1 for at, _ in K.nearest_warped(x[:2], x[:2], 4, np.eye(2, dtype=bool)))


@pytest.mark.parametrize("radius", [1, 3, 20])
def test_warping_from_coarse_to_fine(radius):
    """Never below the exact distance, within a fifth of it in the mean on walks, and exact once the radius spans the series."""
    rng = np.random.default_rng(5)
    ratios = []
    for n, m in ((40, 40), (37, 52), (64, 33), (9, 9), (3, 8), (1, 5)) * 3:
        a, b = np.cumsum(rng.normal(size=n)), np.cumsum(rng.normal(size=m))
        exact, fast = plain_dtw(a, b), K.fast_warped(a, b, radius)
        assert fast >= exact - 1e-12
        ratios.append(fast / exact)
    assert np.mean(ratios) < {1: 1.5, 3: 1.2, 20: 1.05}[radius]
    assert K.fast_warped(a, b, 100) == pytest.approx(plain_dtw(a, b)) and K.fast_warped(a, a) == 0


def test_warping_a_long_series_takes_few_cells():
    import time

    x = np.cumsum(np.random.default_rng(6).normal(size=20_000))
    began = time.perf_counter()
    assert 0 <= K.fast_warped(x, x[::-1].copy(), 1) < np.abs(x - x[::-1]).sum()
    assert time.perf_counter() - began < 20


def test_a_limit_gives_pairs_up():
    a, b = np.zeros((40, 3)), np.stack([np.zeros(40), np.full(40, 9.0), np.full(40, 1.0)], 1)
    got = K.warped_of(a, b, limit=np.array([1.0, 1.0, 1.0]))
    assert got[0] == 0 and np.isinf(got[1]) and got[2] == pytest.approx(0.5)


def test_peaks():
    x = [0, 3, 0, 5, 5, 5, 0, 4, 0]
    assert K.spaced_peaks(x, 1).tolist() == [1, 4, 7]
    assert K.spaced_peaks(x, 4).tolist() == [4]
    assert K.spaced_peaks(x, 1, 4.5).tolist() == [4]
    assert K.kept_peaks([0, 2, 0, 3, 0], 3).tolist() == [3]
    assert K.greedy_steps(np.array([0, 2, 0, 3, 0, 0, 0, 1, 0]), 1, 4) == [3, 7]
    assert K.debounced(np.array([1, 1, 0, 1, 0, 1]), 3) == [0, 3]
    assert not len(K.spaced_peaks([1, 2], 1))


@given(st.lists(st.floats(-9, 9), min_size=40, max_size=90))
@settings(max_examples=30, deadline=None)
def test_wavelet_inverts(x):
    """Without a threshold the bands give the signal back."""
    assert np.allclose(K.denoised(np.array(x), factor=0.0), x, atol=1e-6)


def test_smoothing_keeps_what_it_must():
    t = np.arange(60.0)
    assert np.allclose(K.polynomial_smooth(2 + 0.5 * t + 0.01 * t * t, 9, 2), 2 + 0.5 * t + 0.01 * t * t)
    assert np.allclose(K.gaussian(np.full(20, 3.0), 2.0), 3.0)
    noisy = np.sin(t / 9) + np.random.default_rng(1).normal(0, 0.3, 60)
    assert np.abs(K.denoised(noisy) - np.sin(t / 9)).mean() < np.abs(noisy - np.sin(t / 9)).mean()
    y = K.magnetic(np.where(t % 7 == 3, np.nan, np.sin(t / 5)))
    assert abs(y.mean()) < 1e-9 and y.std(ddof=1) == pytest.approx(1)


def test_components_are_centred_and_oriented():
    x = np.random.default_rng(2).normal(size=(30, 6))
    y = K.components(x, 4)
    assert y.shape == (30, 4) and np.allclose(y.mean(0), 0)
    assert np.allclose(K.components(x[::-1], 4)[::-1], y)


def test_complete_linkage():
    labels = K.complete_linkage([0, 4, 9, 30, 31], 10)
    assert labels[0] == labels[1] == labels[2] and labels[3] == labels[4] != labels[0]
    assert len(set(K.complete_linkage([0, 6, 12, 18], 10))) == 2


@pytest.mark.parametrize("size", [1, 2, 3, 20])
def test_windows_at_once_are_as_one_by_one(size):
    import pandas as pd

    x = np.random.default_rng(size).normal(size=(200, size)).round(0 if size > 2 else 2)
    for row, top, wobble in zip(x, K.highest_peaks(x), K.mean_trailing_deviations(x, 5), strict=True):
        at = K.spaced_peaks(row, 4)
        assert top == (row[at].max() if len(at) else 0.0)
        assert wobble == pytest.approx(pd.Series(row).rolling(5, min_periods=1).std().mean(), abs=1e-9, nan_ok=True)
