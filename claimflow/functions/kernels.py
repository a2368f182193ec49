"""Numeric kernels in numpy that no built-in expresses: time warping, peaks, denoising, linkage, components."""

from __future__ import annotations

import heapq

import numpy as np


def dtw(a: np.ndarray, b: np.ndarray, squared: bool = False) -> np.ndarray:
    """Dynamic time warping of pairs: row k of ``a`` against row k of ``b``, all pairs of a batch at once.

    Absolute cost over the summed lengths; squared: the root of summed squares.
    """
    a, b = np.atleast_2d(np.asarray(a, float)), np.atleast_2d(np.asarray(b, float))
    return warped_of(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), squared)


def straight(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``x`` to all of ``y``: one matrix product, with near pairs computed anew from their differences."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    both = (x * x).sum(1)[:, None] + (y * y).sum(1)[None]
    d = x @ y.T
    d *= -2
    d += both
    both *= 1e-6
    near = d < both
    if near.any():
        i, j = np.nonzero(near)
        for at in range(0, len(i), 100_000):
            p, q = i[at : at + 100_000], j[at : at + 100_000]
            d[p, q] = ((x[p] - y[q]) ** 2).sum(1)
    np.maximum(d, 0.0, out=d)
    return np.sqrt(d, out=d)


def warped_of(a: np.ndarray, b: np.ndarray, squared: bool = False, limit: np.ndarray | None = None, starts: tuple[int, ...] = ()) -> np.ndarray | list[np.ndarray]:
    """Warped distances of columns: series k is column k of ``a`` and of ``b``; infinite where all ways exceed ``limit``.

    Series lie along the first axis, so that a step works on neighbours in
    memory; axes after it may be those of a table (rows of x, rows of y). A step
    takes one diagonal, which only hangs on the two before it. Of ``starts``
    the distances of the first so many values come first in a list: their
    table is a corner of the whole one.
    """
    n, m, end, told = len(a), len(b), np.inf, {}
    shape = np.broadcast_shapes(a.shape[1:], b.shape[1:])
    out, alive = np.full(shape, np.inf), None if limit is None else np.arange(shape[0])
    most = None if limit is None else (limit**2 if squared else limit * (n + m)) * (1 + 1e-12)
    back, cost = b[::-1], np.empty((min(n, m), *shape))
    # Cell i of a diagonal is at place i + 1; before the first diagonal lies the corner that all ways come from.
    last, older, now = (np.full((n + 1, *shape), np.inf) for _ in range(3))
    older[0] = 0.0
    over = lambda total, i, j: np.sqrt(total) if squared else total / (i + j)
    for k in range(n + m - 1):
        low, high = max(0, k - m + 1), min(n, k + 1)
        step = cost[: high - low]
        np.subtract(a[low:high], back[m - 1 - k + low : m - 1 - k + high], out=step)
        np.multiply(step, step, out=step) if squared else np.abs(step, out=step)
        cells = now[low + 1 : high + 1]
        np.minimum(last[low + 1 : high + 1], last[low:high], out=cells)
        np.minimum(cells, older[low:high], out=cells)
        cells += step
        now[low] = np.inf
        if high < n:
            now[high + 1] = np.inf
        last, older, now = now, last, older
        if k % 2 == 0 and k // 2 + 1 in starts:
            told[k // 2 + 1] = over(last[k // 2 + 1], k // 2 + 1, k // 2 + 1)
        if most is not None and k % 8 == 7:
            fit = np.minimum(last[low : high + 1].min(0), older[low : high + 1].min(0)) <= most
            if fit.sum() < 0.7 * len(fit):
                alive, most, a, back, cost, last, older, now = alive[fit], most[fit], *(x[:, fit] for x in (a, back, cost, last, older, now))
                if not len(alive):
                    return out
    end = over(last[n] if most is None else np.where(last[n] <= most, last[n], np.inf), n, m)
    if alive is None:
        return [*(told[i] for i in starts), end] if starts else end
    out[alive] = end
    return out


def warped(x: np.ndarray, y: np.ndarray, squared: bool = False, at_once: int = 2_048, starts: tuple[int, ...] = ()) -> np.ndarray | list[np.ndarray]:
    """Warped distances of all rows of ``x`` to all of ``y``, some thousand pairs at a time; with ``starts`` those of the first so many values before it."""
    out, xt, yt = [np.empty((len(x), len(y))) for _ in (*starts, 0)], np.ascontiguousarray(np.transpose(x)), np.ascontiguousarray(np.transpose(y))
    wide = max(1, min(len(y), at_once))
    tall = max(1, at_once // wide)
    for i in range(0, len(x), tall):
        for j in range(0, len(y), wide):
            found = warped_of(xt[:, i : i + tall, None], yt[:, None, j : j + wide], squared, None, starts)
            for o, f in zip(out, found if starts else [found], strict=True):
                o[i : i + tall, j : j + wide] = f
    return out if starts else out[0]


def least_warped(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A lower bound of the warped distances of all rows of ``x`` to all of ``y``.

    The first values meet and so do the last; and each value costs at least what it lies outside the other's range.
    """

    def outside(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high, out = b.min(1), b.max(1), np.empty((len(a), len(b)))
        for k, row in enumerate(np.sort(a, 1)):
            sums = np.concatenate([[0.0], np.cumsum(row)])
            over, under = np.searchsorted(row, high, "right"), np.searchsorted(row, low, "left")
            out[k] = sums[-1] - sums[over] - (len(row) - over) * high + under * low - sums[under]
        return out

    ends = np.abs(x[:, :1] - y[None, :, 0])
    if x.shape[1] > 1 or y.shape[1] > 1:
        ends = ends + np.abs(x[:, -1:] - y[None, :, -1])
    return np.maximum(ends, np.maximum(outside(x, y), outside(y, x).T)) / (x.shape[1] + y.shape[1])


def nearest_warped(x: np.ndarray, y: np.ndarray, k: int, own: np.ndarray, at_once: int = 2_048) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, distances) of the ``k`` rows of ``y`` nearest to each row of ``x`` by warped distance, ties to the first; ``own`` marks pairs that do not count."""
    bound = np.where(own, np.inf, least_warped(x, y) * (1 - 1e-9) - 1e-12)
    d, xt, yt = np.full(bound.shape, np.inf), np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)

    def compute(i: np.ndarray, j: np.ndarray, limit: np.ndarray | None) -> None:
        for at in range(0, len(i), at_once):
            p, q = i[at : at + at_once], j[at : at + at_once]
            d[p, q] = warped_of(xt[:, p], yt[:, q], False, None if limit is None else limit[p])

    first = np.argsort(bound, axis=1, kind="stable")[:, : 2 * k]
    i, j = np.repeat(np.arange(len(x)), first.shape[1]), first.ravel()
    seen = np.isfinite(bound[i, j])
    compute(i[seen], j[seen], None)
    worst = np.sort(d, 1)[:, k - 1] if len(y) >= k else np.full(len(x), np.inf)
    open_ = (bound <= worst[:, None]) & np.isfinite(bound)
    open_[i, j] = False
    compute(*np.nonzero(open_), worst)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return [(o[np.isfinite(r[o])], r[o][np.isfinite(r[o])]) for o, r in zip(order, d, strict=True)]


def _warping_path(x: np.ndarray, y: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[float, list[tuple[int, int]]]:
    """(cost, cells) of the cheapest warping that stays within places ``low`` to ``high`` (exclusive) of y in each row of x."""
    rows, before = [], np.array([0.0])
    first, last = -1, 0  # the row before the first one: a single cell, to which all lead back
    for i in range(len(x)):
        a, b = int(low[i]), int(high[i])
        cost = np.abs(x[i] - y[a:b])
        now = np.empty(b - a)
        for k in range(b - a):
            j = a + k
            up = before[j - first] if first <= j < last else np.inf
            across = before[j - 1 - first] if first <= j - 1 < last else np.inf
            now[k] = cost[k] + min(up, across, now[k - 1] if k else np.inf)
        rows.append((a, now))
        before, first, last = now, a, b
    i, j, cells = len(x) - 1, len(y) - 1, []
    at = lambda i, j: rows[i][1][j - rows[i][0]] if i >= 0 and 0 <= j - rows[i][0] < len(rows[i][1]) else np.inf
    while i > 0 or j > 0:
        cells.append((i, j))
        _, i, j = min((at(i - 1, j - 1), i - 1, j - 1), (at(i - 1, j), i - 1, j), (at(i, j - 1), i, j - 1), key=lambda c: c[0])
    return float(rows[-1][1][-1]), [(0, 0), *reversed(cells)]


def fast_warped(x: np.ndarray, y: np.ndarray, radius: int = 1) -> float:
    """Warped distance (absolute cost over the summed lengths) along a way refined from coarse to fine; never below the exact one.

    Both series are halved until they are short, warped there, and the way is
    searched again at each finer step within ``radius`` of where it was, so the
    work grows with the length and not with its square.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    levels = [(x, y)]
    while min(map(len, levels[-1])) > radius + 2:
        levels.append(tuple(np.add.reduceat(v, np.arange(0, len(v), 2)) / np.minimum(2, len(v) - np.arange(0, len(v), 2)) for v in levels[-1]))
    cost, path = 0.0, None
    for a, b in reversed(levels):
        low, high = np.zeros(len(a), int), np.full(len(a), len(b))
        if path is not None:
            low, high = np.full(len(a), len(b)), np.zeros(len(a), int)
            for i, j in path:
                rows = slice(max(0, 2 * (i - radius)), min(len(a), 2 * (i + radius) + 2))
                low[rows] = np.minimum(low[rows], max(0, 2 * (j - radius)))
                high[rows] = np.maximum(high[rows], min(len(b), 2 * (j + radius) + 2))
        cost, path = _warping_path(a, b, low, high)
    return cost / (len(x) + len(y))


def spaced_peaks(x: np.ndarray, distance: int, height: float | None = None) -> np.ndarray:
    """Strict local maxima (a plateau counts at its middle), highest first, none nearer than ``distance`` to a higher one."""
    x = np.asarray(x, float)
    if len(x) < 3:
        return np.empty(0, int)
    # Runs of equal values: a run is a peak when both neighbours are lower.
    starts = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1])
    ends = np.concatenate([starts[1:], [len(x)]]) - 1
    inner = (starts > 0) & (ends < len(x) - 1)
    s, e = starts[inner], ends[inner]
    top = (x[s - 1] < x[s]) & (x[e + 1] < x[e])
    at = (s[top] + e[top]) // 2
    if height is not None:
        at = at[x[at] >= height]
    keep = np.ones(len(at), bool)
    for k in np.argsort(x[at], kind="stable")[::-1]:
        if keep[k]:
            near = np.abs(at - at[k]) < distance
            near[k] = False
            keep &= ~near
    return at[keep]


def highest_peaks(x: np.ndarray) -> np.ndarray:
    """Of each row the height of its highest strict local maximum, a plateau being one too; none: 0. It is what :func:`spaced_peaks` takes first, at any distance."""
    best, rising = np.full(len(x), -np.inf), np.zeros(len(x), bool)
    for j in range(1, x.shape[1]):
        up, down = x[:, j] > x[:, j - 1], x[:, j] < x[:, j - 1]
        top = rising & down
        best[top] = np.maximum(best[top], x[top, j - 1])
        rising = (rising & ~down) | up
    return np.where(best > -np.inf, best, 0.0)


def mean_trailing_deviations(x: np.ndarray, n: int) -> np.ndarray:
    """Of each row the mean of its sample deviations over the ``n`` values up to each place, fewer at its start; the first, which has none, is skipped."""
    total, size = np.zeros(len(x)), x.shape[1]
    for j in range(1, size):
        total += x[:, max(0, j + 1 - n) : j + 1].std(1, ddof=1) if n > 1 else np.nan
    return total / (size - 1) if size > 1 else np.full(len(x), np.nan)


def kept_peaks(x: np.ndarray, distance: int, valleys: bool = False) -> np.ndarray:
    """Maxima that are no lower than both neighbours, by magnitude, each ``distance`` or more from all kept before it."""
    x = -np.asarray(x, float) if valleys else np.asarray(x, float)
    if len(x) < 3:
        return np.empty(0, int)
    at = np.flatnonzero((x[1:-1] >= x[:-2]) & (x[1:-1] >= x[2:])) + 1
    kept: list[int] = []
    for k in at[np.argsort(-np.abs(x[at]), kind="stable")]:
        if all(abs(k - o) >= distance for o in kept):
            kept.append(int(k))
    return np.array(sorted(kept), int)


def suppressed(at: np.ndarray, rank: np.ndarray, tie: np.ndarray, state: np.ndarray, own: np.ndarray, distance: int) -> np.ndarray:
    """States (0 undecided, 1 stays, 2 gone) of candidates in order of place, as far as they can be told.

    Only ``own`` candidates are decided, as only they see all others within the
    distance; the highest goes first, so what it hangs on has been looked at.
    """
    state = state.copy()
    low, high = np.searchsorted(at, at - distance, "right"), np.searchsorted(at, at + distance, "left")
    order = np.lexsort((-tie, -rank))
    place = np.empty(len(at), int)
    place[order] = np.arange(len(at))
    for i in order:
        if state[i] or not own[i]:
            continue
        near = slice(low[i], high[i])
        if (state[near] == 1).any():
            state[i] = 2
        elif not ((state[near] == 0) & (place[near] < place[i])).any():
            state[i] = 1
    return state


# The decomposition low-pass filter of the Daubechies wavelet with six vanishing moments.
DB6 = np.array([-0.00107730108499558, 0.004777257511010651, 0.0005538422009938016, -0.031582039318031156, 0.02752286553001629, 0.09750160558707936, -0.12976686756709563, -0.22626469396516913, 0.3152503517092432, 0.7511339080215775, 0.4946238903983854, 0.11154074335008017])


def _analyse(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(low)
    index = np.arange(-(n - 1), len(x) + n - 1)
    period = 2 * len(x)
    folded = np.mod(index, period)
    ext = x[np.where(folded < len(x), folded, period - 1 - folded)]
    conv = lambda f: np.convolve(ext, f, "valid")[1::2]
    return conv(low), conv(high)


def _synthesise(a: np.ndarray, d: np.ndarray, low: np.ndarray, high: np.ndarray, size: int) -> np.ndarray:
    n = len(low)
    up = lambda c: np.stack([c, np.zeros_like(c)], 1).ravel()[:-1]
    full = np.convolve(up(a), low) + np.convolve(up(d), high)
    return full[n - 2 : n - 2 + size]


def details(x: np.ndarray) -> np.ndarray:
    """The finest band; coefficient k ends at row 2 k + 1."""
    return _analyse(np.asarray(x, float), DB6, DB6[::-1] * np.where(np.arange(len(DB6)) % 2 == 0, -1.0, 1.0))[1]


def denoised(x: np.ndarray, level: int = 3, factor: float = 0.5, cut: float | None = None) -> np.ndarray:
    """Soft thresholds on all wavelet bands (db6, symmetric ends); the threshold comes from the finest band unless it is given."""
    x = np.asarray(x, float)
    if len(x) < 2:
        return x.copy()
    low = DB6
    high = low[::-1] * np.where(np.arange(len(low)) % 2 == 0, -1.0, 1.0)
    sizes, bands, a = [], [], x
    for _ in range(level):
        sizes.append(len(a))
        a, d = _analyse(a, low, high)
        bands.append(d)
    if cut is None:
        cut = factor * np.median(np.abs(bands[0])) / 0.6745
    soft = lambda c: np.sign(c) * np.maximum(np.abs(c) - cut, 0)
    a = soft(a)
    for d, size in zip(reversed(bands), reversed(sizes), strict=True):
        a = _synthesise(a[: len(d)], soft(d), low[::-1], high[::-1], size)
    return a


def gaussian(x: np.ndarray, sigma: float, truncate: float = 4.0) -> np.ndarray:
    """Gaussian smoothing with mirrored ends."""
    x = np.asarray(x, float)
    r = int(truncate * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(x, r, "symmetric"), k / k.sum(), "valid") if len(x) else x


def polynomial_smooth(x: np.ndarray, window: int, order: int) -> np.ndarray:
    """Savitzky-Golay smoothing; the ends take the values of the end windows' own polynomials."""
    x = np.asarray(x, float)
    if len(x) < window:
        return x.copy()
    half, t = window // 2, np.arange(window) - window // 2
    fit = np.linalg.pinv(np.vander(t, order + 1, increasing=True))
    out = np.convolve(x, fit[0][::-1], "same")
    design = np.vander(t, order + 1, increasing=True)
    out[:half] = (design @ (fit @ x[:window]))[:half]
    out[-half:] = (design @ (fit @ x[-window:]))[-half:]
    return out


def magnetic(x: np.ndarray, sigma: float = 2.0) -> np.ndarray:
    """Fill, denoise, smooth, standardise by the sample deviation."""
    x = np.asarray(x, float)
    at = np.flatnonzero(~np.isnan(x))
    if not len(at):
        return np.zeros_like(x)
    x = x[at[np.clip(np.searchsorted(at, np.arange(len(x)), "right") - 1, 0, None)]]
    y = gaussian(denoised(x), sigma)
    sd = y.std(ddof=1) if len(y) > 1 else 0.0
    return (y - y.mean()) / (sd if sd > 0 else 1.0)


def filled(values) -> np.ndarray:
    """Forward, then backward; without any value zeros."""
    x = np.array([np.nan if v is None else v for v in values], float)
    at = np.flatnonzero(~np.isnan(x))
    return x[at[np.clip(np.searchsorted(at, np.arange(len(x)), "right") - 1, 0, None)]] if len(at) else np.zeros(len(x))


def centred_mean(x: np.ndarray, window: int) -> np.ndarray:
    """Means over the window around each value, of what there is of it at the ends."""
    half, sums = window // 2, np.concatenate([[0.0], np.cumsum(x)])
    low, high = np.maximum(np.arange(len(x)) - half, 0), np.minimum(np.arange(len(x)) + half + 1, len(x))
    return (sums[high] - sums[low]) / (high - low)


def row_standard(values, window: int = 5) -> np.ndarray:
    """A list filled, smoothed and standardised by the population deviation (0: only centred)."""
    x = centred_mean(filled(values), window)
    sd = x.std() if len(x) else 0.0
    return (x - (x.mean() if len(x) else 0.0)) / (sd if sd > 1e-12 else 1.0)


def components(x: np.ndarray, k: int) -> np.ndarray:
    """Principal components by a centred SVD; the largest loading of each is positive, so results do not flip."""
    x = np.asarray(x, float)
    x = x - x.mean(0)
    _, _, v = np.linalg.svd(x, full_matrices=False)
    v = v[: min(k, *x.shape)]
    v = v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None]
    return x @ v.T


def linked_starts(x: np.ndarray, cut: float) -> np.ndarray:
    """For each of the ascending values ``x`` the place of its cluster's first: neighbouring clusters join, narrowest span first, up to ``cut``.

    A heap holds the spans of neighbours; one that has changed since is passed over.
    """
    n = len(x)
    last, after, before = np.arange(n), np.arange(1, n + 1), np.arange(-1, n - 1)
    spans = [(x[i + 1] - x[i], i, i + 1) for i in range(n - 1)]
    heapq.heapify(spans)
    while spans and spans[0][0] <= cut:
        span, a, end = heapq.heappop(spans)
        b = after[a]
        # Gone, or one of the two has grown: then another entry stands for it.
        if last[a] < a or b >= n or last[b] != end or span != x[end] - x[a]:
            continue
        last[a], after[a], last[b] = end, after[b], -1
        if after[a] < n:
            before[after[a]] = a
            heapq.heappush(spans, (x[last[after[a]]] - x[a], a, last[after[a]]))
        if before[a] >= 0:
            heapq.heappush(spans, (x[end] - x[before[a]], int(before[a]), end))
    starts = np.flatnonzero(last >= np.arange(n))
    return np.repeat(starts, np.diff(np.append(starts, n)))


def complete_linkage(x: np.ndarray, cut: float) -> np.ndarray:
    """Labels of agglomerative clusters on a line, ascending, joined while their farthest members are within ``cut``."""
    x = np.asarray(x, float)
    order = np.argsort(x, kind="stable")
    out = np.empty(len(x), int)
    out[order] = np.unique(linked_starts(x[order], cut), return_inverse=True)[1]
    return out


def greedy_steps(x: np.ndarray, height: float, distance: int = 20) -> list[int]:
    """Peaks from left to right: one within ``distance`` of the last replaces it if it is higher."""
    kept: list[int] = []
    for i in range(1, len(x) - 1):
        if x[i] >= height and x[i] > x[i - 1] and x[i] >= x[i + 1]:
            if kept and i - kept[-1] < distance:
                if x[i] > x[kept[-1]]:
                    kept[-1] = i
            else:
                kept.append(i)
    return kept


def debounced(flags: np.ndarray, gap: int) -> list[int]:
    """Places of set flags, each at least ``gap`` after the last one taken."""
    out: list[int] = []
    for i in np.flatnonzero(flags):
        if not out or i - out[-1] >= gap:
            out.append(int(i))
    return out
