from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from claimflow.llm import mixing, sharding


def expected(sizes: dict, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > most * sizes[s]]
        for s in over or free:
            out[s] = most * sizes[s] if over else left * w[s] / total
        left -= sum(out[s] for s in over)
        free = free - set(over) if over else set()
    return out


def test_pivot_keeps_the_sum_and_the_chances():
    rng = np.random.default_rng(5)
    size, p = rng.integers(1, 50, 12), rng.random(12)
    hits = np.zeros(12)
    for _ in range(4000):
        out, left = mixing.pivot(p, size, rng.random(12))
        assert (out * size).sum() == pytest.approx((p * size).sum())
        assert sum(0 < x < 1 for x in out) == (left >= 0)
        hits += out
    assert np.allclose(hits / 4000, p, atol=0.04)


@pytest.mark.parametrize("bucket_rows", [20_000, 7])
def test_mix(docs_of, words, bucket_rows):
    """Also over a tree of several levels."""
    rows = [(i, words(3 + i % 40, i), [None, "b", "a", "zz", "é"][i % 5 if i % 2 else 0]) for i in range(300)]
    rows += [(900, None, "a"), (901, "", "b"), (902, words(5000, 1), "a"), (7, words(10, 7), "b"), (7, words(10, 7), "b"), (None, "x y z", "a"), (950, None, "void")]
    docs = docs_of(rows)
    got = mixing.mix(docs, bucket_rows=bucket_rows, fan_in=3).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    target, taken = expected(sizes), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 1
    again = mixing.mix(docs.repartition(5), bucket_rows=bucket_rows, fan_in=3).collect()
    key = lambda rows: sorted(map(str, rows))
    assert key(again) == key(got)


def test_mixed_rows(docs_of, words):
    docs = docs_of([(i, words(20 + i % 5, i), "ab"[i % 2]) for i in range(60)] + [(5, words(20, 5), "b"), (5, "other text", "b"), (None, None, None)])
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    copies = Counter(r["text"] for r in out.collect())
    assert max(copies.values()) <= 4
    assert mixing.mixed(docs_of([])).count() == 0
    assert mixing.mix(docs_of([(1, None, "a"), (2, " ", "b")])).agg({"taken": "sum"}).first()[0] == 0


def test_shards(docs_of, words):
    rows = [(i, words(5 + i % 90, i)) for i in range(600)]
    rows += [(1000 + i, words(50, 10_000 + i % 40)) for i in range(160)]
    rows += [(2000 + i, words(30, 1)) for i in range(300)]  # a group beyond any share
    rows += [(3000, None), (3001, ""), (3002, words(3000, 3)), (5, words(10, 5)), (None, "x")]
    got = sharding.shard(docs_of(rows)).collect()
    assert len(got) == len(rows)
    loads, slots, texts = Counter(), defaultdict(list), defaultdict(Counter)
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t in rows)
    crc = {zlib.crc32((t or "").encode()): t or "" for _, t in rows}
    for r in got:
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        texts[crc[r["text_crc32"]]][r["shard"]] += 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(loads.values()) - min(loads.values()) < 0.05 * np.mean(list(loads.values()))
    cut = [t for t, c in texts.items() if len(c) > 1]
    assert len(cut) <= 3
    # The largest group needs a little more than its share of shards.
    assert len(texts[words(30, 1)]) <= 4


def test_shards_of_few_rows(docs_of):
    assert sharding.shard(docs_of([])).count() == 0
    got = sharding.shard(docs_of([(1, "a"), (1, "a")])).collect()
    assert len(got) == 2 and len({r["shard"] for r in got}) <= 2
