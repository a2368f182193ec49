from __future__ import annotations

import random

import numpy as np
import pytest

from claimflow.llm import quality, toxicity

BAD = ["scumlike", "idiotic", "worthlessly"]


@pytest.fixture
def corpus(words):
    draw, rows, labels = random.Random(1), [], []
    for i in range(500):
        text, toxic = words(80, i), i % 5 == 0
        if toxic:
            w = text.split()
            w.insert(draw.randrange(80), draw.choice(BAD))
            text = " ".join(w)
        junk = i % 7 == 0
        if junk:
            text = "!! ".join(text.upper().split()) if i % 2 else " ".join(["again"] * 80)
        rows.append((i, text))
        labels.append((i, int(not junk), int(toxic and not (junk and i % 2 == 0))))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_quality_learns(spark, docs_of, corpus):
    rows, labels = corpus
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs_of([*rows, (900, None), (901, ""), (0, rows[0][1])]), spark.createDataFrame([*labels, (1, None, None), (None, 1, 1)], LABELS)).collect()}
    assert len(got) == 502
    assert np.mean([(got[d] >= 0.5) == bool(q) for d, q, _ in labels]) > 0.97
    assert got[900] == got[901] and 0 <= got[900] <= 1
    kept = quality.keep_good(docs_of(rows), spark.createDataFrame(labels, LABELS))
    assert np.mean([{r["doc_id"] for r in kept.collect()} >= {d} for d, q, _ in labels if q]) > 0.97


def test_quality_by_brute_force():
    rng = np.random.default_rng(3)
    n = len(quality.FEATURES)
    x = np.concatenate([rng.normal(0, 1, (60, n)), rng.normal(1.0, 2, (80, n))])
    y = np.repeat([0, 1], [60, 80])
    model = quality.fit(x, y, 0.3, 0.05)
    spread = x.std(0) + 1e-6
    z = (x - x.mean(0)) / spread
    covs = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = (covs[0] * 60 + covs[1] * 80) / 140
    logs = []
    for k in (0, 1):
        c = 0.7 * covs[k] + 0.3 * pooled
        c = 0.95 * c + 0.05 * np.trace(c) / n * np.eye(n)
        d = z - z[y == k].mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1] + np.log((y == k).mean()))
    assert np.allclose(model.log_odds(x), logs[1] - logs[0])


def test_one_class_or_no_labels(spark, docs_of):
    docs = docs_of([(1, "a b"), (2, "c")])
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in quality.score_quality(docs, none).collect()} == {0.5}
    assert {r["score"] for r in toxicity.score_toxicity(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], LABELS)
    assert all(r["score"] > 0.5 for r in quality.score_quality(docs, one).collect())
    assert all(r["score"] < 0.5 for r in toxicity.score_toxicity(docs, one).collect())
    assert quality.score_quality(docs_of([]), one).count() == 0
    assert toxicity.score_toxicity(docs_of([]), one).count() == 0


def test_toxicity_learns(spark, docs_of, corpus, words):
    rows, labels = corpus
    later = [(1000 + i, words(400, 9000 + i) + (f" {BAD[i % 3].upper()}!!" if i % 2 else "")) for i in range(100)]
    long = [(2000, words(30_000, 1)), (2001, words(30_000, 1) + " scumlike")]
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs_of([*rows, *later, *long, (3000, None), (3001, "")]), spark.createDataFrame(labels, LABELS)).collect()}
    assert np.mean([(got[1000 + i] >= 0.5) == bool(i % 2) for i in range(100)]) > 0.9
    assert got[2001] > got[2000]
    assert got[3000] == got[3001] and all(0 <= x <= 1 for x in got.values())


def test_look_ups_are_the_convolutions():
    """The scoring path against plain convolutions."""
    rng = np.random.default_rng(2)
    net = toxicity.train([], np.empty(0, int))
    net.words[:] = rng.normal(size=net.words.shape)
    net.out[:] = rng.normal(size=net.out.shape)
    docs = [(rng.integers(0, toxicity.WORD_BUCKETS, n), rng.integers(0, toxicity.STEM_BUCKETS, n), 0) for n in (1, 2, 3, 9, 40)]
    for (w, s, _), z in zip(docs, net.logits(docs), strict=True):
        x, h = net.words[w] + net.stems[s], []
        for k, f in zip(toxicity.WIDTHS, net.filters, strict=True):
            spans = [sum(x[i + o] @ f[o] for o in range(k)) for i in range(len(x) - k + 1)]
            h.append(np.max(spans, 0) if spans else np.zeros(toxicity.SETTINGS[0].filters))
        assert z == pytest.approx(np.maximum(np.concatenate(h) + net.shift, 0) @ net.out + net.bias, abs=1e-3)


def test_the_convolution_learns(corpus):
    """From random weights the untrained network tells nothing apart; what it knows comes from training."""
    rows, labels = corpus
    hashed = toxicity.Words()
    docs, y = [hashed(t) for _, t in rows], np.array([t for _, _, t in labels])
    new = np.arange(len(y)) % 4 == 0
    some, watched = [d for d, n in zip(docs, new, strict=True) if not n], ([d for d, n in zip(docs, new, strict=True) if n], y[new])

    def right(epochs):
        net = toxicity.train(some, y[~new], watched, epochs=epochs)
        toxicity.calibrate(net, some, y[~new])
        said = net.scores(watched[0]) >= 0.5
        return said[watched[1] == 1].mean(), said[watched[1] == 0].mean()

    assert right(0)[0] - right(0)[1] < 0.3
    caught, wrong = right(6)
    assert caught > 0.9 and wrong < 0.05


def test_the_setting_is_chosen_on_folds_of_the_learning_rows(spark, corpus, monkeypatch):
    """A setting that cannot learn is not taken, wherever it stands; too few rows take the first."""
    rows, labels = corpus
    hashed = toxicity.Words()
    docs, y = [hashed(t) for _, t in rows], np.array([t for _, _, t in labels])
    still = toxicity.Setting(rate=1e-9, row_rate=1e-9)
    monkeypatch.setattr(toxicity, "SETTINGS", (still, toxicity.Setting()))
    assert toxicity.chosen_setting(spark, docs, y) == toxicity.Setting()
    assert toxicity.chosen_setting(spark, docs[:12], y[:12]) == still


def test_repeated_ids_are_one_row_of_the_sample(spark, docs_of, corpus):
    """A doc_id that comes a thousand times gives training one text of it, whichever partition comes first."""
    rows, labels = corpus
    many = docs_of([*rows, *[(0, f"copy {i % 7}") for i in range(1000)]])
    x, y = quality.labelled(many, spark.createDataFrame(labels, LABELS), None)
    assert len(x) == len(y) == len({d for d, _ in rows})
    again, _ = quality.labelled(many.repartition(7), spark.createDataFrame(labels, LABELS), None)
    assert np.array_equal(x, again)
    assert np.isfinite(toxicity.learn_toxicity(many, spark.createDataFrame(labels, LABELS)).scores([hashed := toxicity.Words()("a b")])).all() and len(hashed) == 3


def test_training_words_are_bounded(spark, docs_of, corpus):
    """A text with more words than training may use is left out of it and scored all the same."""
    rows, labels = corpus
    docs = docs_of([*rows, (5000, "scumlike " * 50_000)])
    net = toxicity.learn_toxicity(docs, spark.createDataFrame([*labels, (5000, 1, 1)], LABELS), words=10_000)
    assert np.isfinite(net.scores([toxicity.Words()("a b")])).all()
    nothing = toxicity.learn_toxicity(docs, spark.createDataFrame(labels, LABELS), words=3)
    assert len(set(nothing.scores([toxicity.Words()(t) for _, t in rows[:9]]))) == 1
