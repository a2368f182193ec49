"""Each stage of the pipeline against brute force on its own input, and the whole of it on small and empty tables."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from claimflow.llm import packing, quality, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def tables(spark, tmp_path, words):
    rows, labels = [], []
    for i in range(160):
        text = words(60 + i % 50, i)
        junk = i % 8 == 0
        if junk:
            text = "!! ".join(text.upper().split())
        rows.append((i, text))
        labels.append((i, int(not junk), 0))
    rows += [(200 + i, rows[1 + i % 3][1]) for i in range(20)]  # exact copies
    for i in range(30):  # near copies
        text, r = rows[9 + i][1].split(), random.Random(i)
        text[r.randrange(len(text))] = "changed"
        rows.append((300 + i, " ".join(text)))
    rows += [(400, None), (401, ""), (402, words(4000, 7)), (403, words(70, 403)), (None, words(70, 404)), (5, rows[5][1])]
    full = [(d, t, None if d == 403 else "en", None if d == 403 else f"s{(d or 0) % 4}", len(t or "")) for d, t in rows]
    spark.createDataFrame(full, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def rows_of(df):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", r["text"] is None, r["source"] or "") for r in df.collect()))


def test_stages_by_brute_force(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, tables)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/out{k}")
        seen[name] = (docs, spark.read.parquet(f"{tmp_path}/out{k}"))
        docs = seen[name][1]

    before, after = seen["quality"]
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    model = quality.fit(*quality.labelled(before, labels, None))
    good = [r for r in before.collect() if model.score(np.array([quality.statistics(r["text"])]))[0] >= 0.5]
    assert Counter(r["doc_id"] for r in good) == Counter(r["doc_id"] for r in after.collect())
    clean = {i for i in range(160) if i % 8} | {200 + i for i in range(20)}
    assert clean <= {r["doc_id"] for r in after.collect()}

    before, after = seen["exact_dedup"]
    largest = {}
    for r in before.collect():
        t, d = r["text"] or "", -1 if r["doc_id"] is None else r["doc_id"]
        largest[t] = max(largest.get(t, -1), d)
    assert Counter(largest.values()) == Counter(-1 if r["doc_id"] is None else r["doc_id"] for r in after.collect())

    before, after = seen["near_dedup"]
    items = [(r["doc_id"], set(simhash.shingle_hashes((r["text"] or "").lower().encode().split(), 5).tolist())) for r in before.collect() if r["doc_id"] is not None]
    kept = {r["doc_id"] for r in after.collect()}
    for d, s in items:
        like = [e for e, t in items if e < d and s and t and len(s & t) >= 0.8 * (len(s) * len(t)) ** 0.5 - 1e-9]
        assert (d not in kept) == bool(like), (d, like)

    before, after = seen["mixing"]
    copies = Counter((r["doc_id"], r["text"]) for r in after.collect())
    sizes, taken = Counter(), Counter()
    for r in before.collect():
        n = len((r["text"] or "").split())
        assert copies[(r["doc_id"], r["text"])] <= 2
        sizes[r["source"]] += n
        taken[r["source"]] += n * copies[(r["doc_id"], r["text"])]
    assert sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), rel=0.35)

    before, after = seen["packing"]
    enc = packing.encoder(packing.default_vocabulary())
    want = Counter()
    for r in before.collect():
        for k, (start, length) in enumerate(packing.pieces_of(np.append(enc.ids(r["text"] or ""), np.uint32(0)))):
            want[(r["doc_id"], k, start, length)] += 1
    assert want == Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in after.collect())


def test_run(spark, tables):
    got = corpus_pipeline.run(spark, tables)
    again = corpus_pipeline.run(spark, tables)
    key = lambda df: Counter((r["doc_id"], r["piece"], r["length"]) for r in df.collect())
    assert key(got) == key(again) and got.count() > 50


def test_run_on_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
