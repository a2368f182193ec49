from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import pytest

from claimflow.llm import queries, resampling


def plain_resampling(docs, target, buckets, longest, seed, percent, least):
    """The whole operator in plain Python."""

    def features(text):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
        return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    told = [(d, *features(t)) for d, t in docs]
    s, t = Counter(b for _, _, x in told for b in x), Counter(b for text in target for b in features(text)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets))))
    out = []
    for d, w, x in told:
        weight = sum(map(gain, x)) // len(x) if x else 0
        h = int(sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(w) >= least))
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = Counter()
    rows = []
    for place, r in enumerate(fit, 1):
        rows.append((*r[:4], place if place <= percent * len(fit) // 100 else None))
        drawn[r[:4]] += 1
    rows += [(*r[:4], None) for r in out if not r[4]]
    return sorted(rows, key=repr)


@pytest.mark.parametrize(("longest", "buckets"), [(1, 10_000), (3, 50)])
def test_against_plain_python(spark, docs_of, words, longest, buckets):
    rows = [(i, words(5 + i % 40, i)) for i in range(120)]
    rows += [(200, "Ünïcode ÄÖ wörter 日本語 und MEHR 123 " * 6), (201, ""), (202, None), (203, "!!! ..."), (204, "tiny"), (None, words(30, 1)), (None, words(30, 1)), (7, words(30, 99)), (7, words(30, 99)), (205, "A b\x00c\td " * 4000)]
    target = [words(50, 500), "tiny words", None, ""]
    got = resampling.resample(docs_of(rows), spark.createDataFrame([(t, 1, "x") for t in target], "text string, score int, rank string"), buckets=buckets, longest=longest, percent=25)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_resampling(rows, target, buckets, longest, 2024, 25, 20)


def test_documents_like_the_target_are_drawn(docs_of, words, spark):
    rows = [(i, words(200, i)) for i in range(300)] + [(1000 + i, "the old harbour sleeps under a grey winter sky " * 20) for i in range(30)]
    target = spark.createDataFrame([("the old harbour sleeps under a grey winter sky " * 5000,)], "text string")
    drawn = {r["doc_id"] for r in resampling.resample(docs_of(rows), target).where("rank is not null").collect()}
    # The noise lets others in, now and then.
    assert len(drawn) == 33 and len(drawn & set(range(1000, 1030))) >= 25


def test_ties_go_to_the_smaller_id_and_ranks_have_no_gaps(spark, docs_of, words):
    rows = [(5, words(40, 1))] * 50 + [(6, words(40, 1))] * 50
    got = resampling.resample(docs_of(rows), spark.createDataFrame([], "text string"), percent=60).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 61))
    plain = plain_resampling(rows, [], 10_000, 1, 2024, 60, 20)
    assert sorted((tuple(r) for r in got), key=repr) == plain


def test_no_rows_or_none_to_draw(spark, docs_of):
    none = docs_of([(1, "a b")]).where("doc_id < 0")
    target = spark.createDataFrame([("a",)], "text string")
    assert resampling.resample(none, target).count() == 0
    few = resampling.resample(docs_of([(1, "a b"), (2, None)]), target).collect()
    assert len(few) == 2 and all(r["rank"] is None for r in few)


def test_gains_are_one_literal(spark, docs_of):
    got = resampling.literal([3, -4]).alias("g")
    plan = spark.range(1).select(got)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "[3,-4]" in plan


def test_query_matches_sql(spark, sql_rows):
    assert sql_rows("op11_importance_resampling", queries.ORACLES) == sorted(repr(tuple(r)) for r in queries.op11_importance_resampling(spark, "/root/testdata/sf0.001").select("doc_id", "n_features", "weight", "score", "rank").collect())
