from __future__ import annotations

import random
import re
from hashlib import sha256

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimflow.llm import infill, queries


def plain_infill(doc_id, text, seed=1, percent=90, suffix_first=20):
    """One document, by its list of units."""
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.DOTALL)
    h = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= percent:
        return (doc_id, n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < suffix_first:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abXYZ 1.\n<>PSMéß日😀\x00@[`{"), max_size=60), st.integers(-5, 10**12))
def test_one_text_by_its_units(text, doc_id):
    assert (doc_id, *infill.transformed(text, doc_id, 1, 90, 20)) == plain_infill(doc_id, text)


def test_every_cut_of_a_text():
    text = "ab  c, 日本é\n\nxyz9 Q😀"
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.DOTALL)
    held = infill.runs(text)
    assert held.n == len(units)
    assert [held.place(c) for c in range(held.n + 1)] == [len("".join(units[:c])) for c in range(len(units) + 1)]


def test_rows_and_round_trip(docs_of):
    draw = random.Random(1)
    texts = ["".join(draw.choice("abcXYZ  .,\n1é日😀<") for _ in range(draw.randint(0, 300))) for _ in range(200)]
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, "has <P> in it"), (903, "has <M>"), (None, "no id"), (5, texts[5]), (5, texts[5]), (904, "word " * 300_000), (905, "<<S"), (906, "a" * 1_000_000)]
    made = infill.fill_in_middle(docs_of(rows)).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in made), key=repr) == sorted((plain_infill(d, t) for d, t in rows), key=repr)
    assert sorted((r["doc_id"] or -1, r["back"]) for r in made) == sorted((d or -1, t or "") for d, t in rows)
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}


def test_no_rows(docs_of):
    assert infill.fill_in_middle(docs_of([(1, "a")]).where("doc_id < 0")).count() == 0


def test_long_outputs_are_handed_on_in_parts(docs_of, monkeypatch):
    monkeypatch.setattr(infill, "FLUSH", 10)
    assert infill.fill_in_middle(docs_of([(i, "some text here") for i in range(50)])).count() == 50


def test_query_matches_sql(spark, sql_rows):
    got = queries.op12_fill_in_middle(spark, "/root/testdata/sf0.001").collect()
    assert sql_rows("op12_fill_in_middle", queries.ORACLES) == sorted(repr(tuple(r)) for r in got)
