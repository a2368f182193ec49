from __future__ import annotations

import random
import re

import pytest

from claimflow.llm import licenses, queries


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def plain_spans(plain, notices):
    """Every span of words against every notice."""
    words = plain.split(" ") if plain else []
    found = set()
    for number, n in enumerate(notices):
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                span = " ".join(words[i:j])
                if len(span) > len(n.phrase) + n.errors:
                    break
                e = distance(span, n.phrase)
                if e <= n.errors and set(n.keys) <= set(words[i:j]):
                    start = len(" ".join(words[:i])) + (i > 0)
                    found.add((number, start, start + len(span), e))
    return found


def spoiled(phrase, draw, times):
    for _ in range(times):
        k, c = draw.randrange(len(phrase)), draw.choice("aeinst 2é")
        phrase = draw.choice([phrase[:k] + c + phrase[k:], phrase[:k] + phrase[k + 1 :], phrase[:k] + c + phrase[k + 1 :]])
    return phrase


@pytest.mark.parametrize("seed", range(6))
def test_spans_by_brute_force(seed):
    draw = random.Random(seed)
    scanner = licenses.Scanner(licenses.NOTICES)
    for _ in range(12):
        parts = []
        for _ in range(6):
            parts.append(spoiled(draw.choice(licenses.NOTICES).phrase, draw, draw.randrange(5)))
            parts.append(draw.choice(["", "the", "license version 2", "under the", "cc by", "of any person", "zzz"]))
        plain = licenses.plain_words(" ".join(parts))
        assert set(scanner.spans(plain)) == plain_spans(plain, licenses.NOTICES)


def test_plain_words_by_pattern():
    draw = random.Random(2)
    for _ in range(200):
        text = "".join(draw.choice("aZ09 .,\n\t\x00\x7f@[`{é日😀ÄΣİ ") for _ in range(60))
        lowered = "".join(c.lower() if c < "\x80" else c for c in text)
        assert licenses.plain_words(text) == " ".join(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered))


def test_pieces_cover_a_phrase():
    for n in licenses.NOTICES:
        cut = licenses.pieces(n.phrase, n.errors)
        assert "".join(p for _, p in cut) == n.phrase and all(n.phrase[o:].startswith(p) for o, p in cut) and len(cut) == n.errors + 1


def spans_of(df):
    return {r["doc_id"]: [(x["label"], x["base"], x["first_word"], x["last_word"], x["errors"]) for x in r["spans"]] for r in df.collect()}


def test_whole_rows(docs_of):
    rows = [
        (1, "Released under the MIT License."),
        (2, "Released under the MIT Licence and, again, Under The MIT-License"),
        (3, "under the kit license; cc by no; GNU General Public License version 4"),
        (4, "Licensed under the Apachee License, Version 2.0"),
        (5, "CC BY-NC cc by nc 4.0 CC BY NC"),
        (6, None),
        (7, ""),
        (8, "..."),
        (9, "word " * 200_000 + "under the MIT license"),
        (10, "GNU Genral Public Licence version 3"),
        (None, "cc by nc"),
        (11, "under the mit license " * 2000),
    ]
    got = spans_of(licenses.scan(docs_of(rows)))
    assert got[1] == [("mit", True, 1, 4, 0)]
    assert got[2] == [("mit", False, 1, 4, 1), ("mit", True, 7, 10, 0)]
    assert got[3] == [] and got[6] == got[7] == got[8] == []
    assert got[4] == [("apache-2", False, 3, 6, 1)]
    assert [x[2] for x in got[5]] == [0, 3, 8]
    assert got[9] == [("mit", True, 200_000, 200_003, 0)]
    assert got[10] == [("gpl-3", False, 0, 5, 2)]
    assert got[None] == [("cc-by-nc", True, 0, 2, 0)]
    assert len(got[11]) == 2000 and got[11][-1][2] == 7996
    counts = {r["doc_id"]: r["n_words"] for r in licenses.scan(docs_of(rows)).collect()}
    assert (counts[1], counts[6], counts[7], counts[8], counts[9]) == (5, 0, 0, 0, 200_004)


def test_repeats_no_rows_no_notices(docs_of):
    twice = docs_of([(1, "cc by nc"), (1, "cc by nc"), (2, "clean text")])
    assert licenses.scan(twice).count() == 3
    assert licenses.scan(twice.where("doc_id > 5")).count() == 0
    assert all(not x for x in spans_of(licenses.scan(twice, ())).values())


def test_query_matches_sql(spark, sql_rows):
    got = queries.op13_license_scan(spark, "/root/testdata/sf0.001").collect()
    assert sql_rows("op13_license_scan", queries.ORACLES) == sorted(repr(tuple(r)) for r in got)
