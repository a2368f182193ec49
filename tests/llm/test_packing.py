from __future__ import annotations

import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from claimflow.llm import packing


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
@settings(max_examples=60, deadline=None)
def test_plan_is_a_best_fit_packing(counts):
    slots, opened = packing.best_fit_plan(counts, 64)
    held: dict[int, list[tuple[int, int]]] = {}
    for length, first, last, each, run, offset in slots:
        for k in range(last - first):
            held.setdefault(run + k // each, []).append((offset + k % each * length, length))
    got: dict[int, int] = {}
    for length, first, last, *_ in slots:
        got[length] = got.get(length, 0) + last - first
    assert got == counts
    assert set(held) == set(range(opened))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    # Best-fit decreasing, one item at a time.
    rooms: list[int] = []
    for length in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fit = [r for r in rooms if r >= length]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - length)
        else:
            rooms.append(64 - length)
    assert len(rooms) == opened


def test_plan_stays_small():
    slots, _ = packing.best_fit_plan({n: 10**9 + n for n in range(1, 2049)})
    assert len(slots) < 4 * 2048


def test_fast_ids_are_the_ids_of_the_file():
    from tokenizers import Tokenizer

    path = packing.default_vocabulary()
    slow, enc = Tokenizer.from_file(path), packing.Encoder(path)
    for text in ["", "a", "don't  stop\n\n\tit's 123 ümläut été <|endoftext|> x", " " * 50, "ab" * 3000, "日本語 текст 🙂\r\n"]:
        assert enc.ids(text).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_pack_round_trip(docs_of, words):
    rows = [(1, words(9000, 1)), (2, None), (2, None), (3, ""), (None, "x y"), (4, words(700, 2)), (5, words(700, 2)), *[(10 + i, words(40 + i, i)) for i in range(40)]]
    got = packing.pack(docs_of(rows)).collect()
    enc = packing.encoder(packing.default_vocabulary())
    by_doc: dict = {}
    by_sequence: dict = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc_id, text in dict(rows).items():
        ids = np.append(enc.ids(text or ""), np.uint32(0)).astype("<u4")
        pieces = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        if doc_id == 2:
            assert len(pieces) == 2 and all(p["length"] == 1 for p in pieces)
            continue
        assert [p["piece"] for p in pieces] == list(range(len(pieces)))
        for p in pieces:
            part = ids[p["start"] : p["start"] + p["length"]]
            assert p["ids_crc32"] == zlib.crc32(part.tobytes())
        assert sum(p["length"] for p in pieces) == len(ids)
        assert all(p["length"] == 2048 for p in pieces[1:])
    for places in by_sequence.values():
        at = 0
        for p in sorted(places, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
    assert len(by_sequence) <= -(-sum(r["length"] for r in got) // 2048) + 1


def test_empty_table(docs_of):
    assert packing.pack(docs_of([])).count() == 0
