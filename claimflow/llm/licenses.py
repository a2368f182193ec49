"""License notices in texts, found although a few characters differ.

A notice that may have k errors is split into k + 1 pieces: in any place
within k errors one piece stands unchanged. One automaton finds all pieces of
all notices in a pass over the text; only around a hit are the spans of whole
words compared, by bounded-error matching.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import need, small_batches

#: A notice may have one error in so many characters; a shorter one has to stand as it is.
CHARS_AN_ERROR = 12


@dataclass(frozen=True)
class Notice:
    """A phrase of lower-case words that names a license; ``keys`` are words that have to be right, as they alone tell it from others."""

    label: str
    phrase: str
    keys: tuple[str, ...] = ()
    base: bool = False

    @property
    def errors(self) -> int:
        return len(self.phrase) // CHARS_AN_ERROR


# The three base phrases and their labels; then the notices of this scan.
NOTICES = (
    Notice("mit", "under the mit license", ("mit",), True),
    Notice("apache-2", "apache license version 2", ("2",), True),
    Notice("cc-by-nc", "cc by nc", (), True),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    Notice("gpl-2", "gnu general public license version 2", ("2",)),
    Notice("gpl-3", "gnu general public license version 3", ("3",)),
    Notice("lgpl", "gnu lesser general public license"),
    Notice("agpl", "gnu affero general public license"),
    Notice("bsd", "under the bsd license", ("bsd",)),
    Notice("mpl-2", "mozilla public license version 2", ("2",)),
    Notice("cc-by-sa", "cc by sa"),
    Notice("cc-by-nd", "cc by nd"),
    Notice("public-domain", "released into the public domain"),
)

# Letters and digits in lower case, any byte beyond ASCII as it is, everything else a blank.
_PLAIN = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


def plain_words(text: str) -> str:
    """The words of a text in lower case (A-Z only), one blank between them."""
    blanked = text.encode("utf-8", "surrogatepass").translate(_PLAIN)
    return re.sub(rb"  +", b" ", blanked).strip(b" ").decode("utf-8", "surrogatepass")


def pieces(phrase: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): the phrase in ``errors`` + 1 pieces of about equal length."""
    ends = [len(phrase) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, phrase[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


class Scanner:
    """Finds notices in plain words."""

    def __init__(self, notices: Sequence[Notice]) -> None:
        import ahocorasick
        import regex

        self.notices = list(notices)
        self.seeds = ahocorasick.Automaton()
        of: dict[str, list[tuple[int, int]]] = {}
        for number, notice in enumerate(self.notices):
            for offset, piece in pieces(notice.phrase, notice.errors):
                of.setdefault(piece, []).append((number, offset))
        for piece, asked in of.items():
            self.seeds.add_word(piece, (len(piece), asked))
        if of:
            self.seeds.make_automaton()
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(n.phrase, literal_spaces=True)}){{e<={n.errors}}}") for n in self.notices]

    def spans(self, plain: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, errors) of each span of whole words within a notice's errors, its key words among them."""
        starts: set[tuple[int, int]] = set()
        for last, (size, asked) in self.seeds.iter(plain) if self.seeds.kind else ():
            for number, offset in asked:
                reach, at = self.notices[number].errors, last + 1 - size - offset
                for s in range(max(0, at - reach), at + reach + 1):
                    if s == 0 or plain[s - 1] == " ":
                        starts.add((number, s))
        found = []
        for number, s in starts:
            notice = self.notices[number]
            size, reach = len(notice.phrase), notice.errors
            for e in range(s + size - reach, min(s + size + reach, len(plain)) + 1):
                if e != len(plain) and plain[e] != " " or plain[e - 1] == " ":
                    continue
                span = plain[s:e]
                match = self.patterns[number].fullmatch(span)
                if match and not set(notice.keys) - set(span.split(" ")):
                    found.append((number, s, e, sum(match.fuzzy_counts)))
        return found

    def places(self, plain: str) -> list[tuple[int, int, int, int]]:
        """Of spans that overlap and carry one label, the one with the fewest errors, then the first, then the shortest; in order."""
        # Spans of a label that are kept lie apart, so a new one can only meet its neighbours.
        kept: dict[str, list[tuple[int, int, int, int]]] = {}
        for number, s, e, errors in sorted(self.spans(plain), key=lambda x: (x[3], x[1], x[2], x[0])):
            same = kept.setdefault(self.notices[number].label, [])
            at = bisect(same, (s, e, number, errors))
            if (not at or same[at - 1][1] <= s) and (at == len(same) or e <= same[at][0]):
                same.insert(at, (s, e, number, errors))
        return [(number, s, e, errors) for s, e, number, errors in sorted(x for same in kept.values() for x in same)]


_scanners: dict[tuple[Notice, ...], Scanner] = {}


def scanner_of(notices: tuple[Notice, ...]) -> Scanner:
    """One scanner a worker."""
    if notices not in _scanners:
        _scanners[notices] = Scanner(notices)
    return _scanners[notices]


SPANS = "array<struct<label:string,base:boolean,first_word:bigint,last_word:bigint,errors:int,score:double>>"
_SPAN = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("errors", pa.int32()), ("score", pa.float64())])


def scan(docs: DataFrame, notices: Sequence[Notice] = NOTICES) -> DataFrame:
    """(doc_id, n_words, spans) for every row of ``docs`` (doc_id, text; other columns are ignored).

    ``spans`` lists the places of notices in order: label, base (the notice is a
    base one and stands there without errors), first and last word (from 0),
    errors in characters and score, the part of the notice's characters that is
    right. Null text counts as empty and has no words. Repeated rows and null
    doc_ids come back as they are. An empty table gives no rows, no notices give
    no spans. Nothing is shuffled, and a text is held once as plain words.
    """
    need(docs, ["doc_id", "text"])
    small_batches(docs.sparkSession)
    notices = tuple(notices)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanner_of(notices)
        for b in batches:
            counts, spans = [], []
            for text in b.column(1):
                plain = plain_words(text.as_py() or "")
                counts.append(plain.count(" ") + 1 if plain else 0)
                found, first, seen = [], 0, 0
                for number, s, e, errors in scanner.places(plain):
                    notice, first, seen = notices[number], first + plain.count(" ", seen, s), s
                    found.append((notice.label, notice.base and not errors, first, first + plain.count(" ", s, e), errors, 1 - errors / len(notice.phrase)))
                spans.append([dict(zip(("label", "base", "first_word", "last_word", "errors", "score"), f, strict=True)) for f in found])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(_SPAN))], ["doc_id", "n_words", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, f"doc_id long, n_words long, spans {SPANS}")
