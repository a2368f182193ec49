"""Fill-in-middle: documents cut at units and put in another order for training.

A unit is a word of ASCII letters or any other single character. The text is
held as maximal runs of letters and of other characters with the number of
units up to each run's end; a cut is found by binary search for its run and
arithmetic inside it, so that no list of units is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import need, small_batches

#: Marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
PERCENT = 90
SUFFIX_FIRST_PERCENT = 20
#: Characters of output after which a batch is handed on.
FLUSH = 16_000_000


@dataclass(frozen=True)
class Runs:
    """Maximal runs of one class: where each starts and ends, whether it is of letters, and the units up to its end."""

    starts: np.ndarray
    ends: np.ndarray
    letters: np.ndarray
    units: np.ndarray

    @property
    def n(self) -> int:
        return int(self.units[-1]) if len(self.units) else 0

    def place(self, cut: int) -> int:
        """The place in the text right after ``cut`` units."""
        if cut <= 0:
            return 0
        run = int(np.searchsorted(self.units, cut))
        # All units of a run of letters are its one word; of another run, each is one character.
        return int(self.ends[run]) if self.letters[run] else int(self.ends[run] - (self.units[run] - cut))


def runs(text: str) -> Runs:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = ((points | 32) - np.uint32(97)) < 26
    starts = np.concatenate([[0], np.flatnonzero(letter[1:] != letter[:-1]) + 1]) if len(points) else np.empty(0, np.int64)
    ends = np.append(starts[1:], len(points)) if len(points) else starts
    of_letters = letter[starts]
    return Runs(starts, ends, of_letters, np.cumsum(np.where(of_letters, 1, ends - starts)))


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers keyed by the seed and doc_id (null: an empty one)."""
    digits = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]


def transformed(text: str, doc_id: int | None, seed: int, percent: int, suffix_first: int) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    held = runs(text)
    n, (h1, h2, h3, h4) = held.n, draws(doc_id, seed)
    if not text or h3 % 100 >= percent or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = (held.place(c) for c in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < suffix_first:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = SEED, percent: int = PERCENT, suffix_first: int = SUFFIX_FIRST_PERCENT) -> DataFrame:
    """Every row of ``docs`` (doc_id, text; other columns are ignored) in a form for infilling.

    Returns doc_id, n (units), form, prefix_chars, middle_chars (code points;
    null where plain) and output. ``percent`` of the documents are cut, of these
    ``suffix_first`` percent come suffix first (spm), the others prefix first
    (psm). Null text counts as empty; empty texts and texts that hold a mark
    stay plain. Draws depend on doc_id alone, so repeated rows come out alike
    and a null doc_id draws like an empty one. An empty table gives no rows.
    Nothing is shuffled; a task holds one batch and, of one text at a time, its code points.
    """
    need(docs, ["doc_id", "text"])
    small_batches(docs.sparkSession)
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, held = [], 0
            for key, text in zip(b.column(0), b.column(1), strict=True):
                doc_id = key.as_py()
                out.append((doc_id, *transformed(text.as_py() or "", doc_id, seed, percent, suffix_first)))
                held += len(out[-1][-1])
                if held > FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(each, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from the output and its form alone."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    at = lambda i: F.get(part, F.lit(i))
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)
