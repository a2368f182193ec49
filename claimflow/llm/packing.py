"""Best-fit packing of tokenised documents into sequences of a fixed length.

The plan is made over the histogram of piece lengths, never over documents:
best-fit decreasing places whole counts of a length at once, so that planning
takes as many steps as there are lengths, whatever the number of documents.
Documents then take the planned slots by joining on their rank within their
length.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import need, small_batches, stored

SEQUENCE = 2048
END_ID = 0

_encoders: dict = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def added_tokens(path: str) -> list[str]:
    """The special tokens that a tokenizers file lists; the vocabulary itself is not parsed."""
    text = Path(path).read_text(encoding="utf-8")
    at = text.find('"added_tokens"')
    if at < 0:
        return []
    listed, _ = json.JSONDecoder().raw_decode(text, text.index("[", at))
    return [t["content"] for t in listed]


class Encoder:
    """Ids of a text under a tokenizers file, special tokens not added.

    Where the folder also holds the same vocabulary as ranks (``.tiktoken``),
    that gives the same ids several times as fast; a text that spells out a
    special token goes through the tokenizers file, which has ids for those.
    """

    def __init__(self, path: str) -> None:
        self.path, self.slow, self.fast = path, None, None
        self.special = added_tokens(path)
        ranks = Path(path).with_suffix(".tiktoken")
        if ranks.exists():
            import public_tokenizers
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.read_bytes().splitlines() if line)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def _plain(self, text: str) -> np.ndarray:
        from tokenizers import Tokenizer

        # Loaded when first needed: a worker keeps one vocabulary in memory, not two.
        self.slow = self.slow or Tokenizer.from_file(self.path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, "<u4")
        if self.fast is None or any(s in text for s in self.special):
            return self._plain(text)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces_of(ids: np.ndarray, most: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of each piece: pieces of ``most`` ids, of which only the first may be shorter."""
    first = (len(ids) - 1) % most + 1
    return [(0, first), *((at, most) for at in range(first, len(ids), most))]


def token_pieces(docs: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) with each one's place in its task (part, nth of its length there)."""
    vocabulary = vocabulary or default_vocabulary()
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen, part = encoder(vocabulary), np.zeros(sequence + 1, np.int64), TaskContext.get().partitionId()
        for b in batches:
            at, piece, start, length, crc, nth = [], [], [], [], [], []
            for i, text in enumerate(b.column(1)):
                ids = np.append(enc.ids(text.as_py() or ""), np.uint32(end_id)).astype("<u4", copy=False)
                for k, (s, n) in enumerate(pieces_of(ids, sequence)):
                    at.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[s : s + n].tobytes()))
                    nth.append(int(seen[n]))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([part] * len(at), pa.int64()), pa.array(nth, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(each, "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long")


def best_fit_plan(counts: dict[int, int], sequence: int = SEQUENCE) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over counts of lengths.

    Returns slots (length, first, last, each, sequence_id, offset): pieces of
    this length with ranks first to last (exclusive) go ``each`` to a sequence,
    from sequence_id on, from offset on; and the number of sequences. Each
    length adds at most three runs of sequences that share a remaining room, so
    the plan has a few entries for each length whatever the counts.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}
    slots, opened = [], 0
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        left, first = counts[length], 0
        while left:
            room = next((r for r in range(length, sequence + 1) if rooms.get(r)), None)
            if room is None:
                room = sequence
                need_now = -(-left // (sequence // length))
                rooms.setdefault(sequence, []).append((opened, need_now))
                opened += need_now
            run, n = rooms[room].pop()
            each = room // length
            full = min(n, left // each)
            if full:
                slots.append((length, first, first + full * each, each, run, sequence - room))
                rooms.setdefault(room - each * length, []).append((run, full))
                left, first = left - full * each, first + full * each
                if n > full:
                    rooms[room].append((run + full, n - full))
            else:
                slots.append((length, first, first + left, left, run, sequence - room))
                rooms.setdefault(room - left * length, []).append((run, 1))
                if n > 1:
                    rooms[room].append((run + 1, n - 1))
                left = 0
    return slots, opened


def pack(docs: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Packs every row of ``docs`` (doc_id, text; other columns are ignored) into as few sequences as best-fit finds.

    A document is its ids and then ``end_id``; null text counts as empty and
    packs as the end id alone. Only documents longer than ``sequence`` are cut.
    Returns one row a piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset. Repeated rows are packed once each; a null doc_id is
    packed under null. An empty table gives no rows.
    """
    need(docs, ["doc_id", "text"])
    spark = docs.sparkSession
    pieces = stored(token_pieces(docs, vocabulary, sequence, end_id), "pieces")
    by_task = stored(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    # At most ``sequence`` rows reach the driver.
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, _ = best_fit_plan(counts, sequence)
    plan = spark.createDataFrame(slots, "length long, first long, last long, each long, run long, offset0 long")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth"))
    # The plan is bounded by the lengths (a few entries each), not by the documents.
    placed = ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    at = F.col("rank") - F.col("first")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        ranked["length"],
        "ids_crc32",
        (F.col("run") + F.expr("(rank - first) div each")).cast("long").alias("sequence_id"),
        (F.col("offset0") + (at % F.col("each")) * ranked["length"]).alias("offset"),
    )
