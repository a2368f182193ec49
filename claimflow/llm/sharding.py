"""Sharding by balanced label propagation.

Documents start in shards drawn by hash. In each round every linked document
looks at its neighbours (documents of equal text, or any links given as groups)
and asks to move to the shard that holds most of their bytes; a shard accepts
no more bytes than its quota has left. Documents without links then fill the
shards up to equal size, counted in bins of a fixed number. Cut links become few while sizes stay even.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import exclusive_sums, need, stored, text_or_empty

SHARDS = 8
ROUNDS = 8
#: Bins in which bytes are counted for quotas: of group hashes, and of row hashes within each. A table of all bins and
#: shards is bounded by these numbers whatever the input, so it may meet the driver.
GROUP_BINS, ROW_BINS = 256, 16
POOL_BINS = 4096
#: Size classes that fill the shards, large rows first: each class evens out what the one before left.
CLASSES = (1 << 16, 1 << 13, 1 << 10, 0)


def _bin() -> Column:
    return (F.pmod("group_hash", F.lit(GROUP_BINS)) * ROW_BINS + F.pmod("row_hash", F.lit(ROW_BINS))).cast("int")


def documents_to_place(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, size, text_crc32, group_hash, row_hash, linked): one narrow row for each document."""
    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text).alias("digest"))
    rows = stored(rows.withColumn("uid", F.monotonically_increasing_id()), "shard-rows")
    # Written by itself, so that the join below has exchanges on both sides and a hot text can be split.
    groups = stored(rows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1"), "shard-groups")
    linked = rows.join(groups, "digest", "left").select("uid", "doc_id", "size", "text_crc32", F.xxhash64("digest").alias("group_hash"), F.xxhash64("doc_id", "uid").alias("row_hash"), F.col("n").isNotNull().alias("linked"))
    return stored(linked, "shard-links")


def propagate(linked: DataFrame, shards: int, room: float, rounds: int = ROUNDS) -> tuple[DataFrame, list[int]]:
    """Balanced label propagation over rows with group_hash, row_hash, size: adds ``shard``, under a quota of ``room`` bytes a shard.

    Each round asks for the shard with most bytes of a row's group among those
    with room left; a row moves only to where more of its group is. Requests to
    a shard are granted bin by bin, in the order of group hashes, while its quota lasts.
    """
    now = linked.withColumn("shard", F.pmod("row_hash", F.lit(shards)).cast("int"))
    loads, closed = _loads(now, shards), set()
    for _ in range(rounds):
        left = [max(0.0, room - x) for x in loads]
        # Nearly full, or refused all requests of a round: the next best shard is asked instead.
        closed |= {k for k in range(shards) if left[k] < room / 100}
        held = now.groupBy("group_hash", "shard").agg(F.sum("size").alias("held"))
        tie = F.pmod(F.xxhash64("group_hash", "shard"), F.lit(1 << 20)).alias("tie")
        place = F.struct("held", tie, "shard")
        open_now = F.element_at(F.array(*[F.lit(k not in closed) for k in range(shards)]), F.col("shard") + 1)
        held = held.withColumn("own", place).withColumn("best", F.max(F.when(open_now, place)).over(Window.partitionBy("group_hash")))
        # A full shard's rows also leave for as many of their group elsewhere: none of these can come to them.
        moves = (F.col("own") < F.col("best")) | (~open_now & (F.col("held") <= F.col("best.held")))
        wish = held.where(moves).select("group_hash", "shard", F.col("best.shard").alias("to"))
        asked = stored(now.join(wish, ["group_hash", "shard"], "left"), "shard-wishes").withColumn("bin", _bin())
        demand = asked.where("`to` is not null").groupBy("to", "bin", "shard").agg(F.sum("size").alias("s")).collect()
        by_bin: dict[tuple[int, int], dict[int, int]] = {}
        for r in demand:
            by_bin.setdefault((r["to"], r["bin"]), {})[r["shard"]] = r["s"]
        granted = []
        for (to, b), parts in sorted(by_bin.items()):
            if sum(parts.values()) <= left[to]:
                granted.append((to, b))
                left[to] -= sum(parts.values())
                loads[to] += sum(parts.values())
                for k, x in parts.items():
                    loads[k] -= x
        refused = {to for to, _ in by_bin} - {to for to, _ in granted}
        closed |= refused
        if not granted:
            now = asked.drop("to", "bin")
            if refused:
                continue
            break
        grants = linked.sparkSession.createDataFrame(granted, "to int, bin int")
        # At most shards * GROUP_BINS * ROW_BINS rows.
        moved = asked.join(F.broadcast(grants.withColumn("yes", F.lit(True))), ["to", "bin"], "left")
        now = stored(moved.withColumn("shard", F.when(F.col("yes"), F.col("to")).otherwise(F.col("shard"))).drop("to", "bin", "yes"), "shard-labels")
    return now, loads


def _loads(rows: DataFrame, shards: int) -> list[int]:
    got = rows.agg(*[F.sum(F.when(F.col("shard") == k, F.col("size"))).alias(f"s{k}") for k in range(shards)]).first()
    return [x or 0 for x in got]


def _released(placed: DataFrame, loads: list[int], share: float, shards: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows that stay, and rows of overfull shards (bins from the last one down) that go to the pool."""
    if max(loads) <= share:
        return placed, None
    binned = placed.withColumn("bin", _bin())
    gone, over = [], [x - share for x in loads]
    for r in sorted(binned.groupBy("shard", "bin").agg(F.sum("size").alias("s")).collect(), key=lambda r: (r["shard"], -r["bin"])):
        if over[r["shard"]] > 0:
            gone.append((r["shard"], r["bin"]))
            over[r["shard"]] -= r["s"]
            loads[r["shard"]] -= r["s"]
    marks = placed.sparkSession.createDataFrame(gone, "shard int, bin int")
    marked = binned.join(F.broadcast(marks.withColumn("out", F.lit(True))), ["shard", "bin"], "left").drop("bin")
    return marked.where("`out` is null").drop("out"), marked.where("`out`").drop("out", "shard")


def _filled(pool: DataFrame, loads: list[int], shards: int) -> DataFrame:
    """Adds ``shard``: bins of each size class, the large ones first, each to the shard that is emptiest by then."""
    size_class = F.lit(len(CLASSES) - 1)
    for k in reversed(range(len(CLASSES) - 1)):
        size_class = F.when(F.col("size") >= CLASSES[k], k).otherwise(size_class)
    pool = pool.withColumn("class", size_class).withColumn("bin", F.pmod("row_hash", F.lit(POOL_BINS)).cast("int"))
    bins = pool.groupBy("class", "bin").agg(F.sum("size").alias("s")).collect()
    heap = [(x, k) for k, x in enumerate(loads)]
    heapq.heapify(heap)
    to = []
    for r in sorted(bins, key=lambda r: (r["class"], -r["s"], r["bin"])):
        x, k = heapq.heappop(heap)
        to.append((r["class"], r["bin"], k))
        heapq.heappush(heap, (x + r["s"], k))
    told = pool.sparkSession.createDataFrame(to, "class int, bin int, shard int")
    # At most classes * POOL_BINS rows.
    return pool.join(F.broadcast(told), ["class", "bin"]).drop("class", "bin")


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Places every row of ``docs`` (doc_id, text; other columns are ignored) in one of ``shards`` shards.

    A row's size is its text's UTF-8 bytes plus 1, null counting as empty; rows
    of equal text are linked. Returns (doc_id, size, text_crc32, shard, slot);
    slots are gapless from 0 in each shard. Shards are even to about a bin of
    the smallest rows; a group larger than its share is cut, others keep together where the
    quota allows. Repeated rows are placed each; a null doc_id is placed too. An empty table gives no rows.
    """
    need(docs, ["doc_id", "text"])
    rows = documents_to_place(docs)
    names = ["uid", "doc_id", "size", "text_crc32", "group_hash", "row_hash"]
    total, any_linked = rows.agg(F.sum("size"), F.max("linked")).first()
    pool, whole, loads = rows.where("not linked").select(*names), None, [0] * shards
    if any_linked:
        share = (total or 0) / shards
        placed, loads = propagate(rows.where("linked").select(*names), shards, share, rounds)
        whole, out = _released(placed, loads, share, shards)
        pool = pool if out is None else pool.unionByName(out.select(*names))
    filled = _filled(pool, loads, shards).select(*names, "shard")
    whole = stored(filled if whole is None else filled.unionByName(whole.select(*names, "shard")), "shard-places")
    # Slots: places inside a task of the first reading, after all rows of the tasks before.
    ranked = whole.withColumn("task", F.shiftright("uid", 33)).withColumn("one", F.lit(1).cast("long"))
    slots = exclusive_sums(ranked, ["shard"], "task", ["uid"], "one", "slot")
    return slots.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot")
