"""Chat formatting by quotation linking, with DataFrame operations only.

Lines are parsed into nested quote levels, runs of a level are passages. A
passage's normalised text is hashed and looked up among the own texts of the
same conversation (whole texts, paragraphs, lines and sentences), which tells the message
it was taken from. A message then stands below the one it answers, without its
quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import need, stored, text_or_empty

# No repeated group in any pattern: a class of characters is matched in a loop, whatever the length of the line.
PREFIX = r"^[ \t>]*>"
QUOTING = r"(?:^|\n)[ \t]*>"
PARAGRAPH = r"\n[ \t]*\n"


def normalised(text: Column) -> Column:
    """White space folded, ends trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " ")))


def sentences(text: Column) -> Column:
    """The sentences of a text, white space folded: what stays of a passage that a mail client wrapped anew."""
    return F.split(F.regexp_replace(normalised(text), "([.!?]) ", "$1\n"), "\n")


def quote_level(line: Column) -> Column:
    return F.length(F.translate(F.regexp_extract(line, PREFIX, 0), " \t", ""))


def unquoted(text: Column) -> Column:
    """The lines of level 0, white space at both ends trimmed."""
    own = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(PREFIX)), "\n")
    return F.btrim(F.when(text.rlike(QUOTING), own).otherwise(text), F.lit(" \t\n\r"))


def passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, uid, passage, level, body): the quoted passages of ``messages`` in order."""
    line = messages.where(F.col("text").rlike(QUOTING)).select("conv_id", "turn", "uid", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = line.withColumn("level", quote_level(F.col("line"))).withColumn("body", F.regexp_replace("line", PREFIX, ""))
    own = Window.partitionBy("uid").orderBy("pos")  # the lines of one message
    line = line.withColumn("passage", F.sum((F.col("level") != F.lag("level", 1, -1).over(own)).cast("int")).over(own))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda x: x["body"]), "\n")
    return line.where("level > 0").groupBy("conv_id", "turn", "uid", "passage", "level").agg(lines.alias("body"))


def _index(messages: DataFrame) -> DataFrame:
    """(conv_id, hash, origin): the first turn of a conversation that has a text, paragraph, line or sentence of its own with this hash."""
    paragraphs = F.split("own", PARAGRAPH)
    units = F.array_distinct(F.concat(F.array("own"), paragraphs, F.split("own", "\n"), F.flatten(F.transform(paragraphs, sentences))))
    rows = messages.select("conv_id", "turn", F.explode(units).alias("unit")).withColumn("unit", normalised(F.col("unit"))).where("unit <> ''")
    return rows.groupBy("conv_id", F.md5("unit").alias("hash")).agg(F.min("turn").alias("origin"))


def quotation_links(messages: DataFrame, quoting: DataFrame) -> DataFrame:
    """(conv_id, turn, uid, passage, level, origin): the ``quoting`` passages with the earlier turn that they quote.

    A passage that is no whole text, paragraph, line or sentence goes to the turn that
    most of its lines come from, or else most of its sentences (ties: the
    smaller turn). Passages that are found in no earlier turn have no row.
    """
    talks = quoting.select("conv_id").distinct()
    index = _index(messages.join(talks, "conv_id", "left_semi"))
    body = F.col("body")
    parts = F.concat(
        F.array(F.struct(F.lit(0).alias("way"), normalised(body).alias("one"))),
        F.transform(F.split(body, "\n"), lambda x: F.struct(F.lit(1).alias("way"), normalised(x).alias("one"))),
        F.transform(sentences(body), lambda x: F.struct(F.lit(2).alias("way"), x.alias("one"))),
    )
    asked = quoting.select("conv_id", "turn", "uid", "passage", "level", F.explode(parts).alias("part")).where("part.one <> ''")
    asked = asked.select("conv_id", "turn", "uid", "passage", "level", "part.way", F.md5("part.one").alias("hash"))
    found = asked.join(index, ["conv_id", "hash"]).where("origin < turn")
    votes = found.groupBy("conv_id", "turn", "uid", "passage", "level", "way", "origin").agg(F.count("*").alias("n"))
    best = F.min_by("origin", F.struct("way", -F.col("n"), "origin"))
    return votes.groupBy("conv_id", "turn", "uid", "passage", "level").agg(best.alias("origin"))


def _roots(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, root, depth) by pointer doubling over (conv_id, turn, up): as many rounds as the depth has bits."""
    now = stored(replies.select("conv_id", "turn", F.col("up").alias("root"), F.lit(1).alias("depth")), "quote-roots")
    while True:
        on = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        ahead = now.join(on, ["conv_id", "root"], "left")
        now = stored(ahead.select("conv_id", "turn", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), "quote-roots")
        if now.where("moved").isEmpty():
            return now.drop("moved")


def reply_ordered(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text; other columns are ignored) in reply order, without quotes.

    Returns one row a message: conv_id, position, turn, role, text (own lines
    only), reply_to (the turn its outermost linked quote comes from, the latest
    one if it quotes several; null without a linked quote), thread (the turn
    reached over reply_to), depth (replies in between), quotes and linked (its
    passages, and those found). Positions run gapless from 0 through a
    conversation by thread, depth, turn: a reply stands below what it answers.
    Null text counts as empty. Rows with the same conversation and turn all
    come back; their links are theirs together. Rows with a null conv_id are
    one conversation without links; a null turn comes first and links nowhere.
    An empty table gives no rows.
    """
    need(conversations, ["conv_id", "turn", "role", "text"])
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", text_or_empty().alias("text"))
    rows = stored(rows.withColumn("uid", F.monotonically_increasing_id()).withColumn("own", unquoted(F.col("text"))), "quote-messages")
    quoting = stored(passages(rows), "quotes")
    links = stored(quotation_links(rows, quoting), "quote-links")
    outer = links.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "origin"))["origin"].alias("up"))
    roots = _roots(outer)
    told = outer.join(roots, ["conv_id", "turn"])
    quoted = quoting.groupBy("uid").agg(F.count("*").alias("quotes"))
    found = links.groupBy("uid").agg(F.count("*").alias("linked"))
    all_rows = rows.join(told, ["conv_id", "turn"], "left").join(quoted, "uid", "left").join(found, "uid", "left")
    all_rows = all_rows.select("uid", "conv_id", "turn", "role", F.col("own").alias("text"), F.col("up").alias("reply_to"), F.coalesce("root", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.coalesce("quotes", F.lit(0)).alias("quotes"), F.coalesce("linked", F.lit(0)).alias("linked"))
    # One sort deals a long conversation over many tasks; places then come from counts by task.
    sorted_rows = stored(all_rows.orderBy("conv_id", "thread", "depth", "turn", "uid").withColumn("mono", F.monotonically_increasing_id()), "quote-order")
    placed = sorted_rows.withColumn("task", F.shiftright("mono", 33)).withColumn("nth", F.col("mono").bitwiseAND((1 << 33) - 1))
    tasks = placed.groupBy("task").agg(F.count("*").alias("n"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = placed.join(tasks, "task").withColumn("place", F.col("start") + F.col("nth"))
    first = numbered.groupBy("conv_id").agg(F.min("place").alias("first")).withColumnRenamed("conv_id", "talk")
    out = numbered.join(first, F.col("conv_id").eqNullSafe(F.col("talk")))
    return out.select("conv_id", (F.col("place") - F.col("first")).alias("position"), "turn", "role", "text", "reply_to", "thread", "depth", "quotes", "linked")
