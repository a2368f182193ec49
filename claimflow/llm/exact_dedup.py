"""Exact deduplication by a stateful stream.

The rows run through Structured Streaming. A disk-backed (RocksDB) keyed state
without watermark or expiry retains for each digest the stable identifier that
stays, its content locator (file and row in the file) and the number of rows
seen. Rows that hit an older digest are then checked on their full bytes against
the content of the row that stays; a digest that two different texts share is
split by text. DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import need, remove, scratch_path, stored, text_or_empty

#: Input bytes of one micro-batch. A larger table runs through as several batches, each committed in the checkpoint.
BYTES_PER_TRIGGER = 64 << 30

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # A store takes the disk that it fills, and none once its batch is committed to the checkpoint.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}

#: For executors that hold what other stages of a pipeline left: smaller state buffers.
TIGHT = {"spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128", "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "16"}


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _state(spark: SparkSession, path: str, name: str, digest: Callable[[Column], Column], per_trigger: int, tight: bool) -> DataFrame:
    """(digest, keep, n): what the state, kept below the path ``name``, holds for each digest after all batches."""
    updates, checkpoint = f"{name}/updates", f"{name}/checkpoint"
    schema = spark.read.parquet(path).schema
    # As a pattern, so that a table of one file streams like one of a folder.
    table = path.rstrip("/")
    rows = spark.readStream.schema(schema).option("maxBytesPerTrigger", per_trigger).parquet(f"{table[:-1]}[{table[-1]}]")
    keyed = (
        rows.select("doc_id", digest(text_or_empty()).alias("digest"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        .groupBy("digest")
        .agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count("*").alias("n"))
    )
    settings = STATE | TIGHT if tight else STATE
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        query = (
            keyed.writeStream.outputMode("update")
            .trigger(availableNow=True)
            .option("checkpointLocation", checkpoint)
            .foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{updates}/batch={i}"))
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    first = "digest string, keep struct<doc_id:bigint,file:string,row:bigint>, n bigint, batch int"
    try:
        said = spark.read.schema(first).parquet(updates)
        said.schema  # noqa: B018
    except Exception as e:  # no batch ran: an empty table has no file to stream
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "digest string, keep struct<doc_id:bigint,file:string,row:bigint>, n bigint")
    # A later batch holds the newer state of a digest: both fields only grow.
    return said.groupBy("digest").agg(F.max("keep").alias("keep"), F.max("n").alias("n"))


def exact_dedup_path(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, per_trigger: int = BYTES_PER_TRIGGER, tight: bool = False) -> DataFrame:
    """Groups the rows of the parquet table at ``path`` by equal text.

    Reads ``doc_id`` (long) and ``text``; other columns are ignored. Returns one
    row for each row of the table: doc_id, file, row (the row's locator), digest,
    keep_id (doc_id of the row that stays: the largest of its group), group_size
    and kept. Null text counts as empty, so null and empty rows are one group;
    of rows that repeat a doc_id and its text exactly one stays, the one whose
    locator is largest; a null doc_id stays only in a group of nulls alone. An
    empty table gives no rows. ``tight`` spares memory: see TIGHT; texts are then dealt out but not sorted.
    """
    source = spark.read.parquet(path)
    need(source, ["doc_id", "text"])
    rows = source.select("doc_id", text_or_empty().alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    name = scratch_path(spark, "dedup-state")
    state = stored(_state(spark, path, name, digest, per_trigger, tight), "dedup-keys")
    remove(spark, name)
    narrow = stored(rows.select("doc_id", "file", "row", digest(F.col("text")).alias("digest")), "dedup-rows")
    told = narrow.join(state, "digest").select("*", ((F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))).alias("kept"))
    # Full bytes on hits: the text of each row of a shared digest against the text that stays.
    keepers = state.where("n > 1").select("digest", F.col("keep.file").alias("keep_file"), F.col("keep.row").alias("keep_row"))
    shared = stored(rows.withColumn("digest", digest(F.col("text"))).join(keepers.hint("shuffle_hash") if tight else keepers, "digest"), "dedup-shared")
    stay = shared.where("file = keep_file and row = keep_row").select("digest", F.col("text").alias("stay"))
    hits = shared.join(stay, "digest").select("doc_id", "file", "row", "digest", F.when(F.col("text") != F.col("stay"), F.col("text")).alias("other"))
    others = stored(hits.where("other is not null"), "dedup-collisions")
    if others.isEmpty():
        return told.select("doc_id", "file", "row", "digest", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), "kept")
    # Different texts under one digest: each text is a group of its own.
    split = others.groupBy("digest", "other").agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count("*").alias("n"))
    apart = others.join(split, ["digest", "other"]).select("doc_id", "file", "row", "digest", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), ((F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))).alias("kept"))
    less = others.groupBy("digest").agg(F.count("*").alias("less"))
    rest = told.join(others.select("file", "row"), ["file", "row"], "left_anti").join(less, "digest", "left")
    rest = rest.select("doc_id", "file", "row", "digest", F.col("keep.doc_id").alias("keep_id"), (F.col("n") - F.coalesce("less", F.lit(0))).alias("group_size"), "kept")
    return rest.unionByName(apart)


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, per_trigger: int = BYTES_PER_TRIGGER) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; see :func:`exact_dedup_path`.

    ``docs`` is spooled to the shared folder first, as a stream reads files.
    """
    need(docs, ["doc_id", "text"])
    spark = docs.sparkSession
    path = scratch_path(spark, "dedup-spool")
    # Under numbered names, so that no column hides a file's metadata or meets a name used here.
    names = [f"c{i}" for i in range(len(docs.columns))]
    at, text = docs.columns.index("doc_id"), docs.columns.index("text")
    names[at], names[text] = "doc_id", "text"
    spooled = docs.toDF(*names)
    spooled.write.parquet(path)
    gone = exact_dedup_path(spark, path, digest, per_trigger, tight=True).where("not kept").select(F.col("file").alias("__file"), F.col("row").alias("__row"))
    rows = spark.read.schema(spooled.schema).parquet(path)
    rows = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    return rows.join(gone.hint("shuffle_hash"), ["__file", "__row"], "left_anti").select(*names).toDF(*docs.columns)
