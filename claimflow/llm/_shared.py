"""Helpers that the operators of this package share.

Lineage is cut by writing tables into the shared folder that the session names
in ``spark.checkpoint.dir``: every executor and the driver see that folder, so
a lost executor costs a re-read and never a lost block.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows in one Arrow batch handed to Python; bounds a worker's memory by texts, not by partitions.
ROWS_PER_BATCH = 1000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a folder of our own only where none is set and all tasks run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="claimflow-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Paths handed out since the last :func:`new_chain` of this thread, so that a chain of stages can give its disk back.
_handed: ContextVar[list[str] | None] = ContextVar("handed", default=None)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def scratch_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path in the shared folder, deleted when the driver ends; with ``keep`` no chain of stages takes it away before."""
    folder = f"{shared_dir(spark)}/claimflow/{spark.sparkContext.applicationId}"
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    files, where = _file_system(spark, folder)
    files.mkdirs(where)
    files.deleteOnExit(where)
    if not keep and _handed.get() is not None:
        _handed.get().append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of our own in the shared folder, on whatever file system that is."""
    files, where = _file_system(spark, path)
    files.delete(where, True)


def new_chain() -> None:
    """Begins a chain of stages: what was handed out before stays until the driver ends."""
    _handed.set([])


def drop_scratch(spark: SparkSession) -> None:
    """Deletes what was handed out since the chain began: only when every result that reads it has been written."""
    for path in _handed.get() or ():
        remove(spark, path)
    if _handed.get() is not None:
        new_chain()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again (cuts the lineage)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session: one number for all operators, as plans read it only when they run."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


#: What counts as a word for the operators that compare words: letters and digits of ASCII in lower case, and everything beyond ASCII.
LOWER_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z in lower case; no other letter changes."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_array(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LOWER_WORD), F.lit(0))


def need(df: DataFrame, names: Iterable[str]) -> None:
    """Raises when a column that an operator reads is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def free_prefix(df: DataFrame) -> str:
    """A prefix that no column of ``df`` has: names behind it clash with none."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def exclusive_sums(df: DataFrame, within: list[str], fine: str, order: list[str], amount: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``amount`` over the rows before each row, in the order of (``fine``, ``order``).

    ``fine`` numbers bins of bounded width. Rows are summed per bin first, the
    bins' sums are accumulated, and only the rows of one bin are ordered
    together, so that no task sees all rows of a ``within`` group. Ties in
    ``order`` may come in any order; the sums then stay gapless all the same.
    """
    keys = [*within, fine]
    bins = df.groupBy(*keys).agg(F.sum(amount).alias("__bin"))
    run = Window.partitionBy(*within).orderBy(fine) if within else Window.orderBy(fine)
    bins = bins.withColumn("__before", F.sum("__bin").over(run.rowsBetween(Window.unboundedPreceding, -1)))
    bins = bins.select(*keys, F.coalesce("__before", F.lit(0).cast("long")).alias("__before"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("__inside", F.coalesce(F.sum(amount).over(inside), F.lit(0).cast("long")))
    return rows.join(bins, keys).withColumn(out, F.col("__before") + F.col("__inside")).drop("__before", "__inside")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``, the place of each row from 0 in the order of all: a range sort, then places in a task plus counts by task.

    Rows that tie are told apart by where they come from, so that equal rows by the million are spread as well.
    """
    rows = df.withColumn("__from", F.monotonically_increasing_id()).orderBy(*order, "__from").drop("__from")
    rows = stored(rows.withColumn("__mono", F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumn("__task", F.shiftright("__mono", 33)).withColumn("__nth", F.col("__mono").bitwiseAND((1 << 33) - 1))
    # A row for each task; what is broadcast is as long as the sort had partitions.
    before = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = rows.groupBy("__task").agg(F.count("*").alias("__n")).select("__task", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return rows.join(F.broadcast(tasks), "__task").withColumn(name, F.col("__start") + F.col("__nth")).select(*df.columns, name)
