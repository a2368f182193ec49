"""Detectors on live traces with Structured Streaming: event-time windows with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path


def event_stream(spark: SparkSession, path: str, files_at_once: int = 64) -> DataFrame:
    """The events under ``path`` as a stream with a zoned event time."""
    schema = spark.read.parquet(path).schema
    table = path.rstrip("/")
    # As a pattern, so that a table of one file streams like one of a folder.
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(f"{table[:-1]}[{table[-1]}]")
    return rows.withColumn("at", F.col("ts").cast("timestamp"))


def sliding(stream: DataFrame, size: str = "1 day", step: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Activity by channel in sliding windows."""
    return stream.withWatermark("at", late).groupBy(F.window("at", size, step).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))


def sessions(stream: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """A trace's visits: rows no more than ``gap`` apart."""
    return stream.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def drained(spark: SparkSession, result: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all there is, into the shared folder, and reads what it wrote.

    Each batch's updates are kept apart; the reader takes the last state of each window.
    """
    base = shared_path(spark, name)
    query = result.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint").foreachBatch(lambda rows, i: rows.write.mode("overwrite").parquet(f"{base}/out/batch={i}")).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out")
