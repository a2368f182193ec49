"""Readers of sensor and signal files, and sinks for claims, scores and manifests."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import stored

SIGNAL = "Time STRING, Cell_Type STRING, Cell_ID STRING, Cell_RSSI STRING"
SENSOR = "Time STRING, Acc_X DOUBLE, Acc_Y DOUBLE, Acc_Z DOUBLE, Meg DOUBLE, Gyr_X DOUBLE, Gyr_Y DOUBLE, Gyr_Z DOUBLE, Ore DOUBLE"


def required(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` itself; raises when a column is missing."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def same_columns(a: DataFrame, b: DataFrame) -> None:
    if a.columns != b.columns:
        raise ValueError(f"columns differ: {a.columns} and {b.columns}")


def rates_valid(*rates: float) -> None:
    """Shares of claims that err: from 0 to 1."""
    if any(not 0 <= r <= 1 for r in rates):
        raise ValueError("error rates must be from 0 to 1")


def weights_valid(weights: Sequence[float], tolerance: float = 1e-9) -> None:
    if abs(sum(weights) - 1) > tolerance or min(weights) < 0:
        raise ValueError("weights must be at least 0 and sum to 1")


def read_csv(spark: SparkSession, path: str, schema: str, encodings: Sequence[str] = ("UTF-8", "GBK")) -> DataFrame:
    """CSV files with a header under an explicit schema, with their provenance.

    Each file is read under the first encoding in which none of its texts holds
    a replacement character; a pass over the text columns tells which files need
    the next one. A byte order mark before the header is ignored. Rows carry
    route, trace_id and file. Encodings beyond Unicode and ASCII need the
    session to allow those of Java, which this turns on.
    """
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    names = [c.strip().split()[0] for c in schema.split(",")]
    parts, asked = [], None
    for i, encoding in enumerate(encodings):
        raw = spark.read.schema(schema).option("header", True).option("encoding", encoding).option("enforceSchema", True).option("mode", "PERMISSIVE").option("escape", '"').csv(path)
        rows = raw.select(*names, F.col("_metadata.file_path").alias("file"))
        rows = rows if asked is None else rows.join(asked, "file", "left_semi")
        bad: Column = F.lit(False)
        for n, t in raw.dtypes:
            if t == "string":
                bad = bad | F.coalesce(F.col(n).contains("\ufffd"), F.lit(False))
        asked = None if i == len(encodings) - 1 else stored(rows.groupBy("file").agg(F.max(bad).alias("bad")).where("bad").select("file"), "other-encodings")
        if asked is None or asked.isEmpty():
            parts.append(rows)
            break
        parts.append(rows.join(asked, "file", "left_anti"))
    read = reduce(DataFrame.unionByName, parts)
    file = F.col("file")
    return read.select(*names, file, F.regexp_extract(file, r"(route_\d+)/", 1).alias("route"), F.regexp_extract(file, r"_(\d+)[^/]*\.csv$", 1).alias("trace_id"))


def walk(spark: SparkSession, root: str, name: str = "*.csv") -> DataFrame:
    """(path, folder, name, size): all files below ``root`` whose name matches, found by Spark's listing; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root).select("path", F.col("length").alias("size"))
    return found.select("path", C.folder_name("path").alias("folder"), C.file_name("path").alias("name"), "size")


def pairs(found: DataFrame) -> DataFrame:
    """(folder, sensor, signal): sensor files of :func:`walk` with the signal file named alike in the same folder; without one null."""
    kinds = found.withColumn("kind", C.file_kind("name"))
    sensor = kinds.where("kind = 'sensor'").select("folder", F.regexp_replace("path", "[^/]*$", "").alias("__at"), C.paired_name("name").alias("__other"), F.col("path").alias("sensor"))
    signal = kinds.where("kind = 'signal'").select(F.regexp_replace("path", "[^/]*$", "").alias("__at"), F.col("name").alias("__other"), F.col("path").alias("signal"))
    return sensor.join(signal, ["__at", "__other"], "left").select("folder", "sensor", "signal")


def marked_folder(found: DataFrame, marker: str) -> str | None:
    """The first folder, by name, whose name holds ``marker``."""
    first = found.where(F.contains("folder", F.lit(marker))).agg(F.min("folder")).first()
    return first[0] if first else None


def read_columns(spark: SparkSession, path: str, schema: str, names: Sequence[str]) -> DataFrame:
    """Only ``names`` of CSV files: the reader parses no other column."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path).select(*names)


def long_cells(df: DataFrame, keys: Sequence[str], form: str | None = None) -> DataFrame:
    """(keys, place, rssi): scans with a column ``Cell_RSSI_n`` for each cell, or with a list ``Cell_RSSI``; missing values have no row.

    With a name for ``form``, scans that hold both come in both, told apart by
    that column (list, wide), from one pass over them.
    """
    wide = sorted((c for c in df.columns if c.startswith("Cell_RSSI_")), key=lambda c: int(c.rsplit("_", 1)[1]))
    forms = ({"list": F.col("Cell_RSSI")} if "Cell_RSSI" in df.columns else {}) | ({"wide": F.array(*[F.col(c) for c in wide])} if wide else {})
    if form:
        df = df.select(*keys, F.inline(F.array(*[F.struct(F.lit(name).alias(form), v.alias("__values")) for name, v in forms.items()])))
        keys, values = [*keys, form], F.col("__values")
    else:
        values = forms["wide" if wide else "list"]
    # An inner explode of a column is filtered by its size first, which works out the lists twice.
    return df.select(*keys, F.posexplode_outer(values).alias("place", "rssi")).where("rssi is not null")


def read_signals(spark: SparkSession, root: str, pattern: str = "*/signal*.csv") -> DataFrame:
    """Cell scans below ``root``: parsed, cleaned cells with the scan's place in its file.

    A file's order is its time order: places come from positions inside the
    file's single split (scan files are far below a split's size).
    """
    rows = read_csv(spark, f"{root}/{pattern}", SIGNAL).withColumn("place", F.monotonically_increasing_id())
    return rows.select("route", "trace_id", "file", "place", F.col("Time").alias("time_text"), C.small_ids(C.scan_cells("Cell_Type", "Cell_ID", "Cell_RSSI")).alias("cells"))


def write_table(df: DataFrame, path: str, mode: str = "overwrite", by: Sequence[str] = ()) -> None:
    """Parquet; ``errorifexists`` refuses to overwrite, ``by`` makes one folder for each attack."""
    (df.write.mode(mode).partitionBy(*by) if by else df.write.mode(mode)).parquet(path)


def append_run(df: DataFrame, path: str, run: str) -> None:
    """Appends under a run id: a repeated run replaces its own rows and no others."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/run={run}")


def write_attacks(df: DataFrame, path: str, by: str) -> None:
    """A folder for each attack below ``path/by`` and all rows in one table at ``path/all``, from one pass over ``df``."""
    df.write.mode("errorifexists").parquet(f"{path}/all")
    whole = df.sparkSession.read.schema(df.schema).parquet(f"{path}/all")
    write_table(whole, f"{path}/by", "errorifexists", [by])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def manifest(df: DataFrame, run: str, seed: int) -> DataFrame:
    """One row a sample: where it came from, for audit."""
    return df.withColumn("run", F.lit(run)).withColumn("random_seed", F.lit(seed))
