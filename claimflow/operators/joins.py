"""Joins of traces and claims."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def timeline(sensor: DataFrame, signal: DataFrame, on: Sequence[str]) -> DataFrame:
    """Each sensor row with the signal rows of the same time; without one it stays, with nulls."""
    return sensor.join(signal, list(on), "left")


def every_nth(signal: DataFrame, sensor: DataFrame, n: int, keys: Sequence[str]) -> DataFrame:
    """Signal row k takes its time from sensor row n * k; what has no partner goes."""
    nth = sensor.where(F.col("row_idx") % n == 0).withColumn("row_idx", F.expr(f"row_idx div {n}"))
    return signal.join(nth, [*keys, "row_idx"])


def expanded(sensor: DataFrame, signal: DataFrame, n: int, keys: Sequence[str]) -> DataFrame:
    """Sensor row i takes signal row i div n, the last one beyond the end."""
    size = signal.groupBy(*keys).agg(F.count("*").alias("__n"))
    at = sensor.join(size, list(keys)).withColumn("signal_idx", F.least(F.expr(f"row_idx div {n}"), F.col("__n") - 1)).drop("__n")
    return at.join(signal.withColumnRenamed("row_idx", "signal_idx"), [*keys, "signal_idx"])


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, right_id: str) -> DataFrame:
    """Adds to each left row the id of the right row nearest in ``left_at``/``right_at``, ties to the smaller id.

    As two as-of frames over the union, before and after each row, so that a
    key's rows are sorted once and never crossed.
    """
    names = [*keys, left_at, *[c for c in left.columns if c not in (*keys, left_at)]]
    r = right.select(*keys, F.col(right_at).alias("__at"), F.col(right_id).alias("__id"))
    l = left.select(*names, F.col(left_at).alias("__at")).withColumn("__id", F.lit(None).cast(dict(r.dtypes)["__id"]))
    both = l.withColumn("__left", F.lit(1)).unionByName(r.withColumn("__left", F.lit(0)), allowMissingColumns=True)
    # Of right rows at one place the smallest id counts: it is last before and first after.
    back = Window.partitionBy(*keys).orderBy(F.col("__at"), F.col("__left"), F.col("__id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    # The same from the end, so that this window runs on as well.
    ahead = Window.partitionBy(*keys).orderBy(F.col("__at").desc(), F.col("__left"), F.col("__id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__b", F.last(F.when(F.col("__left") == 0, F.struct("__at", "__id")), True).over(back)).withColumn("__f", F.last(F.when(F.col("__left") == 0, F.struct("__at", "__id")), True).over(ahead))
    found = found.where("__left = 1")
    db, df = F.col("__at") - F.col("__b.__at"), F.col("__f.__at") - F.col("__at")
    first = (db < df) | df.isNull() | ((db == df) & (F.col("__b.__id") <= F.col("__f.__id")))
    return found.withColumn("nearest_id", F.when(F.col("__b").isNotNull() & first, F.col("__b.__id")).otherwise(F.col("__f.__id"))).withColumn("nearest_gap", F.when(F.col("__b").isNotNull() & first, db).otherwise(df)).select(*names, "nearest_id", "nearest_gap")


def in_range(points: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str = "row_idx") -> DataFrame:
    """Rows whose ``at`` lies in a range [start, end) of the same key."""
    p, r = points.alias("p"), ranges.alias("r")
    on = [F.col(f"p.{k}") == F.col(f"r.{k}") for k in keys] + [F.col(f"p.{at}") >= F.col("r.start"), F.col(f"p.{at}") < F.col("r.end")]
    return p.join(r, on).select("p.*", *[F.col(f"r.{c}") for c in ranges.columns if c not in keys])


def pairs(df: DataFrame, key: str, columns: Sequence[str], within: Sequence[str]) -> DataFrame:
    """Unordered pairs of rows inside small groups: the half matrix that a distance needs."""
    a = df.select(*within, F.col(key).alias("i"), *[F.col(c).alias(f"{c}_i") for c in columns])
    b = df.select(*within, F.col(key).alias("j"), *[F.col(c).alias(f"{c}_j") for c in columns])
    return a.join(b, list(within)).where("i < j")


def chained(base: DataFrame, key: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Score tables joined one after another: a missing score is 0 and flagged."""
    out = base
    for name, table in tables.items():
        out = out.join(table.select(key, F.col(name).alias(f"__{name}"), F.lit(True).alias(f"__has_{name}")), key, "left")
        out = out.withColumn(f"missing_{name}", F.col(f"__has_{name}").isNull()).withColumn(name, F.coalesce(f"__{name}", F.lit(0.0))).drop(f"__{name}", f"__has_{name}")
    return out


def missing_partners(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right, list(on), "left_anti")


def closest_key(claims: DataFrame, references: DataFrame, key: str, claim: str, reference: str, block: int = 2_000) -> DataFrame:
    """The reference list most like each claim's list (exact first, then longest common part, then the smaller id).

    ``references`` (reference_id, a list) is gathered into blocks of about
    ``block`` lists. Each distinct claimed list meets a block once, inside one
    expression, its best of each block is compared, and all claims (``key``,
    unique) with that list take it. One block is broadcast; larger libraries are joined by block.
    """
    blocks = max(1, -(-references.count() // block))
    place = F.pmod(F.xxhash64("reference_id"), F.lit(blocks)).cast("int")
    library = references.groupBy(place.alias("__block")).agg(F.collect_list(F.struct("reference_id", C.marked(reference).alias("list"))).alias("__library"))
    # Few bytes but much to compare: lists are dealt over all partitions, whatever their size.
    parts = int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = claims.select(F.col(claim).alias("__list")).repartition(parts, "__list").distinct().withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = asked.join(F.broadcast(library) if blocks == 1 else library, "__block")
    best = F.array_min(F.transform("__library", lambda x: F.struct((-C.marked_ratio(F.col("__list"), x["list"])).alias("far"), x["reference_id"].alias("id"))))
    scored = met.select("__list", best.alias("__best"))
    if blocks > 1:
        scored = scored.groupBy("__list").agg(F.min("__best").alias("__best"))
    told = claims.join(scored, F.col(claim).eqNullSafe(F.col("__list")))
    return told.select(*claims.columns, F.col("__best.id").alias("reference_id"), (-F.col("__best.far")).alias("likeness"))


def resolved(claims: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Claim paths (claim_path) against a file catalogue (folder, name, path).

    The same folder and name comes first, then a name that is unique, then the
    shortest path; what is not found has a null path.
    """
    asked = claims.withColumn("__folder", C.folder_name("claim_path")).withColumn("__name", C.merged_name(C.file_name("claim_path")))
    files = catalogue.select(F.col("folder").alias("__f"), F.col("name").alias("__name"), F.col("path").alias("__path"))
    rank: Column = F.struct(F.when(F.col("__f") == F.col("__folder"), 0).otherwise(1), F.length("__path"), F.col("__path"))
    return asked.join(files, "__name", "left").groupBy(*claims.columns).agg(F.min(F.when(F.col("__path").isNotNull(), rank)).alias("__best")).select(*claims.columns, F.col("__best.__path").alias("resolved_path"))


def first_existing(asked: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """(key, found): the first of each row's ``candidates`` that is a path of ``files``; none: null."""
    each = asked.select(key, F.posexplode("candidates").alias("__rank", "path"))
    known = files.select("path").distinct().withColumn("__there", F.lit(True))
    ranked = each.join(known, "path", "left").select(key, F.when(F.col("__there"), F.struct("__rank", "path")).alias("one"))
    return ranked.groupBy(key).agg(F.min("one").alias("one")).select(key, F.col("one.path").alias("found"))


def by_stem(files: DataFrame) -> DataFrame:
    """(stem, path): of the paths of a stem a merged one, then the shortest, then the first."""
    name = C.file_name("path")
    rank = F.struct(F.when(name.endswith("_merged.csv"), 0).otherwise(1).alias("plain"), F.length("path").alias("n"), F.col("path").alias("path"))
    return files.groupBy(F.regexp_replace(name, r"(_merged)?\.csv$", "").alias("stem")).agg(F.min(rank).alias("best")).select("stem", "best.path")
