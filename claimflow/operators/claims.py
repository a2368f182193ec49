"""Claim and attack generators. Every draw is a keyed hash, so a claim is the same on each run and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .frames import numbered

REGIONS = [f"{r}{c}" for r in C.REGION_ROWS for c in range(1, 7)]


def pool() -> Column:
    return F.array(*[F.lit(r) for r in REGIONS])


def mutated_region(region: Column, *seed: Column | str) -> Column:
    """Another region than the given one, of the 36."""
    others = F.array_remove(pool(), region)
    return F.element_at(others, (C.keyed(F.size(others), *seed) + 1).cast("int"))


def mutated_regions(regions: Column | str, key: Column | str) -> Column:
    """1 to all regions of a list replaced, from the first on."""
    v = F.col(regions) if isinstance(regions, str) else regions
    n = C.keyed(F.size(v), F.lit("n"), key) + 1
    return F.transform(v, lambda x, i: F.when(i < n, mutated_region(x, F.lit("r"), key, i)).otherwise(x))


def mutated_time(seconds: Column | str, key: Column | str) -> Column:
    """A time off by up to a quarter, by a second at least, and above zero."""
    s = F.col(seconds) if isinstance(seconds, str) else seconds
    share = (C.keyed(2001, F.lit("t"), key) - 1000) / 1000.0 * 0.25
    shift = F.when(share < 0, F.least(share * s, F.lit(-1.0))).otherwise(F.greatest(share * s, F.lit(1.0)))
    return F.greatest(s + shift, F.lit(0.001))


def drawn_share(df: DataFrame, key: str, share: float, seed: str, within: list[str]) -> DataFrame:
    """Flags the ``share`` of each group's rows, rounded down, that come first in a keyed order."""
    w = Window.partitionBy(*within)
    place = F.row_number().over(w.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), key))
    return df.withColumn("mutated", place <= F.floor(F.count("*").over(w) * share))


def location_claims(rows: DataFrame, key: str, seconds: str, share: float, seed: str, within: list[str]) -> DataFrame:
    """Claims with true regions by time; of each group a share claims other regions."""
    told = drawn_share(rows.withColumn("label_location", C.time_bucket_regions(seconds)), key, share, seed, within)
    return told.withColumn("claim_location", F.when(F.col("mutated"), mutated_regions("label_location", key)).otherwise(F.col("label_location")))


def trace_claims(rows: DataFrame, key: str, seconds: str, trace: Column, share: float, seed: str, within: list[str]) -> DataFrame:
    """Claims of time and trace; of each group a share errs in time, trace, or both."""
    told = drawn_share(rows.withColumn("label_trace", trace).withColumn("label_time", F.col(seconds)), key, share, seed, within)
    kind = C.keyed(3, F.lit("kind"), key)
    told = told.withColumn("error_kind", F.when(F.col("mutated"), F.element_at(F.array(F.lit("time"), F.lit("trace"), F.lit("both")), (kind + 1).cast("int"))).otherwise("none"))
    time = F.when(F.col("error_kind").isin("time", "both"), mutated_time("label_time", key)).otherwise(F.col("label_time"))
    walk = F.when(F.col("error_kind").isin("trace", "both"), mutated_regions("label_trace", key)).otherwise(F.col("label_trace"))
    return told.withColumn("claim_time", time).withColumn("claim_trace", walk)


def paired_by_hash(current: DataFrame, replay: DataFrame, key: str, replay_key: str, seed: str, within: list[str]) -> DataFrame:
    """Each current trace with one replay trace of its group, drawn by hash."""
    w = Window.partitionBy(*within).orderBy(replay_key)
    r = replay.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", F.count("*").over(Window.partitionBy(*within)))
    sizes = r.select(*within, "__n").distinct()
    asked = current.join(sizes, within).withColumn("__i", C.keyed(F.col("__n"), F.lit(seed), key)).drop("__n")
    return asked.join(r.drop("__n"), [*within, "__i"]).drop("__i")


def with_material(bases: DataFrame, pool: DataFrame, rows: int, per_signal: int, signals: int = 2) -> DataFrame:
    """The manifest of replayed traces: what is appended to each of ``bases`` (trace_id, n).

    ``pool`` (trace_id, n, level): of the traces with ``rows`` rows or more those
    of the least level that has any serve as material, drawn by hash; then a
    start in the material, and the ``signals`` signal rows (one for each
    ``per_signal`` rows) that lie beside it.
    """
    fit = pool.where(F.col("n") >= rows)
    level = fit.agg(F.min("level").alias("__level"), F.lit(0).alias("__one"))
    best = fit.crossJoin(F.broadcast(level.drop("__one"))).where("level = __level").select(F.col("trace_id").alias("material_id"), F.col("n").alias("material_rows"))
    placed = numbered(best, ["material_id"], "place")
    count = placed.agg(F.count("*").alias("m"))
    asked = bases.crossJoin(F.broadcast(count)).where("m > 0").select(F.col("trace_id").alias("claim_id"), F.col("n").alias("base_rows"), C.keyed(F.col("m"), F.lit("material"), "trace_id").alias("place"))
    made = asked.join(placed, "place").withColumn("material_start", C.keyed(F.col("material_rows") - rows + 1, F.lit("start"), "claim_id", "material_id"))
    whole = F.expr(f"(material_rows + {per_signal - 1}) div {per_signal}")
    signal = F.greatest(F.lit(0), F.least(F.expr(f"material_start div {per_signal}"), whole - signals)).cast("bigint")
    return made.select("claim_id", "material_id", "base_rows", (F.col("base_rows") + rows).alias("output_rows"), "material_start", (F.col("material_start") + rows).alias("material_end"), signal.alias("signal_start"), (signal + signals).alias("signal_end"))


def with_replayed(trace: DataFrame, manifest: DataFrame, per_signal: int) -> DataFrame:
    """The rows of ``trace`` (trace_id, row_idx, value) and behind them those that the manifest appends, each with its signal row."""
    own = trace.select(F.col("trace_id").alias("claim_id"), "row_idx", "value", F.expr(f"row_idx div {per_signal}").alias("signal_row"), F.lit(False).alias("appended"))
    taken = manifest.select("claim_id", F.col("material_id").alias("trace_id"), "base_rows", "material_start", "signal_start", "signal_end", F.explode(F.sequence("material_start", F.col("material_end") - 1)).alias("row_idx"))
    far = F.expr(f"(row_idx - material_start) div {per_signal}")
    more = taken.join(trace, ["trace_id", "row_idx"]).select("claim_id", (F.col("base_rows") + F.col("row_idx") - F.col("material_start")).alias("row_idx"), "value", (F.expr(f"(base_rows + {per_signal - 1}) div {per_signal}") + F.least(far, F.col("signal_end") - F.col("signal_start") - 1)).alias("signal_row"), F.lit(True).alias("appended"))
    return own.unionByName(more)


def transplant_manifest(sizes: DataFrame, rows: int, seed: str, attack: str = "transplant_location") -> DataFrame:
    """What each transplanted sample is made of: ``rows`` rows from a keyed place of the signal's trace, then as many of the label's.

    ``sizes`` has claim_id, signal_source, signal_rows, label_source and
    label_rows; a claim either of whose traces is shorter has no sample. Windows
    are half open, samples numbered by claim, and the sample's name carries its number.
    """
    fit = sizes.where((F.col("signal_rows") >= rows) & (F.col("label_rows") >= rows))
    placed = numbered(fit, ["claim_id"], "__place").withColumn("sample_id", F.col("__place") + 1)
    window = lambda part: C.keyed(F.col(f"{part}_rows") - rows + 1, F.lit(seed), F.lit(part), "claim_id")
    name = F.concat(F.lit(f"{attack}/"), F.col("sample_id").cast("string"), F.lit("_merged.csv"))
    told = placed.withColumn("signal_start", window("signal")).withColumn("label_start", window("label"))
    return told.select("sample_id", "claim_id", name.alias("output_source"), F.lit(2 * rows).alias("output_rows"), "signal_source", "signal_start", (F.col("signal_start") + rows).alias("signal_end"), "label_source", "label_start", (F.col("label_start") + rows).alias("label_end"), F.lit(seed).alias("seed"))
