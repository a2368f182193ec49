"""The registry of queries, and traces and claims read off the star-schema tables.

``events`` by user is a sensor trace, its five event types are channels and the
number in ``props`` a cell id; lists of an order's lines are a scan's parallel
lists. Each frame has an SQL twin that the oracles start from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trace_id, row_idx, ms, value, channel, k, event_id."""
    e = table(spark, sf_dir, "events")
    rows = e.select(
        F.col("user_id").alias("trace_id"),
        F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("ms"),
        "value",
        F.col("event_type").alias("channel"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        "event_id",
    )
    return frames.with_row_index(rows, ["ms", "event_id"])


TRACE = """trace AS (
    SELECT user_id AS trace_id, (epoch_us(ts) // 1000) AS ms, value, event_type AS channel, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id,
           row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) - 1 AS row_idx
    FROM events)"""


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace with a value on every seventh event only."""
    return trace(spark, sf_dir).withColumn("sparse", F.when(F.col("event_id") % 7 == 0, F.col("value")))


GAPPY = TRACE + """, gappy AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN value END AS sparse FROM trace)"""


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan_id and three parallel lists as text, with foreign kinds, sentinels, large ids and a list that is one short."""
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_returnflag") == "A", "Gsm").otherwise("Lte").alias("t"),
        (F.col("l_partkey") * 20).cast("int").alias("i"),
        F.when(F.col("l_linenumber") == 5, F.lit(2147483647)).otherwise(-F.col("l_quantity").cast("int")).alias("r"),
    )
    lists = line.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "t", "i", "r"))).alias("x"))
    text = lambda name: F.to_json(F.transform("x", lambda x: x[name]))
    short = F.to_json(F.transform(F.when(F.col("l_orderkey") % 3 == 0, F.slice("x", F.lit(1), F.size("x") - 1)).otherwise(F.col("x")), lambda x: x["r"]))
    return lists.select(F.col("l_orderkey").alias("scan_id"), text("t").alias("types"), text("i").alias("ids"), short.alias("rssi"))


SCANS = """cells AS (
    SELECT scan_id, pos, id, rssi FROM (
        SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY l_linenumber, t, id, rssi) AS pos, count(*) OVER (PARTITION BY scan_id) AS n
        FROM (SELECT l_orderkey AS scan_id, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'gsm' ELSE 'lte' END AS t, CAST(l_partkey * 20 AS INT) AS id,
                     CASE WHEN l_linenumber = 5 THEN 2147483647 ELSE -CAST(floor(l_quantity) AS INT) END AS rssi FROM lineitem))
    WHERE pos <= n - CASE WHEN scan_id % 3 = 0 THEN 1 ELSE 0 END AND t = 'lte' AND rssi <> 2147483647)"""


def claim_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """claim_id and a claim path in one of the spellings that occur."""
    o = table(spark, sf_dir, "orders")
    folder = F.concat(F.lit("data/route_"), F.lpad((F.col("o_custkey") % 9).cast("string"), 3, "0"))
    kind = F.col("o_orderkey") % 4
    number = (F.col("o_orderkey") % 50).cast("string")
    path = (
        F.when(kind == 0, F.concat(folder, F.lit("/"), number, F.lit(".csv")))
        .when(kind == 2, F.concat(folder, F.lit("/"), number, F.lit("_merged.csv")))
        .otherwise(F.concat(folder, F.lit("\\sensor_"), number))
    )
    return o.select(F.col("o_orderkey").alias("claim_id"), path.alias("claim_path"))


CLAIM_PATHS = r"""claim_paths AS (
    SELECT o_orderkey AS claim_id,
           CASE o_orderkey % 4 WHEN 0 THEN f || '/' || n || '.csv' WHEN 2 THEN f || '/' || n || '_merged.csv' ELSE f || '\sensor_' || n END AS claim_path
    FROM (SELECT o_orderkey, 'data/route_' || lpad(CAST(o_custkey % 9 AS VARCHAR), 3, '0') AS f, CAST(o_orderkey % 50 AS VARCHAR) AS n FROM orders))"""


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """claim_id, claimed and detected lists of regions: an order's lines as grid cells."""
    line = table(spark, sf_dir, "lineitem")
    cell = lambda a, b: F.concat(F.substring(F.lit("abcdef"), (a % 6 + 1).cast("int"), F.lit(1)), (b % 6 + 1).cast("string"))
    both = F.struct("l_linenumber", cell(F.col("l_partkey"), F.col("l_suppkey")).alias("a"), cell(F.col("l_partkey"), F.col("l_suppkey") % 2 + F.col("l_suppkey")).alias("b"))
    rows = line.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(both)).alias("x"))
    return rows.select(F.col("l_orderkey").alias("claim_id"), F.transform("x", lambda x: x["a"]).alias("claimed"), F.transform(F.filter("x", lambda x: x["l_linenumber"] != 3), lambda x: x["b"]).alias("detected"))


REGIONS = """cells AS (
    SELECT l_orderkey AS claim_id, l_linenumber AS n, substr('abcdef', CAST(l_partkey % 6 + 1 AS INT), 1) || CAST(l_suppkey % 6 + 1 AS VARCHAR) AS a,
           substr('abcdef', CAST(l_partkey % 6 + 1 AS INT), 1) || CAST((l_suppkey % 2 + l_suppkey) % 6 + 1 AS VARCHAR) AS b FROM lineitem),
    regions AS (SELECT claim_id, list(a ORDER BY n, a, b) AS claimed, coalesce(list(b ORDER BY n, a, b) FILTER (n <> 3), []) AS detected FROM cells GROUP BY claim_id)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, attack, score between 0.6 and 1, some missing."""
    o = table(spark, sf_dir, "orders")
    score = F.when(F.col("o_orderkey") % 13 != 0, F.lit(0.6) + (F.col("o_custkey") % 41) / 100.0)
    return o.select(F.col("o_orderkey").alias("sample"), F.col("o_orderpriority").alias("attack"), score.alias("score"))


SCORES = """scores AS (
    SELECT o_orderkey AS sample, o_orderpriority AS attack, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(0.6 AS DOUBLE) + (o_custkey % 41) / CAST(100.0 AS DOUBLE) END AS score FROM orders)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, length: a graph over the nations."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("n"))
    a = n.select(F.col("n").alias("src"), ((F.col("n") * 7 + 3) % 25).alias("dst"), (F.col("n") % 5 + 1).cast("double").alias("length"))
    b = n.where("n % 3 = 0").select(F.col("n").alias("src"), ((F.col("n") + 5) % 25).alias("dst"), (F.col("n") % 7 + 2).cast("double").alias("length"))
    return a.unionByName(b)


LINKS = """n AS (SELECT CAST(n_nationkey AS BIGINT) AS n FROM nation),
    links AS (SELECT n AS src, (n * 7 + 3) % 25 AS dst, CAST(n % 5 + 1 AS DOUBLE) AS length FROM n
              UNION ALL SELECT n, (n + 5) % 25, CAST(n % 7 + 2 AS DOUBLE) FROM n WHERE n % 3 = 0),
    both_ways AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM links UNION ALL SELECT dst, src FROM links) WHERE src <> dst)"""
