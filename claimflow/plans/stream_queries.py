"""Streams drained over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import windows
from .inputs import query

_ZONED = "SELECT *, epoch_us(ts) AS us FROM events"


@query(f"""WITH e AS ({_ZONED}), w AS (SELECT event_type, value, unnest(range(us // 21600000000 - 3, us // 21600000000 + 1)) AS slot FROM e)
    SELECT CAST(slot * 21600 AS BIGINT) AS start_s, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM w GROUP BY slot, event_type""")
def stream_sliding_window(s, d):
    out = windows.drained(s, windows.sliding(windows.event_stream(s, f"{d}/events.parquet")), "sliding")
    last = out.groupBy("w", "event_type").agg(F.max_by(F.struct("n", "mean_value"), "n").alias("x"))
    return last.select(F.unix_timestamp("w.start").alias("start_s"), "event_type", "x.n", F.round("x.mean_value", 6).alias("mean_value"))


@query(f"""WITH e AS ({_ZONED}), g AS (SELECT user_id, us, CASE WHEN us - lag(us) OVER w >= 7200000000 OR lag(us) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us)),
    v AS (SELECT user_id, us, sum(new) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS visit FROM g)
    SELECT user_id, min(us) // 1000000 AS start_s, count(*) AS n FROM v GROUP BY user_id, visit""")
def session_visits(s, d):
    e = s.read.parquet(f"{d}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    out = e.groupBy(F.session_window("at", "2 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.unix_timestamp("w.start").alias("start_s"), "n")
