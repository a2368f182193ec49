"""Queries over frames, intervals and joins of traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import anchors, frames, intervals, joins
from .inputs import GAPPY, TRACE, gappy, query, trace

W = "(PARTITION BY trace_id ORDER BY row_idx)"
ID = "trace_id, row_idx"


def _round(df, *names):
    return df.select("trace_id", "row_idx", *[F.round(n, 6).alias(n) for n in names])


@query(f"WITH {TRACE} SELECT {ID}, round(value - lag(value) OVER {W}, 6) AS diff FROM trace")
def first_diff(s, d):
    return _round(frames.difference(trace(s, d), "value", "diff"), "diff")


@query(f"WITH {GAPPY} SELECT {ID}, round(avg(sparse) OVER (PARTITION BY trace_id ORDER BY row_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean5 FROM gappy")
def rolling_mean5(s, d):
    return _round(frames.trailing_mean(gappy(s, d), "sparse", "mean5"), "mean5")


@query(f"""WITH {TRACE} SELECT {ID}, round(avg(value) OVER (PARTITION BY trace_id ORDER BY row_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS mean5,
    round(avg(value) OVER (PARTITION BY trace_id ORDER BY row_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS mean3 FROM trace""")
def centered_mean5(s, d):
    return _round(frames.centred_mean(frames.centred_mean(trace(s, d), "value", "mean5", 5), "value", "mean3", 3), "mean5", "mean3")


@query(f"WITH {TRACE} SELECT {ID}, round(sum(value) OVER (PARTITION BY trace_id ORDER BY row_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS sum20 FROM trace")
def rolling_sum(s, d):
    return _round(frames.trailing_sum(trace(s, d), "value", "sum20", 20), "sum20")


@query(f"""WITH {GAPPY} SELECT {ID}, round(coalesce(last_value(sparse IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(sparse IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS filled FROM gappy""")
def ffill_bfill(s, d):
    return _round(frames.filled(gappy(s, d), "sparse", "filled"), "filled")


@query(f"WITH {GAPPY} SELECT {ID}, round(last_value(sparse IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY row_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS filled FROM gappy")
def bounded_ffill(s, d):
    return _round(frames.filled_up_to(gappy(s, d), "sparse", "filled", 5), "filled")


@query(f"""WITH {TRACE}, t AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN k END AS cell FROM trace)
    SELECT {ID}, coalesce(cell, first_value(cell IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS cell FROM t""")
def fill_first_nonnull(s, d):
    t = trace(s, d).withColumn("c", F.when(F.col("event_id") % 7 == 0, F.col("k")))
    return frames.filled_with_first(t, "c", "cell").select("trace_id", "row_idx", "cell")


def _z(kind):
    return f"""WITH {TRACE}, m AS (SELECT *, avg(value) OVER (PARTITION BY trace_id) AS m, {kind}(value) OVER (PARTITION BY trace_id) AS sd FROM trace)
    SELECT {ID}, round((value - m) / CASE WHEN sd IS NULL OR sd = 0 THEN 1 ELSE sd END, 6) AS z FROM m"""


@query(_z("stddev_pop"))
def zscore_pop(s, d):
    return _round(frames.zscore(trace(s, d), "value", "z"), "z")


@query(_z("stddev_samp"))
def zscore_samp(s, d):
    return _round(frames.zscore(trace(s, d), "value", "z", sample=True), "z")


_WINDOWS = f"""WITH {TRACE}, w AS (SELECT trace_id, row_idx AS start_row, row_idx + 20 AS end_row, count(*) OVER (PARTITION BY trace_id) AS n,
        avg(value) OVER f AS mean_value, stddev_samp(value) OVER f AS sd_value, count(DISTINCT channel) OVER f AS channels FROM trace
        WINDOW f AS (PARTITION BY trace_id ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING))"""


@query(f"{_WINDOWS} SELECT trace_id, start_row, end_row, round(mean_value, 6) AS mean_value, round(sd_value, 6) AS sd_value, channels FROM w WHERE start_row % 5 = 0 AND start_row + 20 <= n")
def sliding_window_stats(s, d):
    w = frames.sliding_windows(trace(s, d), 20, 5, {"mean_value": F.avg("value"), "sd_value": F.stddev_samp("value"), "seen": F.collect_set("channel")})
    return w.select("trace_id", "start_row", "end_row", F.round("mean_value", 6).alias("mean_value"), F.round("sd_value", 6).alias("sd_value"), F.size("seen").cast("bigint").alias("channels"))


@query(f"""WITH {TRACE}, w AS (SELECT a.trace_id, a.row_idx AS start_row, b.row_idx AS pos, b.value FROM trace a JOIN trace b ON a.trace_id = b.trace_id AND b.row_idx >= a.row_idx AND b.row_idx < a.row_idx + 20
        WHERE a.row_idx % 10 = 0 AND a.row_idx + 20 <= (SELECT count(*) FROM trace c WHERE c.trace_id = a.trace_id)),
    r AS (SELECT *, stddev_samp(value) OVER (PARTITION BY trace_id, start_row ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS sd FROM w)
    SELECT trace_id, start_row, round(avg(sd), 6) AS mean_rolling_sd FROM r GROUP BY trace_id, start_row""")
def windowed_rolling_std(s, d):
    w = frames.windowed_lists(trace(s, d), "value", 20, 10)
    return w.select("trace_id", "start_row", F.round(frames.rolling_deviation_mean("items", 5), 6).alias("mean_rolling_sd"))


@query(f"""WITH {TRACE}, c AS (SELECT *, CASE WHEN lag(channel) OVER {W} IS NOT NULL AND (channel <> lag(channel) OVER {W} OR k <> lag(k) OVER {W}) THEN 1 ELSE 0 END AS changed FROM trace)
    SELECT trace_id, CAST(sum(changed) AS BIGINT) AS changes, round(avg(changed), 6) AS change_rate FROM c GROUP BY trace_id""")
def change_rate(s, d):
    t = frames.changes(trace(s, d), ["channel", "k"], "changed")
    return t.groupBy("trace_id").agg(F.sum("changed").cast("bigint").alias("changes"), F.round(F.avg("changed"), 6).alias("change_rate"))


@query(f"WITH {TRACE}, p AS (SELECT trace_id, channel AS a, lead(channel) OVER {W} AS b FROM trace) SELECT a AS left_channel, b AS right_channel, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY a, b")
def consecutive_pairs(s, d):
    return frames.consecutive_pairs(trace(s, d), "channel").groupBy(F.col("left").alias("left_channel"), F.col("right").alias("right_channel")).agg(F.count("*").alias("n"))


_H = "fmod(value * 7.0, 360.0)"


def _headed(s, d):
    return trace(s, d).withColumn("heading", C.floored_mod(F.col("value") * 7.0, 360.0)).withColumn("length", F.lit(1.0))


@query(f"""WITH {TRACE}, h AS (SELECT *, {_H} AS heading FROM trace), g AS (SELECT *, heading - lag(heading) OVER {W} AS turn FROM h)
    SELECT {ID}, round(fmod(fmod(turn + 180.0, 360.0) + 360.0, 360.0) - 180.0, 6) AS turn FROM g""")
def angle_wrap(s, d):
    t = _headed(s, d)
    t = frames.difference(t, "heading", "raw").withColumn("turn", C.wrap180("raw"))
    return t.select("trace_id", "row_idx", C.rounded("turn", 6).alias("turn"))


@query(f"""WITH {TRACE}, h AS (SELECT *, {_H} AS heading FROM trace)
    SELECT {ID}, round(sum(cos(radians(heading))) OVER f, 5) AS x, round(sum(sin(radians(heading))) OVER f, 5) AS y FROM h
    WINDOW f AS (PARTITION BY trace_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def cumulative_path(s, d):
    p = frames.cumulative_path(_headed(s, d), "length", "heading")
    return p.select("trace_id", "row_idx", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query(f"""WITH {TRACE}, h AS (SELECT *, {_H} AS heading FROM trace), g AS (SELECT *, heading - lag(heading) OVER {W} AS turn FROM h),
    c AS (SELECT *, greatest(least(coalesce(fmod(fmod(turn + 180.0, 360.0) + 360.0, 360.0) - 180.0, 0.0), 20.0), -20.0) AS cut FROM g)
    SELECT {ID}, round(first_value(heading) OVER {W} + sum(cut) OVER (PARTITION BY trace_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 5) AS clean FROM c""")
def rate_limited_heading(s, d):
    t = frames.rate_limited(_headed(s, d), "heading", "clean")
    return t.select("trace_id", "row_idx", C.rounded("clean", 5).alias("clean"))


@query(f"WITH {TRACE} SELECT trace_id, round(avg(abs(value)) + 0.07 * stddev_samp(abs(value)), 6) AS upper, round(avg(abs(value)) - 0.07 * stddev_samp(abs(value)), 6) AS lower FROM trace GROUP BY trace_id")
def series_bounds(s, d):
    return frames.bounds(trace(s, d), "value").select("trace_id", F.round("upper", 6).alias("upper"), F.round("lower", 6).alias("lower"))


_FLAGGED = f"""{TRACE}, z AS (SELECT *, (value - avg(value) OVER (PARTITION BY trace_id)) / stddev_pop(value) OVER (PARTITION BY trace_id) AS z FROM trace),
    b AS (SELECT *, abs(z) AS az, avg(abs(z)) OVER (PARTITION BY trace_id) + 0.07 * stddev_samp(abs(z)) OVER (PARTITION BY trace_id) AS ub, count(*) OVER (PARTITION BY trace_id) AS n FROM z),
    f AS (SELECT trace_id, row_idx AS start_row, row_idx + 20 AS end_row, avg(az) OVER (PARTITION BY trace_id ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS m, ub, n FROM b),
    flagged AS (SELECT trace_id, start_row, end_row FROM f WHERE start_row % 5 = 0 AND start_row + 20 <= n AND m >= ub),
    r AS (SELECT *, max(end_row) OVER (PARTITION BY trace_id ORDER BY start_row, end_row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM flagged),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR reach < start_row THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY start_row, end_row) AS island FROM r),
    segments AS (SELECT trace_id, min(start_row) AS start_row, max(end_row) AS end_row FROM i GROUP BY trace_id, island)"""


def _standard(s, d):
    return frames.zscore(trace(s, d), "value", "z").withColumn("az", F.abs("z"))


def _flagged(s, d):
    z = _standard(s, d)
    w = frames.sliding_windows(z, 20, 5, {"m": F.avg("az")})
    ub = z.groupBy("trace_id").agg((F.avg("az") + 0.07 * F.stddev_samp("az")).alias("ub"))
    return w.join(ub, "trace_id").where("m >= ub").select("trace_id", "start_row", "end_row")


@query(f"WITH {_FLAGGED} SELECT * FROM segments")
def interval_merge(s, d):
    return intervals.merged(_flagged(s, d))


@query(f"""WITH {_FLAGGED}, j AS (SELECT s.trace_id, s.start_row AS a, s.end_row AS e, b.row_idx, b.az FROM segments s JOIN b ON b.trace_id = s.trace_id AND b.row_idx >= s.start_row AND b.row_idx < s.end_row),
    t AS (SELECT trace_id, a, e, arg_max(row_idx, (az, -row_idx)) AS c, max(az) AS score FROM j GROUP BY ALL)
    SELECT trace_id, CASE WHEN e - a > 20 THEN greatest(a, c - 10) ELSE a END AS start_row,
           CASE WHEN e - a > 20 THEN least(greatest(a, c - 10) + 20, e) ELSE e END AS end_row, round(score, 6) AS score FROM t""")
def recenter_argmax(s, d):
    out = intervals.recentred(intervals.merged(_flagged(s, d)), _standard(s, d), "az", 20)
    return out.select("trace_id", "start_row", "end_row", F.round("score", 6).alias("score"))


_SMALL = anchors.Detection(size=20, step=5, spacing=4, wobble_rows=5, peak_factor=0.0, valley_factor=0.0, rssi_deviation=40.0, id_rate=0.99, gap=6)


def _merged(s, d):
    return trace(s, d).withColumn("rssi", -F.col("value")).withColumn("cell", F.col("k") % 3)


@query(None)
def anchor_windows(s, d):
    """Windows flagged by activity, peaks, valleys and wobble, or by their cells."""
    return anchors.flagged_windows(_merged(s, d), "value", ["rssi"], ["cell"], _SMALL)


@query(None)
def anchor_segments(s, d):
    """States after merging, recentring and joining neighbours in pairs (a sequential rule, tested by itself)."""
    return anchors.anchor_segments(_merged(s, d), "value", ["rssi"], ["cell"], _SMALL)


@query(None)
def anchor_features(s, d):
    """Values in, before and after each state, and the cells around its start."""
    t = _merged(s, d)
    return anchors.anchor_features(t, anchors.anchor_segments(t, "value", ["rssi"], ["cell"], _SMALL), "value", 20, 6, 2, ["rssi", "cell"])


@query(f"""WITH {TRACE}, l AS (SELECT trace_id, list(value ORDER BY row_idx) AS v, count(*) AS n FROM trace GROUP BY trace_id)
    SELECT trace_id, CAST(len(v) AS INT) AS n, round(v[1], 6) AS first_value, round(v[least(3, n)], 6) AS third_value, CAST(least(n, 60) AS INT) AS kept, CAST(greatest(60 - n, 0) AS INT) AS blanks FROM l""")
def pad_window(s, d):
    """Lists cut or filled to 60 items."""
    lists = trace(s, d).groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "value"))), lambda x: x["value"]).alias("v"))
    p = lists.withColumn("p", C.fit_length("v", 60))
    return p.select("trace_id", F.size("v").alias("n"), F.round(F.get("p", F.lit(0)), 6).alias("first_value"), F.round(F.get("p", F.lit(2)), 6).alias("third_value"), F.size(F.filter("p", lambda x: x.isNotNull())).alias("kept"), F.size(F.filter("p", lambda x: x.isNull())).alias("blanks"))


@query(f"""WITH {TRACE}, l AS (SELECT trace_id, list(value ORDER BY row_idx) AS v FROM trace GROUP BY trace_id), g AS (SELECT trace_id, v, unnest(range(0, 10)) AS i FROM l),
    p AS (SELECT *, CAST(i AS DOUBLE) * (len(v) - 1) / 9.0 AS q FROM g)
    SELECT trace_id, CAST(i AS INT) AS i, round(v[CAST(floor(q) AS INT) + 1] + (v[CAST(least(floor(q) + 2, len(v)) AS INT)] - v[CAST(floor(q) AS INT) + 1]) * (q - floor(q)), 6) AS y FROM p""")
def linear_resample(s, d):
    lists = trace(s, d).groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "value"))), lambda x: x["value"]).alias("v"))
    return lists.select("trace_id", F.posexplode(C.resampled("v", 10)).alias("i", "y")).select("trace_id", "i", F.round("y", 6).alias("y"))


@query(f"""WITH {TRACE}, l AS (SELECT trace_id, list(value ORDER BY row_idx) AS v FROM trace GROUP BY trace_id)
    SELECT trace_id, round(list_sum(v[1:4]), 6) AS part1, round(list_sum(v[5:8]), 6) AS part2, round(list_sum(v[9:12]), 6) AS part3 FROM l""")
def feature_slices(s, d):
    lists = trace(s, d).groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "value"))), lambda x: x["value"]).alias("v"))
    part = lambda a: F.when(F.size("v") >= a, F.round(F.aggregate(F.slice("v", a, 4), F.lit(0.0), lambda x, y: x + y), 6))
    return lists.select("trace_id", part(1).alias("part1"), part(5).alias("part2"), part(9).alias("part3"))


# -- joins --------------------------------------------------------------------


@query(f"""WITH {TRACE}, a AS (SELECT * FROM trace WHERE channel <> 'click'), b AS (SELECT trace_id, ms // 3600000 AS hour, count(*) AS n FROM trace WHERE channel = 'click' GROUP BY ALL)
    SELECT a.trace_id, a.row_idx, b.n AS clicks FROM a LEFT JOIN b ON a.trace_id = b.trace_id AND a.ms // 3600000 = b.hour""")
def left_merge_timeline(s, d):
    t = trace(s, d).withColumn("hour", F.expr("ms div 3600000"))
    clicks = t.where("channel = 'click'").groupBy("trace_id", "hour").agg(F.count("*").alias("clicks"))
    return joins.timeline(t.where("channel <> 'click'"), clicks, ["trace_id", "hour"]).select("trace_id", "row_idx", "clicks")


_SIG = "sig AS (SELECT trace_id, k, row_number() OVER (PARTITION BY trace_id ORDER BY row_idx) - 1 AS row_idx FROM trace WHERE row_idx % 10 = 0)"


def _signal(s, d):
    sig = trace(s, d).where("row_idx % 10 = 0").select("trace_id", F.col("k").alias("signal_k"), F.col("row_idx").alias("old"))
    return frames.with_row_index(sig, ["old"]).drop("old")


@query(f"WITH {TRACE}, {_SIG} SELECT s.trace_id, s.row_idx, s.k AS signal_k, t.ms FROM sig s JOIN trace t ON t.trace_id = s.trace_id AND t.row_idx = s.row_idx * 5")
def positional_every_n(s, d):
    return joins.every_nth(_signal(s, d), trace(s, d).select("trace_id", "row_idx", "ms"), 5, ["trace_id"]).select("trace_id", "row_idx", "signal_k", "ms")


@query(f"""WITH {TRACE}, {_SIG}, c AS (SELECT trace_id, count(*) AS n FROM sig GROUP BY trace_id)
    SELECT t.trace_id, t.row_idx, s.k AS signal_k FROM trace t JOIN c USING (trace_id) JOIN sig s ON s.trace_id = t.trace_id AND s.row_idx = least(t.row_idx // 12, c.n - 1)""")
def positional_expand(s, d):
    return joins.expanded(trace(s, d).select("trace_id", "row_idx"), _signal(s, d), 12, ["trace_id"]).select("trace_id", "row_idx", "signal_k")


@query(f"""WITH {TRACE}, v AS (SELECT * FROM trace WHERE channel = 'view'), c AS (SELECT * FROM trace WHERE channel = 'click')
    SELECT v.event_id, arg_min(c.event_id, (abs(v.ms - c.ms), c.event_id)) AS nearest_id, min(abs(v.ms - c.ms)) AS nearest_gap FROM v LEFT JOIN c USING (trace_id) GROUP BY v.event_id""")
def nearest_time_join(s, d):
    t = trace(s, d)
    return joins.nearest(t.where("channel = 'view'").select("trace_id", "ms", "event_id"), t.where("channel = 'click'"), ["trace_id"], "ms", "ms", "event_id").select("event_id", "nearest_id", "nearest_gap")


@query(f"""WITH {TRACE}, p AS (SELECT trace_id, row_idx FROM trace WHERE value > 60), q AS (SELECT trace_id, row_idx FROM trace WHERE row_idx % 11 = 5)
    SELECT q.trace_id, q.row_idx, arg_min(p.row_idx, (abs(q.row_idx - p.row_idx), p.row_idx)) AS nearest_id FROM q LEFT JOIN p USING (trace_id) GROUP BY ALL""")
def nearest_index(s, d):
    t = trace(s, d)
    peaks = t.where("value > 60").select("trace_id", "row_idx")
    return joins.nearest(t.where("row_idx % 11 = 5").select("trace_id", "row_idx"), peaks, ["trace_id"], "row_idx", "row_idx", "row_idx").select("trace_id", "row_idx", "nearest_id")


@query(f"""WITH {TRACE}, r AS (SELECT trace_id, min(k) % 20 AS start, min(k) % 20 + 15 AS e FROM trace GROUP BY trace_id)
    SELECT t.trace_id, r.start AS range_start, count(*) AS n, round(sum(value), 6) AS total FROM trace t JOIN r ON r.trace_id = t.trace_id AND t.row_idx >= r.start AND t.row_idx < r.e GROUP BY ALL""")
def range_slice_join(s, d):
    t = trace(s, d)
    r = t.groupBy("trace_id").agg((F.min("k") % 20).alias("start")).withColumn("end", F.col("start") + 15)
    return joins.in_range(t, r, ["trace_id"]).groupBy("trace_id", F.col("start").alias("range_start")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query(f"""WITH {TRACE}, e AS (SELECT trace_id, max(row_idx) + 1 AS n FROM trace GROUP BY trace_id),
    s AS (SELECT trace_id, n, CAST(('0x' || substr(md5('tail|' || trace_id), 1, 12)) AS BIGINT) % (n - 10 + 1) AS st FROM e WHERE n >= 10)
    SELECT t.trace_id, t.row_idx - s.st AS sample_row, round(t.value, 6) AS value FROM trace t JOIN s ON s.trace_id = t.trace_id AND t.row_idx >= st AND t.row_idx < st + 10""")
def contiguous_sample(s, d):
    return intervals.contiguous_sample(trace(s, d), 10, "tail").select("trace_id", "sample_row", F.round("value", 6).alias("value"))


@query(f"""WITH {TRACE}, e AS (SELECT trace_id, max(row_idx) + 1 AS n FROM trace GROUP BY trace_id),
    s AS (SELECT trace_id, n, CAST(('0x' || substr(md5('tail|' || trace_id), 1, 12)) AS BIGINT) % (n - 8 + 1) AS st FROM e WHERE n >= 8)
    SELECT trace_id, row_idx, round(value, 6) AS value, false AS appended FROM trace
    UNION ALL SELECT t.trace_id, s.n + t.row_idx - s.st, round(t.value, 6), true FROM trace t JOIN s ON s.trace_id = t.trace_id AND t.row_idx >= st AND t.row_idx < st + 8""")
def tail_append(s, d):
    t = trace(s, d).select("trace_id", "row_idx", "value")
    return intervals.appended(t, intervals.contiguous_sample(t, 8, "tail")).select("trace_id", "row_idx", F.round("value", 6).alias("value"), "appended")


@query(f"""WITH {TRACE}, c AS (SELECT trace_id, row_idx, lead(row_idx) OVER (PARTITION BY trace_id ORDER BY row_idx) AS nx FROM trace WHERE row_idx % 9 = 4)
    SELECT c.trace_id, c.row_idx AS cut_row, c.nx AS next_row, CAST(round_even((SELECT sum(CAST(k AS DOUBLE) / 8) FROM trace t WHERE t.trace_id = c.trace_id AND t.row_idx > c.row_idx AND t.row_idx <= c.nx), 0) AS BIGINT) AS path_length
    FROM c WHERE nx IS NOT NULL""")
def path_between_cuts(s, d):
    t = trace(s, d).withColumn("length", F.col("k") / 8.0)
    return intervals.between_cuts(t.select("trace_id", "row_idx", "length"), t.where("row_idx % 9 = 4").select("trace_id", "row_idx"))


@query(f"""WITH {TRACE}, m AS (SELECT *, value - avg(value) OVER (PARTITION BY trace_id) AS a FROM trace),
    w AS (SELECT *, min(a) OVER (PARTITION BY trace_id ORDER BY row_idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS l, min(a) OVER (PARTITION BY trace_id ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS r FROM m)
    SELECT trace_id, row_idx, round(a - (l + r) / 2, 6) AS amplitude, round(0.47 * pow(a - (l + r) / 2, 0.25), 6) AS step_length FROM w WHERE a - (l + r) / 2 > 0 AND a > 0""")
def step_amplitude(s, d):
    t = trace(s, d)
    a = t.withColumn("a", F.col("value") - F.avg("value").over(frames.whole()))
    a = a.withColumn("amplitude", F.col("a") - (F.min("a").over(frames.rows(-10, -1)) + F.min("a").over(frames.rows(0, 9))) / 2)
    return a.where("amplitude > 0 and a > 0").select("trace_id", "row_idx", F.round("amplitude", 6).alias("amplitude"), F.round(0.47 * F.pow("amplitude", F.lit(0.25)), 6).alias("step_length"))


@query(f"""WITH {TRACE}, n AS (SELECT *, lag(value) OVER {W} AS l, lead(value) OVER {W} AS r, avg(value) OVER (PARTITION BY trace_id) AS m FROM trace),
    t AS (SELECT trace_id, list(struct_pack(row_idx := row_idx, v := value) ORDER BY row_idx) AS tops FROM n WHERE value >= m AND value > l AND value >= r GROUP BY trace_id),
    k AS (SELECT trace_id, list_reduce(list_transform(tops, lambda x: [x]), lambda acc, x: CASE WHEN x[1].row_idx - acc[-1].row_idx < 6 THEN CASE WHEN x[1].v > acc[-1].v THEN list_append(acc[1:len(acc) - 1], x[1]) ELSE acc END ELSE list_append(acc, x[1]) END) AS kept FROM t)
    SELECT trace_id, u.row_idx AS row_idx, round(u.v, 6) AS value FROM (SELECT trace_id, unnest(kept) AS u FROM k)""")
def greedy_steps(s, d):
    t = trace(s, d).withColumn("m", F.avg("value").over(frames.whole()))
    return intervals.greedy_peaks(t, "value", F.col("m"), 6).select("trace_id", "row_idx", F.round("value", 6).alias("value"))
