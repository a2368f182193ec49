"""Queries over scores, error rates, the transition graph, distances and models."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import kernels as K
from ..operators import anchors, distances, embedding, frames, graph, intervals, joins, report, scores, series, states
from ..operators.models import logistic_scores, principal_components
from ..session import stored
from .inputs import LINKS, REGIONS, SCORES, TRACE, links, query, regions, table, trace
from .inputs import scores as score_rows
from .text_queries import CANDIDATE_LCS

# -- statistics by group ------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY l_suppkey HAVING count(*) > 600)")
def semi_valid_groups(s, d):
    return report.large_groups(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), "l_suppkey", 600)


_FAR_OUT = "SELECT event_id FROM (SELECT event_id, value, avg(value) OVER p + 2 * stddev_pop(value) OVER p AS top FROM events WINDOW p AS (PARTITION BY user_id)) WHERE value > top"


@query("SELECT event_id, value > avg(value) OVER p + stddev_pop(value) OVER p AS is_outlier FROM events WINDOW p AS (PARTITION BY user_id)")
def mean_std_outlier(s, d):
    return report.outliers(table(s, d, "events"), "value", ["user_id"], 1.0).select("event_id", "is_outlier")


@query(f"SELECT user_id, count(*) AS n FROM events WHERE event_id NOT IN ({_FAR_OUT}) GROUP BY user_id")
def anti_outliers(s, d):
    e = table(s, d, "events")
    out = report.outliers(e, "value", ["user_id"], 2.0).where("is_outlier").select("event_id")
    return e.join(out, "event_id", "left_anti").groupBy("user_id").agg(F.count("*").alias("n"))


@query("""WITH q AS (SELECT l_suppkey, quantile_cont(l_quantity, 0.2) AS a, quantile_cont(l_quantity, 0.8) AS b FROM lineitem GROUP BY l_suppkey)
    SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS total FROM lineitem JOIN q USING (l_suppkey) WHERE l_quantity >= a - 0.1 * (b - a) AND l_quantity <= b + 0.1 * (b - a) GROUP BY l_suppkey""")
def quantile_fence(s, d):
    return report.fenced(table(s, d, "lineitem"), "l_suppkey", "l_quantity", reach=0.1).groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("total"))


@query("""WITH m AS (SELECT l_suppkey, median(l_extendedprice) AS med FROM lineitem GROUP BY l_suppkey)
    SELECT l_suppkey, round(med, 6) AS median_value, row_number() OVER (ORDER BY med, l_suppkey) - 1 AS new_label, CAST(round_even(med, 0) AS BIGINT) AS start FROM m""")
def relabel_by_median(s, d):
    out = report.relabelled(table(s, d, "lineitem"), "l_suppkey", "l_extendedprice")
    return out.groupBy("l_suppkey", "median_value", "new_label").count().select("l_suppkey", F.round("median_value", 6).alias("median_value"), "new_label", F.bround("median_value", 0).cast("bigint").alias("start"))


@query(f"""WITH {TRACE}, r AS (SELECT trace_id, ms // 1000 AS second, ms, max(value) AS top, avg(value) AS m, count(value) AS n FROM trace GROUP BY ALL)
    SELECT trace_id, second, round(max(top), 6) AS strongest, round(avg(m), 6) AS mean_rssi, round(avg(n), 6) AS mean_count FROM r GROUP BY trace_id, second""")
def per_second_rollup(s, d):
    t = trace(s, d).select("trace_id", F.expr("ms div 1000").alias("second"), "ms", F.col("value").alias("rssi"))
    return scores.per_second(t, ["trace_id"]).select("trace_id", "second", F.round("strongest", 6).alias("strongest"), F.round("mean_rssi", 6).alias("mean_rssi"), F.round("mean_count", 6).alias("mean_count"))


@query(f"""WITH {TRACE}, s AS (SELECT trace_id, ms // 1000 AS second, max(value) AS st, avg(value) AS m, CAST(count(*) AS DOUBLE) AS c FROM trace GROUP BY ALL),
    d1 AS (SELECT *, st - lag(st) OVER w AS d1, m - lag(m) OVER w AS m1 FROM s WINDOW w AS (PARTITION BY trace_id ORDER BY second)), d2 AS (SELECT *, d1 - lag(d1) OVER (PARTITION BY trace_id ORDER BY second) AS d2 FROM d1),
    f AS (SELECT trace_id, count(*) AS n_seconds, stddev_pop(st) AS a, max(st) - min(st) AS b, avg(abs(d1)) AS c, quantile_cont(abs(d1), 0.9) AS d, avg(abs(d2)) AS e, avg(abs(m1)) AS f, stddev_pop(c) AS g FROM d2 GROUP BY trace_id)
    SELECT trace_id, n_seconds, round(a, 5) AS rssi_std, round(d, 5) AS p90_abs_d1, round(.24 * ln(1 + a) + .18 * ln(1 + b) + .24 * ln(1 + c) + .14 * ln(1 + d) + .12 * ln(1 + e) + .05 * ln(1 + f) + .03 * ln(1 + g), 5) AS raw_movement FROM f WHERE n_seconds >= 3""")
def movement_features(s, d):
    t = trace(s, d).select("trace_id", F.expr("ms div 1000").alias("second"), "ms", F.col("value").alias("rssi"))
    sec = t.groupBy("trace_id", "second").agg(F.max("rssi").alias("strongest"), F.avg("rssi").alias("mean_rssi"), F.count("*").cast("double").alias("mean_count"))
    return scores.movement(sec, ["trace_id"]).select("trace_id", "n_seconds", F.round("rssi_std", 5).alias("rssi_std"), F.round("p90_abs_d1", 5).alias("p90_abs_d1"), F.round("raw_movement", 5).alias("raw_movement"))


@query("""WITH q AS (SELECT median(value) AS m, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b, stddev_pop(value) AS sd FROM events WHERE event_type = 'view')
    SELECT event_id, round(1 / (1 + exp(-(value - m) / CASE WHEN b - a > 0 THEN b - a WHEN sd > 0 THEN sd ELSE 1.0 END)), 6) AS score FROM events, q""")
def robust_sigmoid(s, d):
    e = table(s, d, "events")
    q = e.where("event_type = 'view'").agg(F.median("value").alias("m"), F.percentile("value", [0.25, 0.75]).alias("p"), F.stddev_pop("value").alias("sd"))
    return e.crossJoin(F.broadcast(q)).select("event_id", F.round(scores.robust(F.col("value"), F.col("m"), F.col("p")[0], F.col("p")[1], F.col("sd")), 6).alias("score"))


_CELLS = f"""{TRACE}, c AS (SELECT trace_id, k % 8 AS cell_id, median(-value) AS m, channel FROM trace GROUP BY trace_id, k % 8, channel), fp AS (SELECT trace_id, cell_id, avg(m) AS rssi FROM c GROUP BY ALL),
    st AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY trace_id ORDER BY row_idx)) AS step FROM trace),
    mg AS (SELECT trace_id, avg(value) AS m1, stddev_pop(value) AS m2, coalesce(avg(step), 0) AS m3, quantile_cont(value, 0.9) - quantile_cont(value, 0.1) AS m4 FROM st GROUP BY trace_id)"""


def _fingerprints(s, d):
    cells = trace(s, d).select("trace_id", (F.col("k") % 8).alias("cell_id"), "channel", (-F.col("value")).alias("rssi"))
    return scores.fingerprint(cells, ["trace_id"])


@query(f"WITH {_CELLS} SELECT trace_id, cell_id, round(rssi, 6) AS rssi, round(m1, 6) AS meg_mean, round(m2, 6) AS meg_deviation, round(m3, 6) AS meg_step, round(m4, 6) AS meg_spread FROM fp JOIN mg USING (trace_id)")
def fingerprint(s, d):
    both = _fingerprints(s, d).join(scores.magnetic(trace(s, d), "value", ["trace_id"]), "trace_id")
    return both.select("trace_id", "cell_id", F.round("rssi", 6).alias("rssi"), *[F.round(F.get("meg", F.lit(i)), 6).alias(n) for i, n in enumerate(("meg_mean", "meg_deviation", "meg_step", "meg_spread"))])


def _route_sql(n: str) -> str:
    """The five cells of the route numbered ``n``."""
    return f"list_transform(range(0, 5), lambda i: substr('abcdef', CAST(({n} * 3 + i * i) % 6 + 1 AS INT), 1) || CAST(CAST(({n} + i) % 6 + 1 AS INT) AS VARCHAR))"


def _route(n):
    n = n.cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.concat(F.substring(F.lit("abcdef"), (n * 3 + i * i) % 6 + 1, F.lit(1)), ((n + i) % 6 + 1).cast("string")))


def _library(s, d):
    """Routes that references were walked on: one a nation."""
    return table(s, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("reference_id"), _route(F.col("n_nationkey")).alias("ref"))


_LCS_LIB = f"""lib AS (SELECT CAST(n_nationkey AS BIGINT) AS reference_id, {_route_sql("n_nationkey")} AS ref FROM nation),
    r(claim_id, a, reference_id, b, i, line) AS (
    SELECT q.claim_id, q.claimed, lib.reference_id, lib.ref, 0, list_transform(range(0, len(lib.ref) + 1), lambda j: 0) FROM asked q, lib
    UNION ALL
    SELECT claim_id, a, reference_id, b, i + 1, list_reduce(list_transform(range(1, len(b) + 1), lambda j: [CAST(j AS INT)]), lambda acc, j: list_append(acc, CASE WHEN a[i + 1] = b[j[1]] THEN line[j[1]] + 1 ELSE greatest(line[j[1] + 1], acc[-1]) END), [0]) FROM r WHERE i < len(a)),
    z AS (SELECT claim_id, reference_id, CAST(line[-1] AS DOUBLE) / greatest(len(a), len(b)) AS l FROM r WHERE i = len(a)),
    best AS (SELECT claim_id, arg_min(reference_id, (-l, reference_id)) AS reference_id, max(l) AS likeness FROM z GROUP BY claim_id)"""

# A trace claims one of 30 routes; references know 25 of them, and of each all traces walked on it.
_FP = f"""WITH RECURSIVE {_CELLS}, asked AS (SELECT trace_id AS claim_id, {_route_sql("((trace_id * 3 + 1) % 30)")} AS claimed FROM mg), {_LCS_LIB},
    b AS (SELECT trace_id AS ref, trace_id % 25 AS reference_id FROM mg),
    p AS (SELECT best.claim_id AS trace_id, ref, likeness FROM best JOIN b USING (reference_id) WHERE ref <> claim_id),
    ids AS (SELECT DISTINCT p.trace_id, p.ref, fp.cell_id FROM p JOIN fp ON fp.trace_id = p.trace_id OR fp.trace_id = p.ref),
    g AS (SELECT ids.trace_id, ids.ref, coalesce(x.rssi, -110) - coalesce(y.rssi, -110) AS gap FROM ids LEFT JOIN fp x ON x.trace_id = ids.trace_id AND x.cell_id = ids.cell_id LEFT JOIN fp y ON y.trace_id = ids.ref AND y.cell_id = ids.cell_id),
    sig AS (SELECT trace_id, ref, sqrt(avg(gap * gap)) / 18.0 AS signal FROM g GROUP BY ALL),
    dist AS (SELECT p.trace_id, p.ref, likeness, .85 * signal + .15 * sqrt(pow(x.m1 - y.m1, 2) + pow(x.m2 - y.m2, 2) + pow(x.m3 - y.m3, 2) + pow(x.m4 - y.m4, 2)) / 2 / 25 AS distance
        FROM p JOIN sig USING (trace_id, ref) JOIN mg x ON x.trace_id = p.trace_id JOIN mg y ON y.trace_id = p.ref)"""


def _reference_distances(s, d):
    """Each trace against all fingerprints walked on the route that is most like the one it claims."""
    t = stored(trace(s, d), "trace")
    cells = scores.fingerprint(t.select("trace_id", (F.col("k") % 8).alias("cell_id"), "channel", (-F.col("value")).alias("rssi")), ["trace_id"])
    listed = F.array_sort(F.collect_list(F.struct("cell_id", "rssi")))
    maps = cells.groupBy("trace_id").agg(listed.alias("x")).select("trace_id", F.col("x.cell_id").alias("ids"), F.col("x.rssi").alias("rssi"))
    prints = stored(maps.join(scores.magnetic(t, "value", ["trace_id"]), "trace_id"), "fingerprints")
    asked = prints.select("trace_id", _route((F.col("trace_id") * 3 + 1) % 30).alias("claimed"))
    route = joins.closest_key(asked, _library(s, d), "trace_id", "claimed", "ref").select("trace_id", F.col("reference_id").alias("label"), "likeness")
    claims = stored(prints.join(route, "trace_id"), "fingerprint-claims")
    walked = prints.withColumn("label", F.col("trace_id") % 25)
    far = distances.met(claims, "trace_id", "label", ["ids", "rssi", "meg"], {"dist": scores.fingerprint_distances}, by="label", nearest=3, right=walked)
    return far.withColumnRenamed("key", "trace_id").join(route.select("trace_id", "likeness"), "trace_id")


@query(f"{_FP} SELECT trace_id, count(*) AS n, arg_min(ref, (round(distance, 9), ref)) AS ref, round(min(distance), 6) AS distance, round(avg(distance), 6) AS mean_distance FROM dist GROUP BY trace_id")
def fingerprint_distance(s, d):
    """Of all references of a route how many there are, the nearest, and the mean distance."""
    near = _reference_distances(s, d)
    return near.select("trace_id", "n", F.col("near")[0]["other"].alias("ref"), F.round("dist_least", 6).alias("distance"), F.round(F.col("dist_total") / F.col("n"), 6).alias("mean_distance"))


@query(f"{_FP}, n AS (SELECT trace_id, avg(distance) + 1 - any_value(likeness) AS m FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY distance) AS r FROM dist) WHERE r <= 3 GROUP BY trace_id) SELECT trace_id, round(m, 6) AS mean3, round(1 / (1 + m), 6) AS score FROM n")
def mean_3_smallest(s, d):
    """The mean of the three nearest references, and what the claimed route lacks to theirs."""
    near = _reference_distances(s, d).withColumn("m", distances.near_mean() + 1 - F.col("likeness"))
    return near.select("trace_id", F.round("m", 6).alias("mean3"), F.round(C.similarity("m"), 6).alias("score"))


@query("SELECT user_id, round(avg(value), 6) AS mean, round(min(value), 6) AS low, round(max(value), 6) AS high, round(stddev_pop(value), 6) AS sd, round(var_pop(value), 5) AS variance FROM events GROUP BY user_id")
def summary_stats(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"), F.round(F.stddev_pop("value"), 6).alias("sd"), F.round(F.var_pop("value"), 5).alias("variance"))


_IDS = """WITH c AS (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, k) AS r, sum(n) OVER (PARTITION BY user_id) AS v FROM c),
    ids AS (SELECT user_id, CAST(max(v) AS BIGINT) AS valid, count(*) AS distinct_ids, coalesce(max(k) FILTER (r = 1), 0) AS top1_id, coalesce(max(n / v) FILTER (r = 1), 0) AS top1_ratio, coalesce(max(k) FILTER (r = 2), 0) AS top2_id, coalesce(max(n / v) FILTER (r = 2), 0) AS top2_ratio,
        coalesce(max(k) FILTER (r = 3), 0) AS top3_id, coalesce(max(n / v) FILTER (r = 3), 0) AS top3_ratio FROM r GROUP BY user_id)"""


def _id_stats(s, d):
    e = table(s, d, "events").select("user_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return report.id_statistics(e, ["user_id"], "k")


@query(f"{_IDS} SELECT user_id, valid, distinct_ids, top1_id, round(top1_ratio, 6) AS top1_ratio, top2_id, round(top2_ratio, 6) AS top2_ratio, top3_id, round(top3_ratio, 6) AS top3_ratio FROM ids")
def id_stats(s, d):
    return _id_stats(s, d).select("user_id", "valid", "distinct_ids", *[c for i in (1, 2, 3) for c in (F.col(f"top{i}_id"), F.round(f"top{i}_ratio", 6).alias(f"top{i}_ratio"))])


_FEATURES = f"""{_IDS.replace("WITH ", "", 1)}, {TRACE}, m AS (SELECT trace_id AS user_id, avg(value) AS mean, min(value) AS low, max(value) AS high, stddev_pop(value) AS sd, var_pop(value) AS variance FROM trace GROUP BY trace_id),
    cg AS (SELECT trace_id, CASE WHEN lag(k) OVER w IS NULL THEN NULL WHEN k <> lag(k) OVER w THEN 1 ELSE 0 END AS changed FROM trace WINDOW w AS (PARTITION BY trace_id ORDER BY row_idx)),
    ch AS (SELECT trace_id AS user_id, CAST(coalesce(sum(changed), 0) AS BIGINT) AS changes, coalesce(avg(changed), 0) AS change_rate FROM cg GROUP BY trace_id),
    feats AS (SELECT * FROM m JOIN ids USING (user_id) JOIN ch USING (user_id))"""
_FEATURE_NAMES = ["mean", "low", "high", "sd", "variance", "valid", "distinct_ids", "changes", "change_rate", "top1_id", "top2_id", "top3_id", "top1_ratio", "top2_ratio", "top3_ratio"]


def _features(s, d):
    """The fifteen features of each trace: five of the field, ten of the cell ids."""
    t = trace(s, d)
    m = t.groupBy("trace_id").agg(F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.stddev_pop("value").alias("sd"), F.var_pop("value").alias("variance"))
    before = F.lag("k").over(frames.over())
    changed = t.withColumn("changed", F.when(before.isNotNull(), (F.col("k") != before).cast("int"))).groupBy("trace_id").agg(F.coalesce(F.sum("changed"), F.lit(0)).alias("changes"), F.coalesce(F.avg("changed"), F.lit(0.0)).alias("change_rate"))
    return m.join(changed, "trace_id").withColumnRenamed("trace_id", "user_id").join(_id_stats(s, d), "user_id").select("user_id", *_FEATURE_NAMES)


@query(f"WITH {_FEATURES} SELECT user_id, {', '.join(f'round({n}, 5) AS {n}' for n in _FEATURE_NAMES)} FROM feats")
def file_features(s, d):
    return _features(s, d).select("user_id", *[F.round(n, 5).alias(n) for n in _FEATURE_NAMES])


# The eight features that the learned baseline uses.
_SELECTED = ["mean", "low", "high", "sd", "variance", "changes", "change_rate", "top1_id"]


@query(f"""WITH {_FEATURES}, s AS (SELECT c_custkey AS claim_id, c_custkey // 10 AS user_id, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 2 AS INT) END AS label FROM customer)
    SELECT claim_id, CASE WHEN label IS NULL THEN 'test' ELSE 'train' END AS part, label, {', '.join(f'round(coalesce({n}, 0), 5) AS {n}' for n in _SELECTED)} FROM s LEFT JOIN feats USING (user_id) WHERE label IS NULL OR mean IS NOT NULL""")
def learning_sets(s, d):
    """Claims with the eight chosen features: training rows without a trace go, test rows without one have zeros."""
    c = table(s, d, "customer").select(F.col("c_custkey").alias("claim_id"), F.expr("c_custkey div 10").alias("user_id"), F.when(F.col("c_custkey") % 3 == 0, (F.col("c_custkey") % 2).cast("int")).alias("label"))
    both = c.join(_features(s, d), "user_id", "left").where("label is null or mean is not null")
    part = F.when(F.col("label").isNull(), "test").otherwise("train")
    return both.select("claim_id", part.alias("part"), "label", *[F.round(F.coalesce(F.col(n), F.lit(0)), 5).alias(n) for n in _SELECTED])


_MAD = f"""{TRACE}, d AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY trace_id ORDER BY row_idx)) AS d FROM trace), m AS (SELECT trace_id, median(d) AS m FROM d GROUP BY trace_id),
    a AS (SELECT trace_id, median(abs(d - m)) AS mad, any_value(m) AS m FROM d JOIN m USING (trace_id) GROUP BY trace_id),
    sp AS (SELECT trace_id, any_value(mad) AS mad, avg(CASE WHEN d IS NULL THEN NULL WHEN d > m + 6 * greatest(mad, 1e-6) THEN 1 ELSE 0 END) AS spike_ratio, avg(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS missing_ratio FROM d JOIN a USING (trace_id) GROUP BY trace_id)"""


@query(f"WITH {_MAD} SELECT trace_id, round(mad, 6) AS mad, round(spike_ratio, 6) AS spike_ratio, round(least(greatest(1 - (missing_ratio + least(0.5, 5 * spike_ratio)), 0), 1), 6) AS continuity FROM sp")
def mad_spikes(s, d):
    t = scores.spikes(trace(s, d), "value", ["trace_id"])
    return t.select("trace_id", F.round("mad", 6).alias("mad"), F.round("spike_ratio", 6).alias("spike_ratio"), F.round(scores.continuity(F.col("spike_ratio"), F.col("missing_ratio"), F.lit(1.0)), 6).alias("continuity"))


@query("SELECT user_id, round(avg(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END), 6) AS missing_ratio FROM events GROUP BY user_id")
def missing_ratio(s, d):
    v = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    return table(s, d, "events").groupBy("user_id").agg(F.round(F.avg(v.isNull().cast("int")), 6).alias("missing_ratio"))


@query("SELECT user_id, round(fmod(degrees(atan2(avg(sin(radians(fmod(value * 7, 360)))), avg(cos(radians(fmod(value * 7, 360)))))) + 360.0, 360.0), 4) AS direction FROM events GROUP BY user_id")
def circular_mean(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.round(C.circular_mean(F.expr("(value * 7) % 360.0D")), 4).alias("direction"))


_EMB = "e AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


@query(f"WITH {_EMB}, m AS (SELECT i, avg(x) AS m, stddev_pop(x) AS sd FROM e GROUP BY i) SELECT vec_id, round(sum((x - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END), 4) AS total FROM e JOIN m USING (i) GROUP BY vec_id")
def column_standardize(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "f")).withColumn("x", F.col("f").cast("double"))
    stats = e.groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    z = e.join(stats, "i").withColumn("z", (F.col("x") - F.col("m")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")))
    return z.groupBy("vec_id").agg(F.round(F.sum("z"), 4).alias("total"))


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def label_distribution(s, d):
    return table(s, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority AS key, round(avg(CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END), 4) AS score, count(*) AS row_count FROM orders GROUP BY o_orderpriority")
def score_mean_size(s, d):
    o = table(s, d, "orders").select(F.col("o_orderpriority").alias("key"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("score"))
    return scores.mean_by_key(o, "key", "score").select("key", F.round("score", 4).alias("score"), "row_count")


# -- scores -------------------------------------------------------------------


@query("SELECT o_orderkey, round(least(greatest(1 - abs(a - b) / greatest(abs(a), abs(b), 1e-9), 0), 1), 6) AS s_time FROM (SELECT o_orderkey, o_totalprice AS a, CAST(o_custkey * 90 AS DOUBLE) AS b FROM orders)")
def time_score(s, d):
    return table(s, d, "orders").select("o_orderkey", F.round(C.relative_score(F.col("o_totalprice"), F.col("o_custkey") * 90.0), 6).alias("s_time"))


_TABLES = """t AS (SELECT o_orderkey AS sample_key, (o_custkey % 101) / 100.0 AS s_topo FROM orders WHERE o_orderkey % 5 <> 0), c AS (SELECT o_orderkey AS sample_key, (o_custkey % 97) / 96.0 AS s_curr FROM orders WHERE o_orderkey % 7 <> 0),
    g AS (SELECT o_orderkey AS sample_key, (o_custkey % 89) / 88.0 AS s_signal FROM orders WHERE o_orderkey % 11 <> 0), m AS (SELECT o_orderkey AS sample_key, (o_custkey % 83) / 82.0 AS s_time FROM orders),
    j AS (SELECT o_orderkey AS sample_key, coalesce(s_topo, 0.0) AS s_topo, coalesce(s_curr, 0.0) AS s_curr, coalesce(s_signal, 0.0) AS s_signal, coalesce(s_time, 0.0) AS s_time, s_topo IS NULL AS missing_s_topo, s_curr IS NULL AS missing_s_curr
        FROM orders LEFT JOIN t ON t.sample_key = o_orderkey LEFT JOIN c ON c.sample_key = o_orderkey LEFT JOIN g ON g.sample_key = o_orderkey LEFT JOIN m ON m.sample_key = o_orderkey)"""


def _fused(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("sample_key"), "o_custkey")
    part = lambda name, n, drop: o.where(F.col("sample_key") % drop != 0 if drop else F.lit(True)).select("sample_key", ((F.col("o_custkey") % n) / (n - 1.0)).alias(name))
    return scores.fused(o.select("sample_key"), "sample_key", {"s_topo": part("s_topo", 101, 5), "s_curr": part("s_curr", 97, 7), "s_signal": part("s_signal", 89, 11), "s_time": part("s_time", 83, 0)})


@query(f"WITH {_TABLES} SELECT sample_key, round(s_topo, 6) AS s_topo, round(s_curr, 6) AS s_curr, round(s_signal, 6) AS s_signal, missing_s_topo, missing_s_curr FROM j")
def score_left_join_fill(s, d):
    return _fused(s, d).select("sample_key", *[F.round(c, 6).alias(c) for c in ("s_topo", "s_curr", "s_signal")], "missing_s_topo", "missing_s_curr")


@query(f"WITH {_TABLES} SELECT sample_key, round(.4 * s_topo + .3 * s_curr + .2 * s_signal + .1 * s_time, 9) AS s_total FROM j")
def fusion_score(s, d):
    return _fused(s, d).select("sample_key", F.round("s_total", 9).alias("s_total"))


@query(f"""WITH {_TABLES} SELECT sample_key, round((.3 * s_curr + .2 * s_signal + .1 * s_time) / .6, 9) AS without_topology, round((.4 * s_topo + .2 * s_signal + .1 * s_time) / .7, 9) AS without_current,
    round((.4 * s_topo + .3 * s_curr + .1 * s_time) / .8, 9) AS without_signal, round((.4 * s_topo + .3 * s_curr + .2 * s_signal) / .9, 9) AS without_time FROM j""")
def ablation_scores(s, d):
    names = {"without_topology": "s_topo", "without_current": "s_curr", "without_signal": "s_signal", "without_time": "s_time"}
    return _fused(s, d).select("sample_key", *[F.round(scores.weighted(scores.FUSION, drop), 9).alias(name) for name, drop in names.items()])


@query(f"WITH {SCORES} SELECT attack, threshold, count(*) AS total_count, CAST(sum(CASE WHEN score >= threshold THEN 1 ELSE 0 END) AS BIGINT) AS accepted_count, round(avg(CASE WHEN score >= threshold THEN 1 ELSE 0 END), 6) AS far FROM scores, (SELECT unnest([0.775, 0.785, 0.795]) AS threshold) GROUP BY attack, threshold".replace("unnest([0.775, 0.785, 0.795])", "CAST(unnest([0.775, 0.785, 0.795]) AS DOUBLE)"))
def far_counts(s, d):
    return report.false_accepts(score_rows(s, d), "attack", "score", (0.775, 0.785, 0.795))


_ATTACKS = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


@query(f"""WITH {SCORES}, f AS (SELECT attack, CAST(threshold AS DOUBLE) AS threshold, round(avg(CASE WHEN score >= threshold THEN 1 ELSE 0 END), 6) AS far FROM scores, (SELECT unnest([0.775, 0.785, 0.795]) AS threshold) GROUP BY ALL)
    SELECT threshold, coalesce(max(far) FILTER (attack = '1-URGENT'), 0.0) AS urgent, coalesce(max(far) FILTER (attack = '2-HIGH'), 0.0) AS high, coalesce(max(far) FILTER (attack = '3-MEDIUM'), 0.0) AS medium FROM f GROUP BY threshold""")
def pivot_far(s, d):
    far = report.false_accepts(score_rows(s, d), "attack", "score", (0.775, 0.785, 0.795))
    return report.wide(far, "attack", _ATTACKS).select("threshold", F.col("1-URGENT").alias("urgent"), F.col("2-HIGH").alias("high"), F.col("3-MEDIUM").alias("medium"))


@query(f"WITH {SCORES} SELECT round(avg(CASE WHEN score >= 0.795 THEN 1 ELSE 0 END), 6) AS far, CAST(0.795 AS DOUBLE) AS threshold, attack FROM scores GROUP BY attack")
def far_by_threshold(s, d):
    return report.false_accepts(score_rows(s, d), "attack", "score", (0.795,)).select("far", "threshold", "attack")


@query(f"WITH {SCORES} SELECT sample, coalesce(score >= 0.775, false) AS accepted_at_0_78, coalesce(score >= 0.825, false) AS accepted_at_0_82 FROM scores")
def acceptance_matrix(s, d):
    return report.accepted(score_rows(s, d), "score", (0.775, 0.825)).select("sample", "accepted_at_0_78", "accepted_at_0_82")


@query(f"""WITH {SCORES}, g AS (SELECT unnest([0.01, 0.02, 0.05]) AS frr), q AS (SELECT CAST(frr AS DOUBLE) AS frr, (SELECT quantile_cont(score + sample % 1000 / 1e6, CAST(frr AS DOUBLE)) FROM scores WHERE attack = '5-LOW') AS threshold FROM g)
    SELECT attack, frr, round(threshold, 8) AS threshold, round(avg(CASE WHEN score + sample % 1000 / 1e6 IS NULL THEN NULL WHEN score + sample % 1000 / 1e6 >= threshold THEN 1 ELSE 0 END) * 100, 6) AS far_percent FROM scores, q WHERE attack <> '5-LOW' GROUP BY ALL""".replace("(SELECT quantile_cont(score + sample % 1000 / 1e6, CAST(frr AS DOUBLE)) FROM scores WHERE attack = '5-LOW')", "CASE frr WHEN 0.01 THEN (SELECT quantile_cont(score + sample % 1000 / 1e6, 0.01) FROM scores WHERE attack = '5-LOW') WHEN 0.02 THEN (SELECT quantile_cont(score + sample % 1000 / 1e6, 0.02) FROM scores WHERE attack = '5-LOW') ELSE (SELECT quantile_cont(score + sample % 1000 / 1e6, 0.05) FROM scores WHERE attack = '5-LOW') END"))
def frr_calibrated_far(s, d):
    rows = score_rows(s, d).withColumn("score", F.col("score") + F.col("sample") % 1000 / 1e6)
    out = report.calibrated(rows.where("attack = '5-LOW'"), rows.where("attack <> '5-LOW'"), "attack", "score", (0.01, 0.02, 0.05))
    return out.select("attack", "frr", F.round("threshold", 8).alias("threshold"), F.round("far_percent", 6).alias("far_percent"))


@query(f"""WITH {REGIONS}, {_MAD}, act AS (SELECT trace_id, stddev_pop(value) / 600 AS activity FROM trace GROUP BY trace_id),
    cont AS (SELECT trace_id, least(greatest(1 - (missing_ratio + CASE WHEN activity < 0.01 THEN 0.4 WHEN activity < 0.05 THEN 0.2 ELSE 0.0 END + least(0.5, 5 * coalesce(spike_ratio, 0))), 0), 1) AS c FROM sp JOIN act USING (trace_id)),
    g AS (SELECT claim_id, coalesce(c, 0.0) AS c, CAST(claim_id % 200 + 20 AS DOUBLE) AS t, CAST(claim_id % 170 + 25 AS DOUBLE) AS a, list_transform(claimed, lambda x: [ascii(x) - 97, CAST(substr(x, 2, 1) AS INT) - 1]) AS v
        FROM regions JOIN orders ON o_orderkey = claim_id LEFT JOIN cont ON trace_id = o_custkey // 10),
    j AS (SELECT *, list_transform(range(1, len(v)), lambda i: abs(v[i][1] - v[i + 1][1]) + abs(v[i][2] - v[i + 1][2])) AS jumps FROM g),
    r AS (SELECT claim_id, c, exp(-(abs(t - a) / greatest(a, 1.0)) / 0.25) AS ts, coalesce(list_sum(list_transform(jumps, lambda x: greatest(x, 1))), 0) * 10.0 / t AS speed, len(jumps) AS n,
        1 - coalesce(list_avg(list_transform(jumps, lambda x: CASE WHEN x <= 1 THEN 0.0 WHEN x = 2 THEN 0.25 ELSE least(1.0, 0.25 + 0.25 * (x - 2)) END)), 0) AS route FROM j),
    q AS (SELECT *, CASE WHEN n = 0 THEN 0.0 WHEN speed <= 2 THEN 1.0 ELSE exp(-(speed - 2) / 2) END AS sp FROM r)
    SELECT claim_id, round(ts, 6) AS time_check, round(sp, 6) AS speed_check, round(c, 6) AS continuity, round(.3 * ts + .3 * sp + .2 * c + .2 * route, 6) AS rule_score FROM q""")
def rule_scores(s, d):
    """Time, speed, continuity of the claim's trace (none: 0) and route."""
    t = trace(s, d)
    checks = scores.spikes(t, "value", ["trace_id"]).join(t.groupBy("trace_id").agg((F.stddev_pop("value") / 600).alias("activity")), "trace_id")
    checks = checks.select("trace_id", scores.continuity(F.coalesce("spike_ratio", F.lit(0.0)), F.col("missing_ratio"), F.col("activity")).alias("c"))
    r = regions(s, d).join(table(s, d, "orders").select(F.col("o_orderkey").alias("claim_id"), F.expr("o_custkey div 10").alias("trace_id")), "claim_id").join(checks, "trace_id", "left").withColumn("c", F.coalesce("c", F.lit(0.0)))
    r = r.withColumn("cells", F.transform("claimed", C.grid_cell)).withColumn("t", (F.col("claim_id") % 200 + 20).cast("double")).withColumn("a", (F.col("claim_id") % 170 + 25).cast("double"))
    time, speed = scores.rule_time(F.col("t"), F.col("a")), scores.rule_speed(C.region_jumps("cells"), F.col("t"))
    return r.select("claim_id", F.round(time, 6).alias("time_check"), F.round(speed, 6).alias("speed_check"), F.round("c", 6).alias("continuity"), F.round(scores.rule_total(time, speed, F.col("c"), C.route_score("cells")), 6).alias("rule_score"))


_CIRC = lambda a, b: f"abs(fmod(fmod({a} - {b} + 180, 360) + 360, 360) - 180)"
_MEAN = lambda x: f"fmod(degrees(atan2(avg(sin(radians({x}))), avg(cos(radians({x}))))) + 360.0, 360.0)"
_SEAMS = f"""{TRACE}, h AS (SELECT trace_id, row_idx, fmod(value * 7.0, 360.0) AS h FROM trace), size AS (SELECT trace_id, count(*) AS n FROM trace GROUP BY trace_id),
    seams AS (SELECT trace_id, 'random' || CAST(j AS VARCHAR) AS seam, 20 + CAST(('0x' || substr(md5('seam|' || CAST(trace_id AS VARCHAR) || '|' || CAST(j AS VARCHAR)), 1, 12)) AS BIGINT) % (n - 39) AS start FROM size, (SELECT unnest([0, 1]) AS j) WHERE n >= 40
        UNION ALL SELECT trace_id, 'tail', n - 40 FROM size WHERE n >= 60),
    pr AS (SELECT s.trace_id, seam, start, c.row_idx - start AS pos, b.h AS before, c.h AS now FROM seams s JOIN h c ON c.trace_id = s.trace_id AND c.row_idx >= start AND c.row_idx < start + 20 JOIN h b ON b.trace_id = c.trace_id AND b.row_idx = c.row_idx - 20),
    ends AS (SELECT trace_id, seam, start, avg({_CIRC("before", "now")}) AS profile, max(before) FILTER (pos = 19) AS l, max(now) FILTER (pos = 0) AS f, {_MEAN("before")} AS mb, {_MEAN("now")} AS mn FROM pr GROUP BY ALL),
    tr AS (SELECT trace_id, seam, start, least(greatest(1 - (.5 * {_CIRC("l", "f")} + .3 * {_CIRC("mb", "mn")} + .2 * profile) / 180.0, 0), 1) AS transition FROM ends)"""


def _seam_scores(s, d):
    t = trace(s, d).select("trace_id", "row_idx", F.expr("(value * 7.0D) % 360.0D").alias("heading"))
    return scores.seam_scores(t, scores.seams(t, 20, 40), "heading", 20)


@query(f"WITH {_SEAMS} SELECT trace_id, seam, start, round(transition, 6) AS transition FROM tr")
def heading_transition(s, d):
    """Headings before and after two random places and the tail of each trace."""
    return _seam_scores(s, d).select("trace_id", "seam", "start", F.round("transition", 6).alias("transition"))


_HOPS = """hp(src, dst, distance) AS (SELECT DISTINCT src, src, 0 FROM both_ways UNION SELECT hp.src, b.dst, distance + 1 FROM hp JOIN both_ways b ON b.src = hp.dst WHERE distance < 25),
    hops AS (SELECT src, dst, min(distance) AS distance FROM hp GROUP BY src, dst)"""


@query(f"""WITH RECURSIVE {LINKS}, {_HOPS}, {_SEAMS}, ps AS (SELECT trace_id, avg(transition) FILTER (seam <> 'tail') AS rnd, max(transition) FILTER (seam = 'tail') AS tail FROM tr GROUP BY trace_id),
    x AS (SELECT ps.*, distance AS hop FROM ps LEFT JOIN hops ON src = trace_id % 25 AND dst = trace_id * 7 % 27)
    SELECT trace_id, round(CASE WHEN hop IS NULL THEN -1.0 ELSE .8 * CASE WHEN rnd IS NULL THEN tail WHEN tail IS NULL THEN rnd ELSE .2 * rnd + .8 * tail END + .2 * CASE WHEN hop <= 4 THEN 1.0 ELSE pow(4.0 / hop, 2) END END, 6) AS s_current,
        round(CASE WHEN hop IS NULL THEN 0.0 WHEN hop <= 4 THEN 1.0 ELSE pow(4.0 / hop, 2) END, 6) AS jump FROM x""")
def current_score(s, d):
    """From the seams of each trace and the links between the states it names; a state out of the graph can't be reached."""
    tail = F.col("seam") == "tail"
    post = _seam_scores(s, d).groupBy("trace_id").agg(F.avg(F.when(~tail, F.col("transition"))).alias("rnd"), F.max(F.when(tail, F.col("transition"))).alias("tail"))
    named = post.withColumn("src", F.col("trace_id") % 25).withColumn("dst", F.col("trace_id") * 7 % 27)
    c = named.join(graph.hops(links(s, d), named.select("src")), ["src", "dst"], "left")
    hop = F.col("distance")
    return c.select("trace_id", F.round(scores.current_score(F.col("rnd"), F.col("tail"), C.topology_break(hop), hop.isNotNull()), 6).alias("s_current"), F.round(C.topology_break(hop), 6).alias("jump"))


@query(None)
def location_score(s, d):
    """The gate over measured similarities: the claim numbered like a vector takes its three signal scores."""
    measured = signal_scores(s, d).withColumnRenamed("vec_id", "claim_id")
    both = regions(s, d).join(measured, "claim_id")
    return scores.location_gate(both, "claimed", "detected").select("claim_id", "topology_passed", "s_lte", "s_meg", "s_signal", "s_location")


@query(f"""WITH {REGIONS} SELECT claim_id, list_has_any(claimed, detected) AS topology_passed, round(CASE WHEN list_has_any(claimed, detected) THEN .2 * (claim_id % 11) / 10.0 + .3 * (claim_id % 13) / 12.0 + .5 * (claim_id % 7) / 6.0 ELSE -1.0 END, 6) AS s_location FROM regions""")
def location_gate(s, d):
    r = regions(s, d).withColumn("s_lte", F.col("claim_id") % 11 / 10.0).withColumn("s_meg", F.col("claim_id") % 13 / 12.0).withColumn("s_signal", F.col("claim_id") % 7 / 6.0)
    return scores.location_gate(r, "claimed", "detected").select("claim_id", "topology_passed", "s_location")


# -- graph --------------------------------------------------------------------


@query(f"WITH {LINKS} SELECT src, array_to_string(list(CAST(dst AS VARCHAR) ORDER BY dst), ',') AS neighbours FROM both_ways GROUP BY src")
def graph_symmetrize(s, d):
    return graph.adjacency(links(s, d)).select("src", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


# Only walks that are shortest so far go on.
_PATHS = f"""{LINKS}, {_HOPS}, p(src, dst, path) AS (SELECT DISTINCT src, src, [src] FROM both_ways UNION ALL
        SELECT p.src, b.dst, list_append(path, b.dst) FROM p JOIN both_ways b ON b.src = p.dst JOIN hops h ON h.src = p.src AND h.dst = b.dst WHERE h.distance = len(path)),
    sp AS (SELECT src, dst, min(path) AS path FROM p GROUP BY src, dst)"""
_LENGTHS = f"""{LINKS}, w AS (SELECT src, dst, min(length) AS length FROM (SELECT * FROM links UNION ALL SELECT dst, src, length FROM links) WHERE src <> dst GROUP BY src, dst),
    r(src, dst, length, n) AS (SELECT DISTINCT src, src, CAST(0 AS DOUBLE), 0 FROM w UNION SELECT r.src, w.dst, min(r.length + w.length), n + 1 FROM r JOIN w ON w.src = r.dst WHERE n < 25 GROUP BY r.src, w.dst, n),
    sp AS (SELECT src, dst, min(length) AS length FROM r GROUP BY src, dst)"""


@query(f"WITH RECURSIVE {LINKS}, {_HOPS} SELECT * FROM hops")
def bfs_distance(s, d):
    return graph.hops(links(s, d))


@query(f"WITH RECURSIVE {_PATHS} SELECT src, dst, array_to_string(list_transform(path, lambda x: CAST(x AS VARCHAR)), '>') AS path FROM sp")
def shortest_path_nodes(s, d):
    return graph.shortest_paths(links(s, d)).select("src", "dst", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query(f"WITH RECURSIVE {_LENGTHS} SELECT * FROM sp")
def dijkstra(s, d):
    return graph.weighted(links(s, d))


_MERGE = f"""{LINKS}, m AS (SELECT n, CASE WHEN n % 5 = 4 THEN n - 4 ELSE n END AS node FROM n), moved AS (SELECT a.node AS src, b.node AS dst, length FROM links JOIN m a ON a.n = src JOIN m b ON b.n = dst WHERE a.node <> b.node)"""


def _merged(s, d):
    nodes = table(s, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("node"))
    mapping = nodes.where("node % 5 = 4").select(F.col("node").alias("old"), (F.col("node") - 4).alias("new"))
    return graph.merged_nodes(nodes.withColumn("features", F.array(F.col("node") * 3 % 10, F.col("node") % 4 + 10)), links(s, d), mapping)


@query(f"""WITH {_MERGE}, f AS (SELECT DISTINCT node, unnest([n * 3 % 10, n % 4 + 10]) AS f FROM m), g AS (SELECT node, string_agg(CAST(f AS VARCHAR), ',' ORDER BY f) AS features FROM f GROUP BY node),
    e AS (SELECT src, dst FROM moved UNION SELECT dst, src FROM moved), a AS (SELECT src AS node, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS neighbours FROM e GROUP BY src)
    SELECT node, features, neighbours FROM g LEFT JOIN a USING (node)""")
def node_merge(s, d):
    nodes, edges, _ = _merged(s, d)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    near = graph.adjacency(edges).select(F.col("src").alias("node"), joined("neighbours").alias("neighbours"))
    return nodes.select("node", joined("features").alias("features")).join(near, "node", "left")


@query(f"WITH {_MERGE} SELECT src, dst, length, count(*) AS n FROM moved GROUP BY ALL")
def node_merge_paths(s, d):
    """Paths between the new labels: those inside a merged node go."""
    return _merged(s, d)[2].groupBy("src", "dst", "length").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {_PATHS}, v AS (SELECT c_custkey // 50 AS claim_id, c_custkey AS seq, CAST(c_nationkey AS BIGINT) AS node FROM customer),
    q AS (SELECT *, lead(node) OVER (PARTITION BY claim_id ORDER BY seq) AS nx FROM v), k AS (SELECT q.*, sp.path FROM q LEFT JOIN sp ON sp.src = q.node AND sp.dst = q.nx),
    f AS (SELECT *, coalesce(max(CASE WHEN nx IS NOT NULL AND path IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY claim_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS broken FROM k)
    SELECT claim_id, array_to_string(flatten(list(CASE WHEN path IS NULL THEN [CAST(node AS VARCHAR)] ELSE list_transform(path[1:len(path) - 1], lambda x: CAST(x AS VARCHAR)) END ORDER BY seq)), '>') AS node_path FROM f WHERE broken = 0 GROUP BY claim_id""")
def expand_path(s, d):
    v = table(s, d, "customer").select(F.expr("c_custkey div 50").alias("claim_id"), F.col("c_custkey").alias("seq"), F.col("c_nationkey").cast("bigint").alias("node"))
    out = graph.expanded_path(v, graph.shortest_paths(links(s, d)), ["claim_id"])
    return out.select("claim_id", F.array_join(F.transform("node_path", lambda x: x.cast("string")), ">").alias("node_path"))


@query("SELECT n_nationkey AS node, n_nationkey + 100 AS label, lag(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS previous, lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS following FROM nation")
def chain_edges(s, d):
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    return table(s, d, "nation").select(F.col("n_nationkey").alias("node"), (F.col("n_nationkey") + 100).alias("label"), F.lag("n_nationkey").over(w).alias("previous"), F.lead("n_nationkey").over(w).alias("following"))


@query(f"WITH {LINKS} SELECT row_number() OVER (ORDER BY src, dst, length) + 500 AS path_id, src, dst, length FROM links")
def path_table(s, d):
    return frames.numbered(links(s, d), ["src", "dst", "length"], "place").select((F.col("place") + 501).cast("bigint").alias("path_id"), "src", "dst", "length")


@query("SELECT c.c_custkey AS claim_id, CAST(c.c_nationkey AS BIGINT) AS node, r.r_name AS region FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey AND n.n_nationkey % 4 <> 0 LEFT JOIN region r ON r.r_regionkey = n.n_regionkey")
def claim_node_lookup(s, d):
    nodes = table(s, d, "nation").where("n_nationkey % 4 <> 0").join(F.broadcast(table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "r_name")
    c = table(s, d, "customer").join(F.broadcast(nodes), "c_nationkey", "left")
    return c.select(F.col("c_custkey").alias("claim_id"), F.col("c_nationkey").cast("bigint").alias("node"), F.col("r_name").alias("region"))


@query(f"""WITH RECURSIVE {_LENGTHS}, v AS (SELECT c_custkey // 50 AS claim_id, CAST(c_nationkey AS BIGINT) AS node, lead(CAST(c_nationkey AS BIGINT)) OVER (PARTITION BY c_custkey // 50 ORDER BY c_custkey) AS nx FROM customer),
    t AS (SELECT claim_id, sum(sp.length) AS topo, count(*) * 6.0 AS pdr, count(sp.length) = count(*) AS whole FROM v LEFT JOIN sp ON sp.src = v.node AND sp.dst = v.nx WHERE nx IS NOT NULL GROUP BY claim_id)
    SELECT claim_id, CASE WHEN whole THEN round(least(greatest(1 - abs(pdr - topo) / greatest(abs(pdr), abs(topo), 1e-9), 0), 1), 6) ELSE 0.0 END AS s_length FROM t""")
def length_score(s, d):
    """Walked against topological length; a claim with a leg between states that are not connected scores 0, as rows that fail do."""
    w = Window.partitionBy("claim_id").orderBy("c_custkey")
    v = table(s, d, "customer").select(F.expr("c_custkey div 50").alias("claim_id"), "c_custkey", F.col("c_nationkey").cast("bigint").alias("src"))
    legs = v.withColumn("dst", F.lead("src").over(w)).where("dst is not null").select("claim_id", "src", "dst", F.lit(6.0).alias("walked"))
    return scores.length_scores(legs, links(s, d), "claim_id", strict=False).select("claim_id", F.round("s_length", 6).alias("s_length"))


@query(f"""WITH RECURSIVE {LINKS}, {_HOPS}, {REGIONS}, {CANDIDATE_LCS}, l AS (SELECT claim_id, claimed, detected, CAST(line[-1] AS DOUBLE) / greatest(len(claimed), len(detected)) AS lcs FROM r WHERE i = len(claimed))
    SELECT claim_id, round(CASE WHEN distance IS NULL THEN 0.0 ELSE .5 * lcs + .5 * CAST(len(list_distinct(list_intersect(claimed, detected))) AS DOUBLE) / len(list_distinct(list_concat(claimed, detected))) END, 6) AS s_topo
    FROM l LEFT JOIN hops ON src = claim_id % 25 AND dst = claim_id % 27""")
def topology_score(s, d):
    """Longest common part with the detected rows of the grid and shared regions, where the states are connected."""
    row = lambda x: F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.concat(F.substring(x, 1, 1), i.cast("string")))
    r = regions(s, d).withColumn("sets", F.transform("detected", row)).withColumn("src", F.col("claim_id") % 25).withColumn("dst", F.col("claim_id") % 27)
    told = r.join(graph.hops(links(s, d), r.select("src")), ["src", "dst"], "left")
    score = scores.topology(C.lcs_candidates("claimed", "sets"), C.jaccard("claimed", "detected"), F.col("distance").isNotNull())
    return told.select("claim_id", F.round(score, 6).alias("s_topo"))


@query("""WITH a AS (SELECT r_regionkey AS id, n_nationkey AS k FROM region JOIN nation ON n_regionkey = r_regionkey) SELECT id, CAST(sum(k) AS BIGINT) AS total, count(*) AS n FROM a GROUP BY id""")
def column_concat_by_id(s, d):
    """Columns of aligned tables side by side: always by an explicit id."""
    n = table(s, d, "nation").groupBy(F.col("n_regionkey").alias("id")).agg(F.sum("n_nationkey").cast("bigint").alias("total"), F.count("*").alias("n"))
    return table(s, d, "region").select(F.col("r_regionkey").alias("id")).join(n, "id")


@query("SELECT label, count(*) AS n, round(avg(sx), 5) AS mean_first FROM (SELECT label, CAST(embedding[1] AS DOUBLE) AS sx FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT label, CAST(embedding[1] AS DOUBLE) FROM embeddings WHERE vec_id % 2 = 1) GROUP BY label")
def concat_checked(s, d):
    e = table(s, d, "embeddings").select("label", "vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"))
    both = e.where("vec_id % 2 = 0").unionByName(e.where("vec_id % 2 = 1"))
    return both.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("x"), 5).alias("mean_first"))


@query("""WITH s AS (SELECT o_totalprice AS v, o_orderpriority AS g FROM orders), m AS (SELECT min(v) AS lo, max(v) AS hi FROM s), z AS (SELECT g, (v - lo) / (hi - lo) AS x FROM s, m),
    b AS (SELECT g, greatest(avg(x) - 1.5 * stddev_pop(x), 0) AS cut FROM z GROUP BY g) SELECT g AS label, count(*) AS candidates, round(any_value(cut), 6) AS threshold FROM z JOIN b USING (g) WHERE x < cut GROUP BY g""")
def merge_candidates(s, d):
    """Distances between their least and largest, and of each group those below its mean less k deviations, floor 0."""
    o = table(s, d, "orders").select(F.col("o_orderpriority").alias("label"), F.col("o_totalprice").alias("v"))
    ends = o.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    z = o.crossJoin(F.broadcast(ends)).select("label", ((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("x"))
    cut = z.groupBy("label").agg(F.greatest(F.avg("x") - 1.5 * F.stddev_pop("x"), F.lit(0.0)).alias("cut"))
    return z.join(F.broadcast(cut), "label").where("x < cut").groupBy("label").agg(F.count("*").alias("candidates"), F.round(F.first("cut"), 6).alias("threshold"))


@query(f"""WITH {TRACE}, h AS (SELECT trace_id, row_idx, radians(fmod(value * 7.0, 360.0)) AS a FROM trace),
    pts AS (SELECT trace_id, row_idx, sum(cos(a)) OVER w AS x, sum(sin(a)) OVER w AS y FROM h WINDOW w AS (PARTITION BY trace_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    e AS (SELECT trace_id, max(x) FILTER (row_idx = 0) AS xa, max(y) FILTER (row_idx = 0) AS ya, max(x) FILTER (row_idx = 10) AS xb, max(y) FILTER (row_idx = 10) AS yb FROM pts GROUP BY trace_id),
    t AS (SELECT xa AS txa, ya AS tya, xb AS txb, yb AS tyb FROM e WHERE trace_id = 0), r AS (SELECT e.*, t.*, coalesce(atan2(tyb - tya, txb - txa) - atan2(yb - ya, xb - xa), 0) AS turn FROM e, t)
    SELECT trace_id, row_idx, round(txa + (x - xa) * cos(turn) - (y - ya) * sin(turn), 5) AS u, round(tya + (x - xa) * sin(turn) + (y - ya) * cos(turn), 5) AS v FROM pts JOIN r USING (trace_id)""")
def align_paths(s, d):
    """All paths moved to the start of the first and turned to its first steps."""
    t = trace(s, d).withColumn("heading", F.expr("(value * 7.0D) % 360.0D")).withColumn("length", F.lit(1.0))
    p = frames.cumulative_path(t, "length", "heading").select("trace_id", "row_idx", "x", "y")
    return frames.aligned(p, 0).select("trace_id", "row_idx", F.round("u", 5).alias("u"), F.round("v", 5).alias("v"))


@query(f"""WITH {REGIONS}, lib AS (SELECT claim_id % 30 AS ref, array_to_string(claimed, ',') AS trace FROM regions) SELECT ref, trace, count(*) AS n FROM lib GROUP BY ALL""")
def reference_library(s, d):
    return regions(s, d).groupBy((F.col("claim_id") % 30).alias("ref"), F.array_join("claimed", ",").alias("trace")).agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY md5('proxy|' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS r FROM orders), h AS (SELECT *, sha256('p-' || CAST(o_orderkey AS VARCHAR)) AS h FROM a WHERE r <= 34)
    SELECT o_orderkey, round((o_custkey % 100) / 100.0 + (CAST(('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2)) AS BIGINT) / 4294967296.0 - 0.5) * 2 * 0.035, 8) AS movement, true AS is_synthetic FROM h""")
def proxy_noise(s, d):
    """At most 34 attack rows with keyed noise; the number is the feature."""
    o = table(s, d, "orders").orderBy(F.md5(F.concat(F.lit("proxy|"), F.col("o_orderkey").cast("string"))), "o_orderkey").limit(34)
    return o.select("o_orderkey", F.round((F.col("o_custkey") % 100) / 100.0 + C.stable_noise(F.concat(F.lit("p-"), F.col("o_orderkey").cast("string"))), 8).alias("movement"), F.lit(True).alias("is_synthetic"))


# -- distances ----------------------------------------------------------------


def _vectors(s, d):
    return table(s, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


_D = "CAST(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS DOUBLE)"
_NEAR = f"WITH p AS (SELECT a.vec_id, b.label, b.vec_id AS other, {_D} AS dist FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)"


@query(f"{_NEAR}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id, label ORDER BY dist) AS r FROM p), m AS (SELECT vec_id, label, avg(dist) AS m FROM r WHERE r <= 3 GROUP BY ALL) SELECT vec_id, arg_min(label, (m, label)) AS label, round(min(m), 5) AS mean_distance FROM m GROUP BY vec_id")
def euclid_topk(s, d):
    """The label whose three nearest templates are nearest on average, of all templates."""
    near = distances.met(_vectors(s, d), "vec_id", "label", ["v"], {"dist": distances.euclidean("v")}, nearest=3, stats=[])
    best = near.groupBy("key").agg(F.min(F.struct(distances.near_mean().alias("m"), "other_label")).alias("b"))
    return best.select(F.col("key").alias("vec_id"), F.col("b.other_label").alias("label"), F.round("b.m", 5).alias("mean_distance"))


@query(f"{_NEAR} SELECT vec_id, label, round(avg(1 / (1 + dist / 8)), 6) AS similarity FROM p GROUP BY ALL")
def template_similarity(s, d):
    found = distances.met(_vectors(s, d), "vec_id", "label", ["v"], {"like": distances.likeness(distances.euclidean("v"), 8.0)}, stats=["total"])
    return found.select(F.col("key").alias("vec_id"), F.col("other_label").alias("label"), F.round(F.col("like_total") / F.col("n"), 6).alias("similarity"))


def _with_scales(rows, measures, low: bool):
    """Rows with the largest (and least) of each measure over all others, whatever their label: {measure}_high (and _low)."""
    ends = distances.met(rows, "vec_id", "label", ["meg", "lte"], measures, stats=["least", "most"] if low else ["most"])
    parts = [f(f"{m}_{x}").alias(f"{m}_{name}") for m in measures for name, x, f in (("high", "most", F.max), *((("low", "least", F.min),) if low else ()))]
    return stored(rows.join(ends.groupBy(F.col("key").alias("vec_id")).agg(*parts), "vec_id"), "scales")


def _fused_columns(meg, lte):
    """Two distances fused, each over the largest of its column, as the whole matrix is scaled (its diagonal is 0)."""
    return distances.fused(distances.scaled(meg, None, "meg_high", True), distances.scaled(lte, None, "lte_high", True))


_PART = lambda a, b: f"CAST(list_distance(CAST(a.embedding[{a}:{b}] AS DOUBLE[]), CAST(b.embedding[{a}:{b}] AS DOUBLE[])) AS DOUBLE)"


@query(f"""WITH p AS (SELECT a.vec_id AS i, b.vec_id AS j, {_PART(1, 32)} AS meg, {_PART(33, 64)} AS lte FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), top AS (SELECT j, max(meg) AS x, max(lte) AS y FROM p GROUP BY j),
    f AS (SELECT i, j, sqrt(pow(.3 * meg / x, 2) + pow(.7 * lte / y, 2)) AS fused FROM p JOIN top USING (j)) SELECT i AS vec_id, count(*) AS n, arg_min(j, (round(fused, 9), j)) AS nearest, round(min(fused), 5) AS least, round(avg(fused), 5) AS mean FROM f GROUP BY i""")
def fused_distance(s, d):
    """Rows of the fused matrix of all vectors: two distances, each scaled by column, weighed .3 and .7."""
    meg, lte = distances.euclidean("meg"), distances.euclidean("lte")
    rows = _vectors(s, d).select("vec_id", F.lit(0).alias("label"), F.slice("v", 1, 32).alias("meg"), F.slice("v", 33, 32).alias("lte"))
    rows = _with_scales(rows, {"meg": meg, "lte": lte}, False)
    found = distances.met(rows, "vec_id", "label", ["meg", "lte", "meg_high", "lte_high"], {"fused": _fused_columns(meg, lte)}, nearest=1, symmetric=False, stats=["total", "least"])
    return found.select(F.col("key").alias("vec_id"), "n", F.col("near")[0]["other"].alias("nearest"), F.round("fused_least", 5).alias("least"), F.round(F.col("fused_total") / F.col("n"), 5).alias("mean"))


_HALF = f"WITH p AS (SELECT a.label, a.vec_id AS i, b.vec_id AS j, {_D} AS dist FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)"


def _within(s, d, part=None):
    v = _vectors(s, d)
    return distances.met(v if part is None else v.withColumn("v", part), "vec_id", "label", ["v"], {"dist": distances.euclidean("v")}, by="label")


@query(f"{_HALF} SELECT label, i AS vec_id, round(avg(dist), 5) AS mean_distance FROM p GROUP BY ALL")
def pairwise_distances(s, d):
    return _within(s, d).select("label", F.col("key").alias("vec_id"), F.round(F.col("dist_total") / F.col("n"), 5).alias("mean_distance"))


@query(f"{_HALF}, m AS (SELECT label, i, min(dist) AS m FROM p GROUP BY ALL), q AS (SELECT label, quantile_cont(m, 0.75) AS q FROM m GROUP BY label) SELECT label, i AS vec_id FROM m JOIN q USING (label) WHERE m <= q")
def pseudo_anchor_prune(s, d):
    """Keeps what has a near neighbour: least distance up to the third quartile."""
    least = stored(_within(s, d).select("label", F.col("key").alias("vec_id"), F.col("dist_least").alias("least")), "least-distances")
    q = least.groupBy("label").agg(F.percentile("least", 0.75).alias("q"))
    return least.join(q, "label").where("least <= q").select("label", "vec_id")


@query(f"{_HALF}, t AS (SELECT label, i, sum(dist) AS t FROM p GROUP BY ALL) SELECT label, arg_min(i, (t, i)) AS medoid, round(min(t), 4) AS total_distance FROM t GROUP BY label")
def medoid(s, d):
    return distances.medoids(_within(s, d)).select("label", "medoid", F.round("total_distance", 4).alias("total_distance"))


_ACROSS = f"""WITH p AS (SELECT a.vec_id AS i, a.label AS li, b.label AS lj, {_D} AS dist FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), m AS (SELECT i, li, lj, avg(dist) AS m FROM p WHERE NOISE GROUP BY ALL),
    o AS (SELECT i, min(m) FILTER (li = lj) AS a, min(m) FILTER (li <> lj) AS b FROM m GROUP BY i) SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette, count(*) AS n FROM o"""


def _across(s, d):
    return distances.met(_vectors(s, d), "vec_id", "label", ["v"], {"dist": distances.euclidean("v")}, stats=["total"])


@query(_ACROSS.replace("NOISE", "true"))
def silhouette(s, d):
    return distances.silhouette(_across(s, d)).select(F.round("silhouette", 6).alias("silhouette"), "n")


@query(_ACROSS.replace("NOISE", "CAST(li AS VARCHAR) <> '0' AND CAST(lj AS VARCHAR) <> '0'"))
def silhouette_without_noise(s, d):
    """One label is noise and takes no part."""
    return distances.silhouette(_across(s, d), 0).select(F.round("silhouette", 6).alias("silhouette"), "n")


@query(f"SELECT a.label AS left_label, b.label AS right_label, round(avg({_D}), 5) AS distance FROM embeddings a JOIN embeddings b ON a.label < b.label GROUP BY ALL")
def set_distance(s, d):
    pairs = _across(s, d).where("label < other_label").groupBy(F.col("label").alias("left_label"), F.col("other_label").alias("right_label"))
    return pairs.agg(F.round(F.sum("dist_total") / F.sum("n"), 5).alias("distance"))


@query("SELECT o_orderpriority AS attack, 's' || CAST(o_orderkey % 3 AS VARCHAR) AS kind, count(*) AS n, round(avg(o_totalprice), 4) AS mean_score FROM orders WHERE o_totalprice IS NOT NULL GROUP BY ALL")
def score_loader(s, d):
    o = table(s, d, "orders").dropna(subset=["o_totalprice"]).withColumn("attack", F.col("o_orderpriority")).withColumn("kind", F.concat(F.lit("s"), (F.col("o_orderkey") % 3).cast("string")))
    return o.groupBy("attack", "kind").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_score"))


@query(f"WITH {_TABLES} SELECT sample_key, round(s_topo, 6) AS s_topo, round(s_signal, 6) AS s_signal FROM j WHERE NOT missing_s_topo")
def ablation_joins(s, d):
    return _fused(s, d).where("not missing_s_topo").select("sample_key", F.round("s_topo", 6).alias("s_topo"), F.round("s_signal", 6).alias("s_signal"))


@query(f"WITH RECURSIVE {REGIONS}, asked AS (SELECT claim_id, claimed FROM regions), {_LCS_LIB} SELECT claim_id, reference_id, round(likeness, 6) AS likeness FROM best")
def fuzzy_trace_key(s, d):
    """All claims against the library of routes."""
    asked = regions(s, d).select("claim_id", "claimed")
    return joins.closest_key(asked, _library(s, d), "claim_id", "claimed", "ref").select("claim_id", "reference_id", F.round("likeness", 6).alias("likeness"))


# -- kernels and models (no SQL; tested against brute force) ---------------------


def _reduced(s, d):
    """Vectors in their first 20 principal components, which whole vectors go into."""
    v = _vectors(s, d)
    return stored(principal_components(v, "vec_id", "v", 20).join(v.select("vec_id", "label"), "vec_id").withColumnRenamed("components", "v"), "reduced")


@query(None)
def dtw_pairs(s, d):
    """Rows of the warped distance matrix of each label: all its vectors against each other, by both costs."""
    both = {"dtw": distances.warped("v"), "squared": distances.warped("v", True)}
    found = distances.met(_reduced(s, d), "vec_id", "label", ["v"], both, by="label", nearest=1)
    mean = lambda m: F.round(F.col(f"{m}_total") / F.col("n"), 6)
    return found.select("label", F.col("key").alias("vec_id"), "n", mean("dtw").alias("mean_dtw"), F.round("dtw_least", 6).alias("least_dtw"), F.col("near")[0]["other"].alias("nearest"), mean("squared").alias("mean_squared"), F.round("squared_least", 6).alias("least_squared"), F.round("squared_most", 6).alias("most_squared"))


@query(None)
def dtw_neighbours(s, d):
    """The three nearest of each vector in its label by warped distance, found with lower bounds."""
    near = distances.warped_neighbours(_reduced(s, d), "vec_id", "v", "label", 3)
    flat = near.select("label", F.col("key").alias("vec_id"), F.posexplode("near").alias("rank", "x"))
    return flat.select("label", "vec_id", (F.col("rank") + 1).alias("rank"), F.col("x.other").alias("other"), F.col("x.distance").alias("distance"))


@query(None)
def fast_warping(s, d):
    """Each trace against the one after it, warped from coarse to fine."""
    lists = trace(s, d).groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "value"))), lambda x: x["value"]).alias("v"))
    lists = stored(lists, "trace-lists")
    both = lists.join(lists.select((F.col("trace_id") - 1).alias("trace_id"), F.col("v").alias("w")), "trace_id")

    @F.pandas_udf("double")
    def fast(v: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([K.fast_warped(a, b, 2) for a, b in zip(v, w, strict=True)])

    return both.select("trace_id", (F.col("trace_id") + 1).alias("other_id"), fast("v", "w").alias("distance"))


@query(None)
def dtw_global_match(s, d):
    """The label whose three nearest templates are nearest on average: all templates, warped and straight distances scaled by row and fused."""
    warped, straight = distances.warped("meg"), distances.euclidean("lte")
    rows = _reduced(s, d).select("vec_id", "label", F.col("v").alias("meg"), F.col("v").alias("lte"))
    rows = _with_scales(rows, {"meg": warped, "lte": straight}, True)
    near = distances.met(rows, "vec_id", "label", ["meg", "lte", "meg_low", "meg_high", "lte_low", "lte_high"], {"fused": distances.fused_by_row("meg", "lte")}, nearest=3, symmetric=False, stats=[])
    best = near.groupBy("key").agg(F.min(F.struct(distances.near_mean().alias("m"), "other_label")).alias("b"))
    return best.select(F.col("key").alias("vec_id"), F.col("b.other_label").alias("label"), F.col("b.m").alias("mean_distance"))


# Peaks: runs of equal values between lower ones; then one after another by rank, as a list that grows.
_TOPS = f"""{TRACE}, n AS (SELECT *, CASE WHEN lag(value) OVER w IS DISTINCT FROM value THEN 1 ELSE 0 END AS new FROM trace WINDOW w AS (PARTITION BY trace_id ORDER BY row_idx)),
    u AS (SELECT *, sum(new) OVER (PARTITION BY trace_id ORDER BY row_idx) AS run FROM n), g AS (SELECT trace_id, run, min(row_idx) AS a, max(row_idx) AS e, any_value(value) AS height FROM u GROUP BY ALL),
    o AS (SELECT *, lag(height) OVER w AS l, lead(height) OVER w AS r FROM g WINDOW w AS (PARTITION BY trace_id ORDER BY run)), tops AS (SELECT trace_id, (a + e) // 2 AS row_idx, height FROM o WHERE l < height AND r < height)"""


def _spaced_sql(name: str, rows: str, order: str, distance: int) -> str:
    """Of ``rows`` (a query) the ones that stay, as {name}_kept (trace_id, row_idx)."""
    return f"""{name} AS ({rows}), {name}_n AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY {order}) AS nth FROM {name}),
    {name}_k(trace_id, nth, kept) AS (SELECT DISTINCT trace_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM {name} UNION ALL
        SELECT k.trace_id, k.nth + 1, CASE WHEN len(list_filter(kept, lambda x: abs(x - row_idx) < {distance})) = 0 THEN list_append(kept, row_idx) ELSE kept END FROM {name}_k k JOIN {name}_n c ON c.trace_id = k.trace_id AND c.nth = k.nth + 1),
    {name}_kept AS (SELECT trace_id, unnest(arg_max(kept, nth)) AS row_idx FROM {name}_k GROUP BY trace_id)"""


@query(f"""WITH RECURSIVE {_TOPS}, {_spaced_sql("p", "SELECT * FROM tops", "height DESC, row_idx DESC", 5)} SELECT trace_id, row_idx, height FROM p_kept JOIN tops USING (trace_id, row_idx)""")
def find_peaks(s, d):
    return series.find_peaks(trace(s, d), "value", 5)


_SHOULDERS = "SELECT trace_id, row_idx, {0} AS v FROM (SELECT *, lag(value) OVER w AS l, lead(value) OVER w AS r FROM trace WINDOW w AS (PARTITION BY trace_id ORDER BY row_idx)) WHERE value {1} l AND value {1} r"


@query(f"""WITH RECURSIVE {TRACE}, {_spaced_sql("p", _SHOULDERS.format("value", ">="), "abs(v) DESC, row_idx", 5)}, {_spaced_sql("q", _SHOULDERS.format("-value", "<="), "abs(v) DESC, row_idx", 5)}
    SELECT trace_id, row_idx, 'peak' AS kind FROM p_kept UNION ALL SELECT trace_id, row_idx, 'valley' FROM q_kept""")
def local_peaks(s, d):
    t = trace(s, d)
    of = lambda kind: series.kept_peaks(t, "value", 5, valleys=kind == "valley").select("trace_id", "row_idx", F.lit(kind).alias("kind"))
    return of("peak").unionByName(of("valley"))


@query(f"""WITH RECURSIVE {_TOPS}, h AS (SELECT trace_id, avg(value) + stddev_pop(value) AS least FROM trace GROUP BY trace_id), {_spaced_sql("p", "SELECT tops.* FROM tops JOIN h USING (trace_id) WHERE height >= least", "height DESC, row_idx DESC", 4)},
    b AS (SELECT *, lag(value) OVER w AS l, lead(value) OVER w AS r FROM trace WINDOW w AS (PARTITION BY trace_id ORDER BY row_idx)),
    t AS (SELECT trace_id, list(struct_pack(row_idx := row_idx, v := value) ORDER BY row_idx) AS tops FROM b JOIN h USING (trace_id) WHERE value >= least AND value > l AND value >= r GROUP BY trace_id),
    k AS (SELECT trace_id, list_reduce(list_transform(tops, lambda x: [x]), lambda acc, x: CASE WHEN x[1].row_idx - acc[-1].row_idx < 4 THEN CASE WHEN x[1].v > acc[-1].v THEN list_append(acc[1:len(acc) - 1], x[1]) ELSE acc END ELSE list_append(acc, x[1]) END) AS kept FROM t)
    SELECT trace_id, row_idx, 'spaced' AS rule FROM p_kept UNION ALL SELECT trace_id, u.row_idx, 'greedy' FROM (SELECT trace_id, unnest(kept) AS u FROM k)""")
def step_peaks_scipy(s, d):
    """Peaks a deviation above the mean, the higher of near ones kept; beside them the greedy left-to-right form."""
    t = trace(s, d)
    spaced = series.find_peaks(t, "value", 4, F.avg("value") + F.stddev_pop("value"))
    least = t.withColumn("least", F.avg("value").over(frames.whole()) + F.stddev_pop("value").over(frames.whole()))
    greedy = intervals.greedy_peaks(least, "value", F.col("least"), 4)
    return spaced.select("trace_id", "row_idx", F.lit("spaced").alias("rule")).unionByName(greedy.select("trace_id", "row_idx", F.lit("greedy").alias("rule")))


@query(None)
def wavelet_denoise(s, d):
    return series.denoised(trace(s, d), "value", "value")


def _gaussian_sql(sigma: float, value: str, out: str) -> str:
    reach = int(4 * sigma + 0.5)
    return f"""WITH {TRACE}, s AS (SELECT trace_id, row_idx, {value} AS v, count(*) OVER (PARTITION BY trace_id) AS n FROM trace),
    w AS (SELECT k, exp(-0.5 * k * k / {sigma * sigma}) / sum(exp(-0.5 * k * k / {sigma * sigma})) OVER () AS w FROM (SELECT unnest(range(-{reach}, {reach + 1})) AS k)),
    q AS (SELECT trace_id, row_idx, w, n, (row_idx + k + 100 * n) % (2 * n) AS m FROM s, w)
    SELECT q.trace_id, q.row_idx, {out} FROM q JOIN s ON s.trace_id = q.trace_id AND s.row_idx = CASE WHEN m < q.n THEN m ELSE 2 * q.n - 1 - m END GROUP BY q.trace_id, q.row_idx"""


@query(_gaussian_sql(2.0, "value", "round(sum(w * v), 6) AS value"))
def gaussian_smooth(s, d):
    return frames.gaussian(trace(s, d), "value", "value", 2.0).select("trace_id", "row_idx", F.round("value", 6).alias("value"))


@query(None)
def meg_preprocess(s, d):
    """Filled, denoised, smoothed and standardised; the current segment weighs four times."""
    return series.magnetic(trace(s, d), "value", "meg").select("trace_id", "row_idx", F.col("meg").alias("value"), (4 * F.col("meg")).alias("current"))


@query(_gaussian_sql(1.5, "CASE WHEN event_id % 7 = 0 THEN value ELSE 0 END", "round(sum(w * v), 6) AS value, round(4 * sum(w * v), 6) AS current"))
def lte_preprocess(s, d):
    """Missing values are 0, then smoothed; the current segment weighs four times."""
    t = trace(s, d).withColumn("sparse", F.when(F.col("event_id") % 7 == 0, F.col("value")))
    return frames.gaussian(t, "sparse", "v", 1.5).select("trace_id", "row_idx", F.round("v", 6).alias("value"), F.round(4 * F.col("v"), 6).alias("current"))


@query(f"""WITH {TRACE}, c AS (SELECT *, avg(value) OVER (PARTITION BY trace_id ORDER BY row_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m5,
        avg(CASE WHEN event_id % 7 = 0 THEN value ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY row_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS lte FROM trace)
    SELECT trace_id, row_idx, round((m5 - avg(m5) OVER p) / CASE WHEN stddev_pop(m5) OVER p = 0 THEN 1 ELSE stddev_pop(m5) OVER p END, 6) AS meg, round(lte, 6) AS lte FROM c WINDOW p AS (PARTITION BY trace_id)""")
def detection_preprocess(s, d):
    """What detection prepares: the field smoothed over five rows and standardised, signals with 0 for missing smoothed over three."""
    t = trace(s, d).withColumn("sparse", F.when(F.col("event_id") % 7 == 0, F.col("value")).otherwise(0.0))
    t = frames.zscore(frames.centred_mean(frames.centred_mean(t, "value", "m5", 5), "sparse", "lte", 3), "m5", "meg")
    return t.select("trace_id", "row_idx", F.round("meg", 6).alias("meg"), F.round("lte", 6).alias("lte"))


def _polynomial_rows(window: int, order: int) -> str:
    """(place, j, weight): what row j of a window weighs in the polynomial's value at ``place``."""
    design = np.vander(np.arange(window) - window // 2, order + 1, increasing=True)
    weights = design @ np.linalg.pinv(design)
    return ", ".join(f"({i}, {j}, CAST({weights[i, j]!r} AS DOUBLE))".replace("np.float64(", "").replace(") AS", " AS") for i in range(window) for j in range(window))


@query(f"""WITH RECURSIVE {TRACE}, weights(place, j, w) AS (VALUES {_polynomial_rows(9, 2)}), n AS (SELECT trace_id, count(*) AS n FROM trace GROUP BY trace_id),
    p AS (SELECT trace_id, row_idx, value, n, CASE WHEN row_idx < 4 THEN row_idx WHEN row_idx >= n - 4 THEN row_idx - (n - 9) ELSE 4 END AS place FROM trace JOIN n USING (trace_id)),
    x AS (SELECT p.trace_id, p.row_idx, CASE WHEN any_value(n) < 9 THEN any_value(p.value) ELSE sum(w * t.value) END AS x FROM p JOIN weights USING (place) LEFT JOIN trace t ON t.trace_id = p.trace_id AND t.row_idx = p.row_idx - p.place + j GROUP BY ALL),
    d AS (SELECT trace_id, row_idx, coalesce(x - lag(x) OVER (PARTITION BY trace_id ORDER BY row_idx), 0) AS d FROM x),
    s AS (SELECT trace_id, row_idx, sum(fmod(fmod(d + 180, 360) + 360, 360) - 180) OVER (PARTITION BY trace_id ORDER BY row_idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS total FROM d),
    f AS (SELECT trace_id, row_idx, CAST(sign(total) AS INT) AS turn FROM s WHERE abs(total) > 30),
    k AS (SELECT trace_id, min(row_idx) AS row_idx FROM f GROUP BY trace_id UNION ALL SELECT trace_id, (SELECT min(f.row_idx) FROM f WHERE f.trace_id = k.trace_id AND f.row_idx >= k.row_idx + 8) FROM k WHERE k.row_idx IS NOT NULL)
    SELECT trace_id, row_idx, turn FROM k JOIN f USING (trace_id, row_idx)""")
def savgol_turns(s, d):
    """Smoothed headings, their summed turns, and the places where these pass a threshold, debounced."""
    x = series.polynomial_smooth(trace(s, d).select("trace_id", "row_idx", "value"), "value", "x", 9, 2)
    turn = C.wrap180(F.coalesce(F.col("x") - F.lag("x").over(frames.over()), F.lit(0.0)))
    total = frames.trailing_sum(x.withColumn("turned", turn), "turned", "total", 10)
    flags = stored(total.where("abs(total) > 30").select("trace_id", "row_idx", F.sign("total").cast("int").alias("turn")), "turn-flags")
    return series.debounced(flags, 8).join(flags, ["trace_id", "row_idx"])


@query(None)
def complete_linkage(s, d):
    return series.complete_linkage(trace(s, d).select("trace_id", "row_idx", "value"), "value", 10.0).select("trace_id", "row_idx", "cluster")


@query(None)
def pca_reduce(s, d):
    return principal_components(_vectors(s, d), "vec_id", "v", 20)


@query(None)
def neighbour_layout(s, d):
    """All vectors in the plane, near neighbours near each other."""
    return embedding.laid_out(_vectors(s, d), "vec_id", "v")


@query(None)
def pca_variants(s, d):
    """The numbers of components that are used: 2 to show, 20 to match, 30 to cluster."""
    v = _vectors(s, d)
    return reduce(lambda a, b: a.unionByName(b), [principal_components(v, "vec_id", "v", k).withColumn("k", F.lit(k)) for k in (2, 20, 30)])


@query(None)
def kmeans_states(s, d):
    """States by k-means on rows of the fused matrix (warped field, straight signals, scaled by column), the best of twenty starts."""
    v = _vectors(s, d)
    meg, lte = distances.warped("meg"), distances.euclidean("lte")
    rows = principal_components(v, "vec_id", "v", 20).withColumnRenamed("components", "meg").join(v.select("vec_id", F.lit(0).alias("label"), F.slice("v", 33, 32).alias("lte")), "vec_id")
    rows = _with_scales(stored(rows, "state-features"), {"meg": meg, "lte": lte}, False)
    matrix = distances.tiles(rows, "vec_id", ["meg", "lte", "meg_high", "lte_high"], _fused_columns(meg, lte))
    return distances.kmeans_rows(matrix, 10, 20).withColumnRenamed("key", "vec_id")


@query(None)
def heading_kmeans(s, d):
    """Headings of each path replaced by the centre of their cluster, path by path."""
    h = table(s, d, "events").select("event_id", F.col("user_id").alias("trace_id"), F.expr("(value * 7.0D) % 360.0D").alias("heading"))
    return states.grouped_kmeans(h, ["trace_id"], "heading", 8).select("event_id", "trace_id", "state", "centre")


@query(None)
def separate_components(s, d):
    """Mean distance of two labels' vectors, each label reduced by a fit of its own."""
    fitted = stored(states.grouped_components(_vectors(s, d), "vec_id", "label", "v", 20), "label-components")
    found = distances.met(fitted, "vec_id", "label", ["n", "components"], {"dist": states.first_places}, stats=["total"])
    pairs = found.where("label < other_label").groupBy(F.col("label").alias("left_label"), F.col("other_label").alias("right_label"))
    return pairs.agg(F.round(F.sum("dist_total") / F.sum("n"), 5).alias("distance"))


@query(None)
def composite_features(s, d):
    """States of all traces in one space: the field prepared and reduced, the signals before, in and after side by side."""
    t = trace(s, d).withColumn("rssi", -F.col("value")).withColumn("cell", (F.col("k") % 3).cast("double"))
    how = anchors.Detection(size=20, step=5, spacing=4, wobble_rows=5, peak_factor=0.0, valley_factor=0.0, rssi_deviation=40.0, id_rate=0.99, gap=6)
    found = stored(anchors.anchor_segments(t, "value", ["rssi"], ["cell"], how), "states")
    features = anchors.anchor_features(t, found, "value", 20, 12, 4, ["rssi", "cell"])
    return states.prepared(features, ["trace_id", "start_row"], "cur", ["rssi", "cell"])


@query(None)
def logreg_baseline(s, d):
    labels = table(s, d, "labels").select("doc_id", F.col("quality").alias("label"))
    docs = table(s, d, "documents").select("doc_id", F.log1p("n_chars").alias("a"), F.length(F.regexp_replace("text", "[^!]", "")).cast("double").alias("b"), F.when(F.col("doc_id") % 9 != 0, F.size(F.split("text", "\n")).cast("double")).alias("c"))
    out = logistic_scores(docs.join(labels, "doc_id"), ["a", "b", "c"], "label")
    return report.area_under_curve(out.withColumn("score", F.round("score", 6)), "label", "score")


_MEDOIDS = """WITH p AS (SELECT a.label, a.vec_id AS i, CAST(list_distance(CAST(a.embedding[A:B] AS DOUBLE[]), CAST(b.embedding[A:B] AS DOUBLE[])) AS DOUBLE) AS dist FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id),
    t AS (SELECT label, i, round(sum(dist), 6) AS t FROM p GROUP BY ALL) SELECT label, arg_min(i, (t, i)) AS medoid FROM t GROUP BY label"""


@query(f"""SELECT label, a.medoid AS meg_medoid, b.medoid AS lte_medoid FROM ({_MEDOIDS.replace("A:B", "1:32")}) a JOIN ({_MEDOIDS.replace("A:B", "33:64")}) b USING (label)""")
def medoid_table(s, d):
    """The medoid of each label by two halves of the vector, chosen independently."""
    half = lambda a: distances.medoids(_within(s, d, F.slice("v", a, 32)).withColumn("dist_total", F.round("dist_total", 6)))
    return half(1).select("label", F.col("medoid").alias("meg_medoid")).join(half(33).select("label", F.col("medoid").alias("lte_medoid")), "label")


def _standard(df, column: str, n: int):
    """Each of the first ``n`` places of an array column by its mean and deviation over all rows (deviation 0: 1)."""
    stats = df.agg(*[f(F.get(column, F.lit(i))).alias(f"{k}{i}") for i in range(n) for k, f in (("m", F.avg), ("d", F.stddev_pop))]).first()
    means, spreads = [stats[f"m{i}"] or 0.0 for i in range(n)], [stats[f"d{i}"] or 1.0 for i in range(n)]
    at = lambda values, i: F.element_at(F.array(*[F.lit(float(x)) for x in values]), i + 1)
    return df.withColumn(column, F.transform(column, lambda x, i: (x - at(means, i)) / at(spreads, i)))


@query(None)
def signal_scores(s, d):
    """Similarity of each vector to all templates of its label: 50 standardised components warped, standardised signal columns straight, both side by side warped."""
    v = _vectors(s, d)
    r = principal_components(v, "vec_id", "v", 50).withColumnRenamed("components", "meg").join(v.select("vec_id", "label", F.slice("v", 33, 32).alias("lte")), "vec_id")
    r = _standard(_standard(stored(r, "signal-features"), "meg", 50), "lte", 32).withColumn("joint", F.concat("meg", "lte"))
    # The table of the components' warping is a corner of that of both.
    mean = {("s_meg", "s_signal"): distances.warped_starts("joint", 50), "s_lte": distances.euclidean("lte", True)}
    found = distances.met(stored(r, "signal-joint"), "vec_id", "label", ["lte", "joint"], {m: distances.likeness(f) for m, f in mean.items()}, by="label", stats=["total"])
    return found.select(F.col("key").alias("vec_id"), "label", *[(F.col(f"{m}_total") / F.col("n")).alias(m) for m in ("s_meg", "s_lte", "s_signal")])


_TURNED = f"""{LINKS}, t AS (SELECT src, dst, length, row_number() OVER (ORDER BY src, dst, length) AS seq, CAST(src % 3 - 1 AS INT) AS turn FROM links WHERE src <> dst AND src % 6 <> 5),
    ways AS (SELECT src, dst, seq, 0 AS t1, length AS l1, turn AS t2, length / 2 AS l2 FROM t UNION ALL SELECT dst, src, seq, -turn, length / 2, 0, length FROM t),
    nodes AS (SELECT DISTINCT src AS node FROM ways),
    h(dst, distance) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT w.dst, distance + 1 FROM h JOIN ways w ON w.src = h.dst WHERE distance < 25), hops AS (SELECT dst, min(distance) AS distance FROM h GROUP BY dst),
    p(dst, came, x, y, a) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) UNION ALL
        SELECT w.dst, list_append(came, seq), x + l1 * cos(radians(a - 90 * t1)) + l2 * cos(radians(a - 90 * t1 - 90 * t2)), y + l1 * sin(radians(a - 90 * t1)) + l2 * sin(radians(a - 90 * t1 - 90 * t2)), a - 90 * t1 - 90 * t2
        FROM p JOIN ways w ON w.src = p.dst JOIN hops ON hops.dst = w.dst WHERE hops.distance = len(came) + 1),
    placed AS (SELECT dst, arg_min(x, came) AS x, arg_min(y, came) AS y FROM p GROUP BY dst)"""


@query(f"WITH RECURSIVE {_TURNED} SELECT node, round(coalesce(x, 9999.0), 5) + 0.0 AS x, round(coalesce(y, 9999.0), 5) + 0.0 AS y FROM nodes LEFT JOIN placed ON dst = node")
def path_layout(s, d):
    """Coordinates of nodes by the turns and lengths of the paths; what is not reached lies far off."""
    e = links(s, d).where("src <> dst and src % 6 <> 5")
    piece = lambda turn, length: F.struct(turn.cast("int").alias("turn"), length.alias("length"))
    numbered = frames.numbered(e, ["src", "dst", "length"], "seq").withColumn("seq", F.col("seq") + 1)
    turned = numbered.withColumn("turns", F.array(piece(F.lit(0), F.col("length")), piece(F.col("src") % 3 - 1, F.col("length") / 2)))
    return graph.layout(turned).select("node", (F.round("x", 5) + 0.0).alias("x"), (F.round("y", 5) + 0.0).alias("y"))
