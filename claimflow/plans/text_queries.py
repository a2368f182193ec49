"""Queries over parsed text: cells, paths, times, positions, regions, scalars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import claims, frames, intervals, joins, report
from ..sources import files
from .inputs import CLAIM_PATHS, REGIONS, SCANS, TRACE, query, regions, scans, table, trace
from .inputs import claim_paths as claim_rows


def _cells(s, d):
    return scans(s, d).withColumn("cells", C.scan_cells("types", "ids", "rssi"))


@query(f"WITH {SCANS} SELECT scan_id, pos - 1 AS pos, CAST(id AS BIGINT) AS id, CAST(rssi AS BIGINT) AS rssi FROM (SELECT scan_id, id, rssi, row_number() OVER (PARTITION BY scan_id ORDER BY pos) AS pos FROM cells WHERE id <= 10000)")
def parse_filter_cells(s, d):
    out = _cells(s, d).select("scan_id", F.posexplode(C.small_ids("cells")).alias("pos", "x"))
    return out.select("scan_id", F.col("pos").cast("bigint").alias("pos"), F.col("x.id").cast("bigint").alias("id"), F.col("x.rssi").cast("bigint").alias("rssi"))


@query(f"""WITH {SCANS}, c AS (SELECT scan_id % 5 AS route, CAST(id AS BIGINT) AS id, count(*) AS n FROM cells WHERE id <= 10000 GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY route ORDER BY n DESC, id) AS rank FROM c) WHERE rank <= 5""")
def channel_topk(s, d):
    one = _cells(s, d).select((F.col("scan_id") % 5).alias("route"), F.explode(C.small_ids("cells")).alias("x")).select("route", F.col("x.id").cast("bigint").alias("id"))
    return report.top_k(one, ["route"], "id", 5)


@query("SELECT l_orderkey AS scan_id FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_returnflag = 'A')")
def gsm_only_traces(s, d):
    """Scans that hold no LTE cell at all: they are reported, inputs are never deleted."""
    return scans(s, d).where(~F.exists(F.from_json("types", "array<string>"), lambda x: F.lower(x) == "lte")).select("scan_id")


_CLOCK = "printf('%02d:%02d:%02d:%03d', (event_id % 25), (event_id % 60), (user_id % 60), (event_id % 1000))"


def _clock(s, d):
    e = table(s, d, "events")
    return e.select("event_id", "user_id", F.format_string("%02d:%02d:%02d:%03d", F.col("event_id") % 25, F.col("event_id") % 60, F.col("user_id") % 60, F.col("event_id") % 1000).alias("time_text"))


@query("SELECT event_id, CASE WHEN event_id % 25 < 24 THEN ((event_id % 25 * 60 + event_id % 60) * 60 + user_id % 60) * 1000 + event_id % 1000 END AS ms FROM events")
def time_of_day_ms(s, d):
    return _clock(s, d).select("event_id", C.time_of_day_ms("time_text").alias("ms"))


@query(f"WITH {TRACE} SELECT trace_id, row_idx, round((ms - min(ms) OVER (PARTITION BY trace_id)) / 1000.0, 3) AS elapsed, (lambda_s // 3600) AS hours FROM (SELECT *, CAST(round((ms - min(ms) OVER (PARTITION BY trace_id)) / 1000.0) AS BIGINT) AS lambda_s FROM trace)")
def elapsed_from_min(s, d):
    t = trace(s, d).withColumn("e", (F.col("ms") - F.min("ms").over(Window.partitionBy("trace_id"))) / 1000.0)
    return t.select("trace_id", "row_idx", F.round("e", 3).alias("elapsed"), F.expr("cast(round(e) as bigint) div 3600").alias("hours"))


@query("SELECT event_id, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS elapsed_text, s AS seconds FROM (SELECT event_id, event_id * 7 % 20000 AS s FROM events)")
def metadata_seconds(s, d):
    t = table(s, d, "events").select("event_id", C.elapsed_text((F.col("event_id") * 7) % 20000).alias("elapsed_text"))
    return t.withColumn("seconds", C.elapsed_seconds("elapsed_text"))


@query("""WITH c AS (SELECT user_id, event_id, ((event_id % 24 * 60 + event_id % 60) * 60 + user_id % 60) * 1000 + event_id % 1000 AS ms FROM events WHERE event_id % 25 < 24)
    SELECT user_id AS trace_id, round(((arg_max(ms, event_id) - arg_min(ms, event_id)) % 86400000 + 86400000) % 86400000 / 1000.0, 3) AS duration FROM c GROUP BY user_id""")
def trace_duration(s, d):
    t = table(s, d, "events").where("event_id % 25 < 24").select("user_id", "event_id", C.time_of_day_ms(F.format_string("%02d:%02d:%02d:%03d", F.col("event_id") % 24, F.col("event_id") % 60, F.col("user_id") % 60, F.col("event_id") % 1000)).alias("ms"))
    ends = t.groupBy(F.col("user_id").alias("trace_id")).agg(F.min_by("ms", "event_id").alias("a"), F.max_by("ms", "event_id").alias("b"))
    return ends.select("trace_id", C.clock_duration("a", "b").alias("duration"))


@query("""WITH t AS (SELECT user_id, event_id, ((event_id % 24 * 60 + event_id % 60) * 60) * 1000 AS ms FROM events), e AS (SELECT *, min(ms) OVER (PARTITION BY user_id) AS first, max(ms) OVER (PARTITION BY user_id) AS last FROM t)
    SELECT event_id, 'night' AS asked FROM e WHERE ms >= 79200000 OR ms <= 10800000
    UNION ALL SELECT event_id, 'elapsed' FROM e WHERE CASE WHEN first > 7200000 OR last < 3600000 THEN ms - first BETWEEN 3600000 AND 7200000 ELSE ms BETWEEN 3600000 AND 7200000 END""")
def time_window_filter(s, d):
    """A window over midnight by the clock, and one that counts from a trace's start where the trace's clock does not meet it."""
    t = table(s, d, "events").select("user_id", "event_id", ((F.col("event_id") % 24 * 60 + F.col("event_id") % 60) * 60000).alias("ms"))
    night = t.where(C.between_clock(F.col("ms"), F.lit(22 * 3_600_000), F.lit(3 * 3_600_000))).select("event_id", F.lit("night").alias("asked"))
    elapsed = frames.in_time_window(t, "ms", 3_600_000, 7_200_000, ["user_id"]).select("event_id", F.lit("elapsed").alias("asked"))
    return night.unionByName(elapsed)


# -- paths --------------------------------------------------------------------

_PARTS = r"""p AS (SELECT claim_id, string_split(replace(claim_path, '\', '/'), '/') AS x FROM claim_paths),
    q AS (SELECT claim_id, x[-1] AS name, x[-2] AS folder, regexp_replace(regexp_replace(x[-1], '\.csv$', ''), '_merged$', '') AS bare FROM p)"""


@query(f"WITH {CLAIM_PATHS}, {_PARTS} SELECT claim_id, folder || '/' || bare || '_merged.csv' AS merged_path FROM q")
def path_normalize(s, d):
    return claim_rows(s, d).select("claim_id", C.merged_path("claim_path").alias("merged_path"))


@query(f"WITH {CLAIM_PATHS}, {_PARTS} SELECT claim_id, name AS file_name, folder, replace(name, 'sensor', 'signal') AS paired_name FROM q")
def claim_paths(s, d):
    p = claim_rows(s, d)
    return p.select("claim_id", C.file_name("claim_path").alias("file_name"), C.folder_name("claim_path").alias("folder"), C.paired_name(C.file_name("claim_path")).alias("paired_name"))


@query(f"WITH {CLAIM_PATHS}, {_PARTS} SELECT claim_id, folder || '/' || replace(regexp_replace(bare, '^sensor_claim_[0-9]+_', ''), 'sensor_', '') AS sample_key FROM q")
def sample_key(s, d):
    return claim_rows(s, d).select("claim_id", C.sample_key("claim_path").alias("sample_key"))


def _files(s, d):
    p = table(s, d, "pages").select(F.concat(F.lit("route_"), F.lpad((F.col("page_id") % 9).cast("string"), 3, "0")).alias("folder"), F.concat((F.col("page_id") % 50).cast("string"), F.lit("_merged.csv")).alias("name"), (F.col("page_id") % 3).alias("depth")).distinct()
    return p.withColumn("path", F.concat(F.repeat(F.lit("x/"), F.col("depth").cast("int")), "folder", F.lit("/"), "name")).drop("depth")


@query(f"""WITH {CLAIM_PATHS}, {_PARTS}, files AS (SELECT DISTINCT 'route_' || lpad(CAST(page_id % 9 AS VARCHAR), 3, '0') AS folder, CAST(page_id % 50 AS VARCHAR) || '_merged.csv' AS name, page_id % 3 AS depth FROM pages),
    f AS (SELECT folder, name, repeat('x/', depth) || folder || '/' || name AS path FROM files)
    SELECT q.claim_id, arg_min(f.path, (CASE WHEN f.folder = q.folder THEN 0 ELSE 1 END, length(f.path), f.path)) AS resolved_path FROM q LEFT JOIN f ON f.name = q.bare || '_merged.csv' GROUP BY q.claim_id""")
def resolve_file(s, d):
    return joins.resolved(claim_rows(s, d), _files(s, d)).select("claim_id", "resolved_path")


@query(f"""WITH {CLAIM_PATHS}, {_PARTS}, files AS (SELECT DISTINCT CAST(page_id % 50 AS VARCHAR) || '_merged.csv' AS name FROM pages WHERE page_id % 50 < 40)
    SELECT claim_id, bare FROM q WHERE NOT EXISTS (SELECT 1 FROM files WHERE files.name = q.bare || '_merged.csv')""")
def missing_pairs_anti(s, d):
    asked = claim_rows(s, d).withColumn("name", C.merged_name(C.file_name("claim_path"))).withColumn("bare", F.regexp_replace("name", r"_merged\.csv$", ""))
    there = table(s, d, "pages").where("page_id % 50 < 40").select(F.concat((F.col("page_id") % 50).cast("string"), F.lit("_merged.csv")).alias("name")).distinct()
    return joins.missing_partners(asked, there, ["name"]).select("claim_id", "bare")


@query(f"""WITH {CLAIM_PATHS}, {_PARTS}, c AS (SELECT claim_id, unnest([folder || '/' || name, folder || '/' || bare || '_merged.csv', name]) AS candidate, unnest([0, 1, 2]) AS rank FROM q)
    SELECT claim_id, candidate, CAST(rank AS INT) AS rank FROM c""")
def candidate_path_rank(s, d):
    p = claim_rows(s, d)
    options = F.array(F.concat_ws("/", C.folder_name("claim_path"), C.file_name("claim_path")), C.merged_path("claim_path"), C.file_name("claim_path"))
    return p.select("claim_id", F.posexplode(options).alias("rank", "candidate")).select("claim_id", "candidate", "rank")


@query(f"""WITH {CLAIM_PATHS}, {_PARTS}, files AS (SELECT DISTINCT 'data/route_' || lpad(CAST(page_id % 9 AS VARCHAR), 3, '0') || '/' || CAST(page_id % 50 AS VARCHAR) || CASE WHEN page_id % 2 = 0 THEN '_merged.csv' ELSE '.csv' END AS path FROM pages),
    c AS (SELECT claim_id, unnest(['data/' || folder || '/' || bare || '_merged.csv', 'data/' || folder || '/' || name, 'data/' || folder || '/' || bare || '.csv']) AS candidate, unnest([0, 1, 2]) AS rank FROM q)
    SELECT claim_id, arg_min(candidate, rank) FILTER (path IS NOT NULL) AS source FROM c LEFT JOIN files ON path = candidate GROUP BY claim_id""")
def first_candidate(s, d):
    """The first candidate path that exists; none: null."""
    p = claim_rows(s, d)
    bare = F.regexp_replace(C.merged_name(C.file_name("claim_path")), r"_merged\.csv$", "")
    there = lambda x: F.concat(F.lit("data/"), C.folder_name("claim_path"), F.lit("/"), x)
    page = F.col("page_id")
    known = table(s, d, "pages").select(F.concat(F.lit("data/route_"), F.lpad((page % 9).cast("string"), 3, "0"), F.lit("/"), (page % 50).cast("string"), F.when(page % 2 == 0, "_merged.csv").otherwise(".csv")).alias("path")).distinct()
    options = F.array(there(F.concat(bare, F.lit("_merged.csv"))), there(C.file_name("claim_path")), there(F.concat(bare, F.lit(".csv"))))
    return joins.first_existing(p.select("claim_id", options.alias("candidates")), known, "claim_id").select("claim_id", F.col("found").alias("source"))


@query("""WITH f AS (SELECT 'route_' || CAST(page_id % 7 AS VARCHAR) || '/' || repeat('x/', page_id % 3) || CAST(page_id % 40 AS VARCHAR) || CASE WHEN page_id % 2 = 0 THEN '_merged.csv' ELSE '.csv' END AS path, CAST(page_id % 40 AS VARCHAR) AS stem, page_id % 2 AS plain FROM pages)
    SELECT stem, arg_min(path, (plain, length(path), path)) AS path FROM f GROUP BY stem""")
def stem_index(s, d):
    """One file a stem: a merged one first, then the shortest path."""
    page = F.col("page_id")
    path = F.concat(F.lit("route_"), (page % 7).cast("string"), F.lit("/"), F.repeat(F.lit("x/"), (page % 3).cast("int")), (page % 40).cast("string"), F.when(page % 2 == 0, "_merged.csv").otherwise(".csv"))
    return joins.by_stem(table(s, d, "pages").select(path.alias("path"))).select("stem", "path")


@query("SELECT o_orderkey AS claim_id, coalesce(nullif(trim(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 1 THEN '  ' END), ''), o_orderstatus) AS submitted FROM orders")
def submitted_path(s, d):
    o = table(s, d, "orders").withColumn("attack_path", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).when(F.col("o_orderkey") % 3 == 1, "  "))
    return o.select(F.col("o_orderkey").alias("claim_id"), F.coalesce(F.nullif(F.trim("attack_path"), F.lit("")), "o_orderstatus").alias("submitted"))


@query("SELECT p_partkey AS part, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_partkey AS INT) END AS global_id FROM part")
def id_from_filename(s, d):
    name = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("other_"), "p_partkey")).otherwise(F.concat(F.lit("dir/anchor_feature_"), "p_partkey", F.lit(".csv")))
    return table(s, d, "part").select(F.col("p_partkey").alias("part"), C.feature_id(name).alias("global_id"))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'sensor' WHEN 1 THEN 'signal' END AS kind FROM supplier")
def file_catalog(s, d):
    name = F.element_at(F.array(F.lit("Sensor_1.csv"), F.lit("signal_2.csv"), F.lit("readme.md")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return table(s, d, "supplier").select("s_suppkey", C.file_kind(name).alias("kind"))


# -- positions and regions ----------------------------------------------------


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 700 AS INT) - 50 AS a, CAST(l_suppkey * 9 AS INT) AS b FROM lineitem),
    q AS (SELECT *, CASE WHEN a >= 0 AND b - a >= 200 THEN a END AS wide_start, CASE WHEN b > a THEN greatest(a, 0) END AS clip_start, CASE WHEN b > a THEN least(b, 600) END AS clip_end FROM p)
    SELECT l_orderkey, l_linenumber, wide_start, CASE WHEN clip_end > clip_start THEN clip_start END AS clip_start, CASE WHEN clip_end > clip_start THEN clip_end END AS clip_end FROM q""")
def parse_position(s, d):
    line = table(s, d, "lineitem")
    text = F.concat(F.lit("("), (F.col("l_partkey") % 700 - 50).cast("string"), F.lit(", "), (F.col("l_suppkey") * 9).cast("string"), F.lit(")"))
    clip = C.clipped(C.position(text), F.lit(600))
    return line.select("l_orderkey", "l_linenumber", C.position(text, 200)["start"].alias("wide_start"), clip["start"].alias("clip_start"), clip["end"].alias("clip_end"))


@query("""SELECT o_orderkey AS claim_id, array_to_string(list_sort(list_distinct([x FOR x IN [trim(y) FOR y IN regexp_split_to_array(t, '[,;，、\\s]+')] IF x <> ''])), '|') AS region_set,
    CAST(len([x FOR x IN [trim(y) FOR y IN string_split(t, ',')] IF x <> '']) AS INT) AS list_size
    FROM (SELECT o_orderkey, 'a' || CAST(o_custkey % 6 + 1 AS VARCHAR) || CASE o_orderkey % 3 WHEN 0 THEN ', ' WHEN 1 THEN '; ' ELSE '，' END || 'b' || CAST(o_orderkey % 6 + 1 AS VARCHAR) || ',a1,,' AS t FROM orders)""")
def region_set(s, d):
    sep = F.element_at(F.array(F.lit(", "), F.lit("; "), F.lit("，")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    text = F.concat(F.lit("a"), (F.col("o_custkey") % 6 + 1).cast("string"), sep, F.lit("b"), (F.col("o_orderkey") % 6 + 1).cast("string"), F.lit(",a1,,"))
    return table(s, d, "orders").select(F.col("o_orderkey").alias("claim_id"), F.array_join(F.array_sort(C.region_set(text)), "|").alias("region_set"), F.size(C.region_list(text)).alias("list_size"))


@query("SELECT c_custkey, array_to_string([x FOR x IN [trim(y) FOR y IN string_split(c_name || ', ' || c_mktsegment || ',,' || CAST(c_nationkey AS VARCHAR), ',')] IF x <> ''], '|') AS parts FROM customer")
def region_list(s, d):
    text = F.concat("c_name", F.lit(", "), "c_mktsegment", F.lit(",,"), F.col("c_nationkey").cast("string"))
    return table(s, d, "customer").select("c_custkey", F.array_join(C.region_list(text), "|").alias("parts"))


@query("SELECT c_custkey, CASE WHEN c_nationkey < 6 AND c_custkey % 7 < 6 THEN CAST(c_nationkey AS INT) END AS r, CASE WHEN c_nationkey < 6 AND c_custkey % 7 < 6 THEN CAST(c_custkey % 7 AS INT) END AS c FROM customer")
def grid_cell(s, d):
    region = F.concat(F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (F.col("c_nationkey") + 1).cast("int"), F.lit(1)), (F.col("c_custkey") % 7 + 1).cast("string"))
    return table(s, d, "customer").select("c_custkey", C.grid_cell(region)["r"].alias("r"), C.grid_cell(region)["c"].alias("c"))


@query(f"""WITH {REGIONS} SELECT claim_id, round(CASE WHEN len(list_distinct(list_concat(claimed, detected))) = 0 THEN 1.0
    ELSE CAST(len(list_distinct(list_intersect(claimed, detected))) AS DOUBLE) / len(list_distinct(list_concat(claimed, detected))) END, 6) AS jaccard FROM regions""")
def region_jaccard(s, d):
    return regions(s, d).select("claim_id", F.round(C.jaccard("claimed", "detected"), 6).alias("jaccard"))


_LCS = """r AS (
    SELECT claim_id, claimed, detected, 0 AS i, list_transform(range(0, len(detected) + 1), lambda j: 0) AS line FROM regions
    UNION ALL
    SELECT claim_id, claimed, detected, i + 1, list_reduce(list_transform(range(1, len(detected) + 1), lambda j: [CAST(j AS INT)]),
        lambda acc, j: list_append(acc, CASE WHEN SAME THEN line[j[1]] + 1 ELSE greatest(line[j[1] + 1], acc[-1]) END), [0])
    FROM r WHERE i < len(claimed))"""


@query(f"WITH RECURSIVE {REGIONS}, {_LCS.replace('SAME', 'claimed[i + 1] = detected[j[1]]')} SELECT claim_id, round(CASE WHEN greatest(len(claimed), len(detected)) = 0 THEN 1.0 ELSE CAST(line[-1] AS DOUBLE) / greatest(len(claimed), len(detected)) END, 6) AS lcs FROM r WHERE i = len(claimed)")
def lcs_score(s, d):
    return regions(s, d).select("claim_id", F.round(C.lcs_ratio("claimed", "detected"), 6).alias("lcs"))


#: Each detected place is the whole row of the grid.
CANDIDATE_LCS = _LCS.replace("SAME", "detected[j[1]] = claimed[i + 1] OR substr(detected[j[1]], 1, 1) = substr(claimed[i + 1], 1, 1)")


@query(f"WITH RECURSIVE {REGIONS}, {CANDIDATE_LCS} SELECT claim_id, round(CASE WHEN greatest(len(claimed), len(detected)) = 0 THEN 0.0 ELSE CAST(line[-1] AS DOUBLE) / greatest(len(claimed), len(detected)) END, 6) AS lcs FROM r WHERE i = len(claimed)")
def lcs_candidate_score(s, d):
    """Each detected place is the whole row of the grid."""
    row = lambda x: F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.concat(F.substring(x, 1, 1), i.cast("string")))
    return regions(s, d).withColumn("sets", F.transform("detected", row)).select("claim_id", F.round(C.lcs_candidates("claimed", "sets"), 6).alias("lcs"))


_GRID = """g AS (SELECT claim_id, list_transform(claimed, lambda x: [ascii(x) - 97, CAST(substr(x, 2, 1) AS INT) - 1]) AS v FROM regions),
    j AS (SELECT claim_id, list_transform(range(1, len(v)), lambda i: abs(v[i][1] - v[i + 1][1]) + abs(v[i][2] - v[i + 1][2])) AS jumps FROM g)"""


@query(f"WITH {REGIONS}, {_GRID} SELECT claim_id, round(1 - coalesce(list_avg(list_transform(jumps, lambda x: CASE WHEN x <= 1 THEN 0.0 WHEN x = 2 THEN 0.25 ELSE least(1.0, 0.25 + 0.25 * (x - 2)) END)), 0), 6) AS route_score FROM j")
def grid_route_score(s, d):
    return regions(s, d).select("claim_id", F.round(C.route_score(F.transform("claimed", C.grid_cell)), 6).alias("route_score"))


@query(f"WITH {REGIONS} SELECT array_to_string(claimed, ',') AS trace_key, count(*) AS n FROM regions GROUP BY ALL")
def array_group_key(s, d):
    parsed = regions(s, d).select(C.string_list(F.to_json("claimed")).alias("trace"))
    return parsed.groupBy("trace").agg(F.count("*").alias("n")).select(F.array_join("trace", ",").alias("trace_key"), "n")


@query(f"WITH {REGIONS} SELECT claim_id, CAST(len(claimed) AS INT) AS n, array_to_string(claimed, '|') AS joined FROM regions")
def json_roundtrip(s, d):
    back = regions(s, d).withColumn("text", F.to_json("claimed")).withColumn("back", C.string_list("text"))
    return back.select("claim_id", F.size("back").alias("n"), F.array_join("back", "|").alias("joined"))


@query("""SELECT n_nationkey AS node, array_to_string([x FOR x IN [CAST(n_nationkey + 1 AS VARCHAR), CASE WHEN n_nationkey % 2 = 0 THEN '7' END] IF x IS NOT NULL], ',') AS neighbours FROM nation""")
def int_neighbours(s, d):
    text = F.concat(F.lit("["), (F.col("n_nationkey") + 1).cast("string"), F.when(F.col("n_nationkey") % 2 == 0, ", 7]").otherwise(", null]"))
    return table(s, d, "nation").select(F.col("n_nationkey").alias("node"), F.array_join(F.transform(C.int_list(text), lambda x: x.cast("string")), ",").alias("neighbours"))


@query(f"""WITH {SCANS.replace("AND rssi <> 2147483647", "")}, x AS (SELECT scan_id, pos, CASE WHEN rssi = 2147483647 THEN 0 ELSE id END AS id FROM cells)
    SELECT scan_id, CAST(sum(id) AS BIGINT) AS id_sum, count(*) AS n FROM x GROUP BY scan_id""")
def null_rssi_zero_id(s, d):
    line = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "A", False).otherwise(True).alias("lte"), (F.col("l_partkey") * 20).cast("int").alias("i"), F.when(F.col("l_linenumber") == 5, F.lit(2147483647)).otherwise(-F.col("l_quantity").cast("int")).alias("r"))
    lists = line.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "lte", "i", "r"))).alias("x"))
    kept = F.filter(F.slice("x", F.lit(1), F.size("x") - F.when(F.col("l_orderkey") % 3 == 0, 1).otherwise(0)), lambda x: x["lte"])
    lists = lists.select("l_orderkey", F.explode(F.array(kept)).alias("x")).where(F.size("x") > 0)
    ids = C.zero_missing_ids(F.transform("x", lambda x: x["i"]), F.transform("x", lambda x: F.nullif(x["r"], F.lit(2147483647))))
    return lists.select(F.col("l_orderkey").alias("scan_id"), F.aggregate(ids, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("id_sum"), F.size("x").cast("bigint").alias("n"))


@query(f"""WITH {SCANS}, n AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY pos) AS nth FROM cells)
    SELECT 'list' AS form, scan_id, count(*) AS cells, round(avg(rssi), 6) AS mean_rssi FROM cells GROUP BY scan_id UNION ALL SELECT 'wide', scan_id, count(*), round(avg(rssi), 6) FROM n WHERE nth <= 3 GROUP BY scan_id""")
def wide_or_list_cells(s, d):
    """Scans as lists, and with a column for each of three cells: both come in long form, without padding."""
    lists = _cells(s, d).select("scan_id", F.transform("cells", lambda x: x["rssi"]).alias("Cell_RSSI"))
    both = lists.select("scan_id", "Cell_RSSI", *[F.get("Cell_RSSI", F.lit(i)).alias(f"Cell_RSSI_{i + 1}") for i in range(3)])
    # A scan's cells stay together, so that neither form is shuffled again.
    return files.long_cells(both, ["scan_id"], "form").groupBy("form", "scan_id").agg(F.count("*").alias("cells"), F.round(F.avg("rssi"), 6).alias("mean_rssi"))


# -- cleaning -----------------------------------------------------------------


@query(f"""WITH {TRACE}, t AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v FROM trace)
    SELECT trace_id, row_idx, round(coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value(v IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0), 6) AS v FROM t""")
def numeric_coerce_fill(s, d):
    t = trace(s, d).withColumn("text", F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("value").cast("string"))).withColumn("num", F.col("text").try_cast("double"))
    return frames.filled(t, "num", "f").select("trace_id", "row_idx", F.round(F.coalesce("f", F.lit(0.0)), 6).alias("v"))


@query("SELECT o_custkey, min(o_orderkey) AS first_order FROM orders GROUP BY o_custkey")
def ordered_dedup(s, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(s, d, "orders").withColumn("r", F.row_number().over(w)).where("r = 1").select("o_custkey", F.col("o_orderkey").alias("first_order"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 5 <> 0 AND o_orderstatus = 'F'")
def drop_null_keys(s, d):
    o = table(s, d, "orders").withColumn("k", F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")))
    return o.dropna(subset=["k"]).where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")


@query("""SELECT o.o_orderkey, coalesce(l.total, 0.0) AS score, l.total IS NULL AS failed FROM orders o
    LEFT JOIN (SELECT l_orderkey, round(sum(l_quantity), 6) AS total FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' GROUP BY l_orderkey) l ON o_orderkey = l_orderkey""")
def failure_policy(s, d):
    """Rows without features score 0 and are flagged, they never go."""
    feats = table(s, d, "lineitem").where("l_shipdate < timestamp_ntz'1996-01-01 00:00:00'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_quantity"), 6).alias("total"))
    o = table(s, d, "orders").join(feats, "o_orderkey", "left")
    return o.select("o_orderkey", F.coalesce("total", F.lit(0.0)).alias("score"), F.col("total").isNull().alias("failed"))


@query("SELECT 'orders' AS origin, o_orderkey AS id, o_totalprice AS amount, CAST(NULL AS VARCHAR) AS flag FROM orders UNION ALL SELECT 'lines', l_orderkey, NULL, l_returnflag FROM lineitem")
def union_missing_cols(s, d):
    a = table(s, d, "orders").select(F.lit("orders").alias("origin"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    b = table(s, d, "lineitem").select(F.lit("lines").alias("origin"), F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("flag"))
    return a.unionByName(b, allowMissingColumns=True)


@query("""SELECT 'union' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer WHERE c_nationkey < 15 UNION SELECT s_nationkey FROM supplier WHERE s_nationkey > 9)
    UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_nationkey FROM customer WHERE c_nationkey < 15 INTERSECT SELECT s_nationkey FROM supplier WHERE s_nationkey > 9)
    UNION ALL SELECT 'except', count(*) FROM (SELECT c_nationkey FROM customer WHERE c_nationkey < 15 EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey > 9)""")
def set_ops(s, d):
    a = table(s, d, "customer").where("c_nationkey < 15").select(F.col("c_nationkey").alias("k"))
    b = table(s, d, "supplier").where("s_nationkey > 9").select(F.col("s_nationkey").alias("k"))
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    return one("union", a.union(b).distinct()).unionByName(one("intersect", a.intersect(b))).unionByName(one("except", a.subtract(b)))


@query("SELECT p_partkey, row_number() OVER (ORDER BY CAST(p_partkey AS VARCHAR)) - 1 AS position FROM part")
def stable_order(s, d):
    """Names in text order (1, 10, 11, 2), numbered."""
    p = table(s, d, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("name"))
    return frames.numbered(p, ["name"]).select("p_partkey", "position")


@query("SELECT l_orderkey, arg_min(l_linenumber, (l_quantity, l_linenumber)) AS first_min, arg_max(l_linenumber, (l_quantity, -l_linenumber)) AS first_max FROM lineitem GROUP BY l_orderkey")
def first_wins_argmin(s, d):
    return table(s, d, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_linenumber", F.struct("l_quantity", "l_linenumber")).alias("first_min"), F.max_by("l_linenumber", F.struct(F.col("l_quantity"), (-F.col("l_linenumber")).alias("n"))).alias("first_max"))


@query("""SELECT event_id, round(least(greatest(value / 100, 0), 1), 6) AS clipped, round(sqrt(abs(value)), 6) AS root, round(ln(1 + abs(value)), 6) AS log1p, round(exp(-abs(value) / 100), 6) AS decay,
    round(degrees(atan2(sin(value), cos(value))), 5) AS direction, CAST(sign(value - 50) AS DOUBLE) AS side, round(1 / (1 + exp(-(value - 50) / 10)), 6) AS squashed FROM events""")
def math_scalars(s, d):
    v = F.col("value")
    return table(s, d, "events").select("event_id", F.round(C.unit(v / 100), 6).alias("clipped"), F.round(F.sqrt(F.abs(v)), 6).alias("root"), F.round(F.log1p(F.abs(v)), 6).alias("log1p"), F.round(F.exp(-F.abs(v) / 100), 6).alias("decay"), F.round(F.degrees(F.atan2(F.sin(v), F.cos(v))), 5).alias("direction"), F.signum(v - 50).alias("side"), F.round(C.sigmoid((v - 50) / 10), 6).alias("squashed"))


@query(r"""SELECT page_id, lower(trim(url)) AS low, CAST(len(string_split(url, '/')) AS INT) AS parts, string_split(url, '/')[-1] AS last_part, regexp_extract(url, '([0-9]+)', 1) AS digits,
    regexp_replace(url, '[^a-z]+', '-', 'g') AS slug, lpad(CAST(page_id AS VARCHAR), 6, '0') AS padded, regexp_matches(url, '^https?://') AS absolute FROM pages""")
def string_scalars(s, d):
    u = F.col("url")
    return table(s, d, "pages").select("page_id", F.lower(F.trim(u)).alias("low"), F.size(F.split(u, "/")).alias("parts"), F.element_at(F.split(u, "/"), -1).alias("last_part"), F.regexp_extract(u, "([0-9]+)", 1).alias("digits"), F.regexp_replace(u, "[^a-z]+", "-").alias("slug"), F.lpad(F.col("page_id").cast("string"), 6, "0").alias("padded"), u.rlike("^https?://").alias("absolute"))


@query(f"""WITH {REGIONS} SELECT claim_id, array_to_string(list_concat(claimed[1:2], detected[1:1]), ',') AS head, claimed[-1] AS last_region, CAST(len(list_distinct(claimed)) AS INT) AS different,
    array_to_string(list_sort(claimed), ',') AS ordered, array_to_string(list_reverse(claimed), ',') AS backwards FROM regions""")
def array_scalars(s, d):
    r = regions(s, d)
    return r.select("claim_id", F.array_join(F.concat(F.slice("claimed", 1, 2), F.slice("detected", 1, 1)), ",").alias("head"), F.element_at("claimed", -1).alias("last_region"), F.size(F.array_distinct("claimed")).alias("different"), F.array_join(F.array_sort("claimed"), ",").alias("ordered"), F.array_join(F.reverse("claimed"), ",").alias("backwards"))


@query(f"""WITH {SCANS}, last AS (SELECT scan_id, id % 100 AS k, arg_max(rssi, pos) AS rssi FROM cells GROUP BY ALL)
    SELECT scan_id, count(*) AS keys, CAST(coalesce(max(rssi) FILTER (k = 20), -110) AS INT) AS at20 FROM last GROUP BY scan_id""")
def map_scalars(s, d):
    """A map in which the last of equal keys wins, with a default for absent ones."""
    # An exploded list, unlike a filter on its size, is worked out once.
    cells = _cells(s, d).select("scan_id", F.explode(F.array("cells")).alias("cells")).where(F.size("cells") > 0)
    maps = cells.select("scan_id", C.last_wins(F.transform("cells", lambda x: x["id"] % 100), F.transform("cells", lambda x: x["rssi"])).alias("m"))
    return maps.select("scan_id", F.size("m").cast("bigint").alias("keys"), F.coalesce(F.try_element_at("m", F.lit(20)), F.lit(-110)).alias("at20"))


@query(f"""WITH {REGIONS} SELECT claim_id, array_to_string(list_reverse(list_transform(claimed, lambda x, i: CAST(-(CAST(substr(x, 2, 1) AS INT) - 3) AS VARCHAR) || ':' || CAST(i AS VARCHAR))), ',') AS back FROM regions""")
def reverse_path(s, d):
    parts = F.transform("claimed", lambda x, i: F.struct((F.substring(x, 2, 1).cast("int") - 3).alias("turn"), (i + 1).alias("length")))
    back = F.transform(intervals.reversed_path(parts), lambda x: F.concat_ws(":", x["turn"].cast("string"), x["length"].cast("string")))
    return regions(s, d).select("claim_id", F.array_join(back, ",").alias("back"))


@query("""WITH s AS (SELECT event_id, sha256('key-' || CAST(event_id AS VARCHAR)) AS h FROM events)
    SELECT event_id, round((CAST(('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2)) AS BIGINT) / 4294967296.0 - 0.5) * 2 * 0.035, 9) AS noise FROM s""")
def stable_noise(s, d):
    return table(s, d, "events").select("event_id", F.round(C.stable_noise(F.concat(F.lit("key-"), F.col("event_id").cast("string"))), 9).alias("noise"))


# -- claims -------------------------------------------------------------------


@query("SELECT event_id, array_to_string(CASE WHEN v < 50 THEN ['e4'] WHEN v < 100 THEN ['d3', 'd4'] WHEN v < 150 THEN ['d3', 'c4'] ELSE ['d4'] END, ',') AS regions FROM (SELECT event_id, event_id % 200 AS v FROM events)")
def time_bucket_regions(s, d):
    return table(s, d, "events").select("event_id", F.array_join(C.time_bucket_regions(F.col("event_id") % 200), ",").alias("regions"))


_POOLED = "flatten(list_transform(['a','b','c','d','e','f'], lambda r: list_transform(['1','2','3','4','5','6'], lambda c: r || c)))"


def draw(n: str, *parts: str) -> str:
    """The SQL twin of ``columns.keyed``."""
    joined = " || '|' || ".join(parts)
    return f"(CAST(('0x' || substr(md5({joined}), 1, 12)) AS BIGINT) % {n})"


_OTHERS = f"list_filter({_POOLED}, lambda o: o <> x)"
_MUTATED = f"list_transform(LIST, lambda x, i: CASE WHEN i <= {draw('len(LIST)', chr(39) + 'n' + chr(39), 'KEY')} + 1 THEN ({_OTHERS})[CAST({draw('35', chr(39) + 'r' + chr(39), 'KEY', 'CAST(i - 1 AS VARCHAR)')} + 1 AS INT)] ELSE x END)"
_BUCKETS = "CASE WHEN v < 50 THEN ['e4'] WHEN v < 100 THEN ['d3', 'd4'] WHEN v < 150 THEN ['d3', 'c4'] ELSE ['d4'] END"


def _mutated(lst: str, key: str) -> str:
    return _MUTATED.replace("LIST", lst).replace("KEY", f"CAST({key} AS VARCHAR)")


@query(f"""WITH e AS (SELECT event_id, user_id, {_BUCKETS} AS label, row_number() OVER (PARTITION BY user_id ORDER BY md5('loc|' || CAST(event_id AS VARCHAR)), event_id) AS place, count(*) OVER (PARTITION BY user_id) AS n
        FROM (SELECT event_id, user_id, event_id % 200 AS v FROM events))
    SELECT event_id, array_to_string(label, ',') AS label_location, array_to_string(CASE WHEN place <= floor(n * 0.3) THEN {_mutated('label', 'event_id')} ELSE label END, ',') AS claim_location, place <= floor(n * 0.3) AS mutated FROM e""")
def claim_mutation(s, d):
    e = table(s, d, "events").select("event_id", "user_id", (F.col("event_id") % 200).alias("seconds"))
    out = claims.location_claims(e, "event_id", "seconds", 0.3, "loc", ["user_id"])
    return out.select("event_id", F.array_join("label_location", ",").alias("label_location"), F.array_join("claim_location", ",").alias("claim_location"), "mutated")


@query(f"SELECT event_id, array_to_string({_mutated('label', 'event_id')}, ',') AS forged FROM (SELECT event_id, {_BUCKETS} AS label FROM (SELECT event_id, event_id % 200 AS v FROM events))")
def forged_location(s, d):
    e = table(s, d, "events").select("event_id", C.time_bucket_regions(F.col("event_id") % 200).alias("label"))
    return e.select("event_id", F.array_join(claims.mutated_regions("label", "event_id"), ",").alias("forged"))


# Fixed value: the regions of the true walk, in order.
TRUE_WALK = ["e4", "e3", "e4", "e3", "d3", "d4", "e4", "d4"]


@query(f"""WITH o AS (SELECT o_orderkey AS k, o_custkey % 10 AS g, CAST(o_orderkey % 300 + 60 AS DOUBLE) AS t, {TRUE_WALK} AS label FROM orders),
    p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY md5('tr|' || CAST(k AS VARCHAR)), k) AS place, count(*) OVER (PARTITION BY g) AS n, ({draw('2001', chr(39) + 't' + chr(39), 'CAST(k AS VARCHAR)')} - 1000) / 1000.0 * 0.25 AS share FROM o),
    q AS (SELECT *, CASE WHEN place <= floor(n * 0.4) THEN (['time', 'trace', 'both'])[CAST({draw('3', chr(39) + 'kind' + chr(39), 'CAST(k AS VARCHAR)')} + 1 AS INT)] ELSE 'none' END AS kind FROM p)
    SELECT k AS claim_id, kind AS error_kind, round(CASE WHEN kind IN ('time', 'both') THEN greatest(t + CASE WHEN share < 0 THEN least(share * t, -1.0) ELSE greatest(share * t, 1.0) END, 0.001) ELSE t END, 6) AS claim_time,
           array_to_string(CASE WHEN kind IN ('trace', 'both') THEN {_mutated('label', 'k')} ELSE label END, ',') AS claim_trace FROM q""")
def trace_errors(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("claim_id"), (F.col("o_custkey") % 10).alias("g"), (F.col("o_orderkey") % 300 + 60).cast("double").alias("seconds"))
    walk = F.array(*[F.lit(x) for x in TRUE_WALK])
    out = claims.trace_claims(o, "claim_id", "seconds", walk, 0.4, "tr", ["g"])
    return out.select("claim_id", "error_kind", F.round("claim_time", 6).alias("claim_time"), F.array_join("claim_trace", ",").alias("claim_trace"))


@query(f"""WITH r AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
    z AS (SELECT DISTINCT c_nationkey, n FROM r)
    SELECT s.s_suppkey AS current_id, r.c_custkey AS replay_id FROM supplier s JOIN z ON z.c_nationkey = s.s_nationkey JOIN r ON r.c_nationkey = s.s_nationkey AND r.i = {draw('z.n', chr(39) + 'rep' + chr(39), 'CAST(s.s_suppkey AS VARCHAR)')}""")
def replay_pairing(s, d):
    cur = table(s, d, "supplier").select(F.col("s_suppkey").alias("current_id"), F.col("s_nationkey").alias("g"))
    rep = table(s, d, "customer").select(F.col("c_custkey").alias("replay_id"), F.col("c_nationkey").alias("g"))
    return claims.paired_by_hash(cur, rep, "current_id", "replay_id", "rep", ["g"]).select("current_id", "replay_id")


@query(f"""WITH r AS (SELECT p_partkey, p_size % 5 AS g, row_number() OVER (PARTITION BY p_size % 5 ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_size % 5) AS n FROM part), z AS (SELECT DISTINCT g, n FROM r)
    SELECT c.c_custkey AS claim_id, r.p_partkey AS label_id, 'transplant_trace' AS attack FROM customer c JOIN z ON z.g = c.c_custkey % 5 JOIN r ON r.g = z.g AND r.i = {draw('z.n', chr(39) + 'tp' + chr(39), 'CAST(c.c_custkey AS VARCHAR)')}""")
def transplant_pairing(s, d):
    cur = table(s, d, "customer").select(F.col("c_custkey").alias("claim_id"), (F.col("c_custkey") % 5).alias("g"))
    other = table(s, d, "part").select(F.col("p_partkey").alias("label_id"), (F.col("p_size") % 5).cast("bigint").alias("g"))
    return claims.paired_by_hash(cur, other, "claim_id", "label_id", "tp", ["g"]).select("claim_id", "label_id", F.lit("transplant_trace").alias("attack"))


@query(f"""WITH {TRACE}, e AS (SELECT trace_id, max(row_idx) + 1 AS n FROM trace GROUP BY trace_id),
    a AS (SELECT trace_id, n, {draw('(n - 6 + 1)', chr(39) + 'signal' + chr(39), 'CAST(trace_id AS VARCHAR)')} AS st FROM e WHERE n >= 6), b AS (SELECT trace_id, n, {draw('(n - 6 + 1)', chr(39) + 'label' + chr(39), 'CAST(trace_id AS VARCHAR)')} AS st FROM e WHERE n >= 6)
    SELECT t.trace_id, t.row_idx - a.st AS sample_row, 'signal' AS part, t.event_id FROM trace t JOIN a ON a.trace_id = t.trace_id AND t.row_idx >= st AND t.row_idx < st + 6
    UNION ALL SELECT t.trace_id, t.row_idx - b.st + 6, 'label', t.event_id FROM trace t JOIN b ON b.trace_id = t.trace_id AND t.row_idx >= st AND t.row_idx < st + 6""")
def transplant(s, d):
    t = trace(s, d)
    a = intervals.contiguous_sample(t, 6, "signal").select("trace_id", "sample_row", F.lit("signal").alias("part"), "event_id")
    b = intervals.contiguous_sample(t, 6, "label").select("trace_id", (F.col("sample_row") + 6).alias("sample_row"), F.lit("label").alias("part"), "event_id")
    return a.unionByName(b)


@query(f"""WITH {TRACE}, size AS (SELECT trace_id, count(*) AS n FROM trace GROUP BY trace_id), c AS (SELECT a.trace_id AS claim_id, a.trace_id AS s, a.n AS sn, b.trace_id AS l, b.n AS ln FROM size a JOIN size b ON b.trace_id = a.trace_id + 1 WHERE a.n >= 6 AND b.n >= 6),
    p AS (SELECT *, row_number() OVER (ORDER BY claim_id) AS i, {draw('(sn - 6 + 1)', chr(39) + 'tl' + chr(39), chr(39) + 'signal' + chr(39), 'CAST(claim_id AS VARCHAR)')} AS ss, {draw('(ln - 6 + 1)', chr(39) + 'tl' + chr(39), chr(39) + 'label' + chr(39), 'CAST(claim_id AS VARCHAR)')} AS ls FROM c)
    SELECT i AS sample_id, claim_id, 'transplant_location/' || i || '_merged.csv' AS output_source, 12 AS output_rows, 'trace_' || s AS signal_source, ss AS signal_start, ss + 6 AS signal_end, 'trace_' || l AS label_source, ls AS label_start, ls + 6 AS label_end, 'tl' AS seed FROM p""")
def transplant_manifest(s, d):
    """Which rows of which traces each transplanted sample holds: its own and those of the trace after it."""
    size = trace(s, d).groupBy("trace_id").agg(F.count("*").alias("n"))
    name = lambda c: F.concat(F.lit("trace_"), F.col(c).cast("string"))
    other = size.select((F.col("trace_id") - 1).alias("trace_id"), F.col("trace_id").alias("label_id"), F.col("n").alias("label_rows"))
    both = size.join(other, "trace_id").select(F.col("trace_id").alias("claim_id"), name("trace_id").alias("signal_source"), F.col("n").alias("signal_rows"), name("label_id").alias("label_source"), "label_rows")
    return claims.transplant_manifest(both, 6, "tl")


_MATERIAL = f"""{TRACE}, size AS (SELECT trace_id, count(*) AS n FROM trace GROUP BY trace_id),
    pool AS (SELECT trace_id, n, CASE WHEN trace_id % 4 = 0 THEN 0 ELSE 1 END AS level FROM size WHERE n >= 8 AND trace_id % 5 <> 4),
    best AS (SELECT trace_id AS material_id, n AS material_rows, row_number() OVER (ORDER BY trace_id) - 1 AS place, count(*) OVER () AS m FROM pool WHERE level = (SELECT min(level) FROM pool)),
    asked AS (SELECT trace_id AS claim_id, n AS base_rows, {draw('(SELECT count(*) FROM best)', chr(39) + 'material' + chr(39), 'CAST(trace_id AS VARCHAR)')} AS place FROM size),
    made AS (SELECT claim_id, base_rows, material_id, {draw('(material_rows - 8 + 1)', chr(39) + 'start' + chr(39), 'CAST(claim_id AS VARCHAR)', 'CAST(material_id AS VARCHAR)')} AS material_start, material_rows FROM asked JOIN best USING (place)),
    man AS (SELECT claim_id, material_id, base_rows, base_rows + 8 AS output_rows, material_start, material_start + 8 AS material_end, least(material_start // 4, (material_rows + 3) // 4 - 2) AS signal_start, least(material_start // 4, (material_rows + 3) // 4 - 2) + 2 AS signal_end FROM made)"""


def _material(s, d):
    size = trace(s, d).groupBy("trace_id").agg(F.count("*").alias("n"))
    pool = size.where("trace_id % 5 <> 4").withColumn("level", F.when(F.col("trace_id") % 4 == 0, 0).otherwise(1))
    return claims.with_material(size, pool, 8, 4)


@query(f"WITH {_MATERIAL} SELECT * FROM man")
def replay_manifest(s, d):
    """Which rows of which trace are appended to each: from the preferred pool where it has any, with the signal rows beside them."""
    return _material(s, d)


@query(f"""WITH {_MATERIAL} SELECT t.trace_id AS claim_id, row_idx, round(value, 6) AS value, row_idx // 4 AS signal_row, false AS appended FROM trace t
    UNION ALL SELECT claim_id, base_rows + row_idx - material_start, round(value, 6), (base_rows + 3) // 4 + least((row_idx - material_start) // 4, 1), true FROM man JOIN trace t ON t.trace_id = material_id AND row_idx >= material_start AND row_idx < material_end""")
def replay_dataset(s, d):
    """The traces with their appended rows, each row with its row in the appended signal."""
    return claims.with_replayed(trace(s, d).select("trace_id", "row_idx", "value"), _material(s, d), 4).select("claim_id", "row_idx", F.round("value", 6).alias("value"), "signal_row", "appended")


@query("""SELECT s_suppkey AS claim_id, arg_min(c_custkey, (abs(c_custkey * 13 % 1000 - s_suppkey * 7 % 1000), c_custkey)) AS replay_id, 'replay_location' AS attack FROM supplier JOIN customer ON c_nationkey = s_nationkey GROUP BY s_suppkey""")
def replay_location(s, d):
    """Each location claim with the replayed sample whose middle time is nearest."""
    asked = table(s, d, "supplier").select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").alias("claim_id"), (F.col("s_suppkey") * 7 % 1000).alias("at"))
    samples = table(s, d, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("replay_id"), (F.col("c_custkey") * 13 % 1000).alias("mid"))
    return joins.nearest(asked, samples, ["g"], "at", "mid", "replay_id").where("nearest_id is not null").select("claim_id", F.col("nearest_id").alias("replay_id"), F.lit("replay_location").alias("attack"))
