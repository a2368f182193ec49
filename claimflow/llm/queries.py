"""The registered queries of this package: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, exact_dedup, infill, licenses, mixing, packing, pii, quality, quotes, resampling, sharding, simhash, toxicity

PII_KEY = "surrogates-1"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), learn=_remainder(5) != 0)
    return scored.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/documents.parquet"
    groups = exact_dedup.exact_dedup_path(spark, path)
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_ordered(_table(spark, sf_dir, "conversations"))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), learn=_remainder(3) != 1)
    return scored.select("doc_id", (_remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(_table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(infill.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda x: x["label"]))), ",")
    starts = F.transform(base, lambda x: x["first_word"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels("spans").alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda x: x["score"])), F.lit(0.0)).alias("score"),
    )


_OPERATORS = (
    op1_best_fit_packing,
    op2_nearest_neighbours,
    op3_toxicity,
    op4_mixing,
    op5_exact_dedup,
    op6_simhash,
    op7_sharding,
    op8_quotation_linking,
    op9_pii_surrogates,
    op10_quality,
    op11_importance_resampling,
    op12_fill_in_middle,
    op13_license_scan,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _OPERATORS}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _notice_rows() -> str:
    rows = (f"('{n.label}', '{n.phrase}', {n.errors}, CAST([{', '.join(repr(k) for k in n.keys)}] AS VARCHAR[]), {str(n.base).lower()})" for n in licenses.NOTICES)
    return ", ".join(rows)


ORACLES: dict[str, str] = {
    # crc32 by a table of its 256 remainders, byte by byte over the distinct words.
    "op11_importance_resampling": rf"""
        WITH RECURSIVE r(b, k, c) AS (
            SELECT b, 0, CAST(b AS BIGINT) FROM range(256) t(b)
            UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM r WHERE k < 8),
        tab AS (SELECT list(c ORDER BY b) AS t FROM r WHERE k = 8),
        d AS (SELECT row_number() OVER () AS uid, doc_id, {_WORDS} AS words FROM documents),
        f AS (SELECT uid, unnest(words) AS w FROM d),
        g AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
        v AS (SELECT DISTINCT w FROM (SELECT w FROM f UNION ALL SELECT w FROM g)),
        bytes AS (SELECT w, list_transform(range(0, octet_length(encode(w))), lambda i: CAST(('0x' || substr(hex(encode(w)), 2 * i + 1, 2)) AS BIGINT)) AS x FROM v),
        coded AS (SELECT w, xor(list_reduce(list_prepend(4294967295, x), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, tab),
        s AS (SELECT bucket, count(*) AS n FROM f JOIN coded USING (w) GROUP BY bucket),
        t AS (SELECT bucket, count(*) AS n FROM g JOIN coded USING (w) GROUP BY bucket),
        b AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain
              FROM s LEFT JOIN t USING (bucket)),
        sums AS (SELECT uid, sum(gain) AS total FROM f JOIN coded USING (w) JOIN b USING (bucket) GROUP BY uid),
        w AS (SELECT uid, doc_id, CAST(len(words) AS BIGINT) AS n_features, CAST(CASE WHEN len(words) > 0 THEN floor(total::DOUBLE / len(words)) ELSE 0 END AS BIGINT) AS weight,
                     CAST(('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) AS h FROM d LEFT JOIN sums USING (uid)),
        scored AS (SELECT uid, doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296::DOUBLE))) AS BIGINT) AS score FROM w),
        placed AS (SELECT uid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (uid)""",
    "op12_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
        h AS (SELECT doc_id, t, u, len(u) AS n, [CAST(('0x' || substr(s, 8 * i + 1, 8)) AS BIGINT) FOR i IN range(4)] AS h FROM d),
        c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
                     CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
        p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle, coalesce(array_to_string(u[b + 1:], ''), '') AS suffix FROM c)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
        FROM p""",
    "op13_license_scan": rf"""
        WITH notices(label, phrase, k, keys, base) AS (VALUES {_notice_rows()}),
        lens AS (SELECT *, unnest(range(len(string_split(phrase, ' ')) - k, len(string_split(phrase, ' ')) + k + 1)) AS m FROM notices),
        d AS (SELECT row_number() OVER () AS uid, doc_id, {_WORDS} AS words FROM documents),
        r AS (SELECT uid, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS i FROM d),
        ahead AS (SELECT uid, i, list(w) OVER (PARTITION BY uid ORDER BY i ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING) AS words FROM r),
        spans AS (SELECT uid, i, m, words[1:m] AS w, array_to_string(words[1:m], ' ') AS span FROM ahead JOIN (SELECT DISTINCT m FROM lens WHERE m > 0) ON m <= len(words)),
        near AS (SELECT *, levenshtein(span, phrase) AS e FROM spans JOIN lens USING (m) WHERE length(span) BETWEEN length(phrase) - k AND length(phrase) + k),
        hit AS (SELECT * FROM near WHERE e <= k AND list_has_all(w, keys)),
        told AS (SELECT uid, count(*) FILTER (base AND e = 0) AS n_base, min(i) FILTER (base AND e = 0) AS first_word, max(i) FILTER (base AND e = 0) AS last_word,
                        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND e = 0) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(1 - CAST(e AS DOUBLE) / length(phrase)) AS score FROM hit GROUP BY uid)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
        FROM d LEFT JOIN told USING (uid)""",
    "op5_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               row_number() OVER (PARTITION BY t ORDER BY doc_id DESC) = 1 AS kept, sha256(t) AS text_sha256
        FROM d""",
    "op8_quotation_linking": r"""
        WITH RECURSIVE m AS (
            SELECT row_number() OVER () AS uid, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
        l AS (
            SELECT uid, conv_id, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM m),
        v AS (SELECT *, len(regexp_replace(regexp_extract(line, '^[ \t>]*>'), '[^>]', '', 'g')) AS level,
                     regexp_replace(line, '^[ \t>]*>', '') AS body FROM l),
        own AS (SELECT uid, any_value(conv_id) AS conv_id, any_value(turn) AS turn,
                       trim(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (level = 0), ''), ' ' || chr(9) || chr(10) || chr(13)) AS own FROM v GROUP BY uid),
        units AS (
            SELECT conv_id, turn, own AS unit FROM own
            UNION ALL SELECT conv_id, turn, unnest(regexp_split_to_array(own, '\n[ \t]*\n')) FROM own
            UNION ALL SELECT conv_id, turn, unnest(string_split(own, chr(10))) FROM own
            UNION ALL SELECT conv_id, turn, unnest(string_split(regexp_replace(regexp_replace(p, '[ \t\n\r\f\v]+', ' ', 'g'), '([.!?]) ', '\1' || chr(10), 'g'), chr(10)))
                      FROM (SELECT conv_id, turn, unnest(regexp_split_to_array(own, '\n[ \t]*\n')) AS p FROM own)),
        idx AS (
            SELECT conv_id, u, min(turn) AS origin FROM (SELECT conv_id, turn, lower(trim(regexp_replace(unit, '[ \t\n\r\f\v]+', ' ', 'g'))) AS u FROM units) WHERE u <> '' GROUP BY ALL),
        run AS (SELECT *, sum(new) OVER (PARTITION BY uid ORDER BY pos) AS passage FROM
               (SELECT *, CASE WHEN level <> lag(level, 1, -1) OVER (PARTITION BY uid ORDER BY pos) THEN 1 ELSE 0 END AS new FROM v)),
        pas AS (SELECT uid, conv_id, turn, passage, level, string_agg(body, chr(10) ORDER BY pos) AS body FROM run WHERE level > 0 GROUP BY ALL),
        ask AS (
            SELECT uid, conv_id, turn, passage, level, 0 AS way, body AS x FROM pas
            UNION ALL SELECT uid, conv_id, turn, passage, level, 1, unnest(string_split(body, chr(10))) FROM pas
            UNION ALL SELECT uid, conv_id, turn, passage, level, 2, unnest(string_split(regexp_replace(regexp_replace(body, '[ \t\n\r\f\v]+', ' ', 'g'), '([.!?]) ', '\1' || chr(10), 'g'), chr(10))) FROM pas),
        votes AS (
            SELECT uid, a.conv_id, turn, passage, level, way, origin, count(*) AS n
            FROM (SELECT *, lower(trim(regexp_replace(x, '[ \t\n\r\f\v]+', ' ', 'g'))) AS u FROM ask) a JOIN idx ON a.conv_id = idx.conv_id AND a.u = idx.u
            WHERE origin < turn GROUP BY ALL),
        links AS (SELECT uid, conv_id, turn, passage, level, first(origin ORDER BY way, n DESC, origin) AS origin FROM votes GROUP BY ALL),
        ups AS (SELECT conv_id, turn, first(origin ORDER BY level, origin DESC) AS up FROM links GROUP BY ALL),
        climb(conv_id, turn, root, depth) AS (
            SELECT conv_id, turn, up, 1 FROM ups
            UNION ALL SELECT c.conv_id, c.turn, u.up, c.depth + 1 FROM climb c JOIN ups u ON c.conv_id = u.conv_id AND c.root = u.turn),
        roots AS (SELECT conv_id, turn, arg_max(root, depth) AS root, max(depth) AS depth FROM climb GROUP BY ALL)
        SELECT m.conv_id, row_number() OVER (PARTITION BY m.conv_id ORDER BY coalesce(root, m.turn), coalesce(depth, 0), m.turn) - 1 AS position,
               m.turn, m.role, own.own AS text, up AS reply_to, coalesce(root, m.turn) AS thread, CAST(coalesce(depth, 0) AS BIGINT) AS depth,
               (SELECT count(*) FROM pas WHERE pas.uid = m.uid) AS quotes, (SELECT count(*) FROM links WHERE links.uid = m.uid) AS linked
        FROM m JOIN own USING (uid) LEFT JOIN ups ON ups.conv_id = m.conv_id AND ups.turn = m.turn
             LEFT JOIN roots ON roots.conv_id = m.conv_id AND roots.turn = m.turn""",
}
