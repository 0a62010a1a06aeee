"""Operational analytics: roll-ups, windows and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import ops as O
from ..operators import provenance as H
from ..operators.ordered import positions
from .base import merkle_sql, query


@query("""
WITH dim AS (SELECT unnest(['click','purchase','view','idle']) AS provider),
d AS (SELECT event_type AS provider, ts, value FROM events)
SELECT dim.provider, count(*) FILTER (WHERE CAST(ts AS DATE) = DATE '2024-01-15') AS today_calls, count(d.ts) AS month_calls,
 CAST(round(coalesce(sum(value), 0), 4) AS DOUBLE) AS month_usd, max(ts) AS last_call_at FROM dim LEFT JOIN d USING (provider) GROUP BY dim.provider""")
def spend_rollup(t):
    calls = t.events.select(F.col("event_type").alias("provider"), "ts", "value")
    return O.spend_rollup(calls, ["click", "purchase", "view", "idle"], "2024-01-15")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5")
def telemetry_last_n(t):
    return O.last_n(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id", "value")


@query("SELECT event_type AS provider, CAST(ts AS DATE) AS day, CAST(round(sum(value), 4) AS DOUBLE) AS used, sum(value) >= 2000 AS exhausted FROM events GROUP BY 1, 2")
def daily_budget(t):
    return t.events.groupBy(F.col("event_type").alias("provider"), F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 4).alias("used"), (F.sum("value") >= 2000).alias("exhausted"))


@query("SELECT event_type, max(event_id) FILTER (WHERE true) AS last_id, arg_max(user_id, struct_pack(a := ts, b := event_id)) AS last_user FROM events GROUP BY event_type".replace("max(event_id) FILTER (WHERE true)", "arg_max(event_id, struct_pack(a := ts, b := event_id))"))
def latest_per_group(t):
    at = F.struct("ts", "event_id")
    return t.events.groupBy("event_type").agg(F.max_by("event_id", at).alias("last_id"), F.max_by("user_id", at).alias("last_user"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE quality = 1) AS correct, count(*) FILTER (WHERE quality = 0) AS incorrect, round(100.0 * count(*) FILTER (WHERE quality = 1) / count(*), 1) AS accuracy FROM labels WHERE quality <> -1")
def accuracy_stats(t):
    return t.labels.where("quality <> -1").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.expr("quality = 1")).alias("correct"), F.count_if(F.expr("quality = 0")).alias("incorrect"), F.round(F.lit(100.0) * F.count_if(F.expr("quality = 1")) / F.count(F.lit(1)), 1).alias("accuracy"))


SKIP = "WITH s AS (SELECT lang AS ext, source AS reason, CASE WHEN n_chars <= 0 THEN 0 ELSE greatest(1, n_chars // 45) END AS loc  FROM documents)"


def skips(t):
    return t.documents.select(F.col("lang").alias("ext"), F.col("source").alias("reason"), O.estimated_loc(F.col("n_chars")).alias("loc"))


@query(f"{SKIP} SELECT ext, reason, count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc FROM s GROUP BY ext, reason")
def skip_coverage(t):
    return skips(t).groupBy("ext", "reason").agg(F.count(F.lit(1)).alias("files"), F.sum("loc").alias("loc"))


@query(f"{SKIP}, g AS (SELECT reason AS ext, count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc FROM s GROUP BY reason), r AS (SELECT *, row_number() OVER (ORDER BY loc DESC, ext) AS k FROM g) SELECT CASE WHEN k <= 5 THEN ext ELSE '(rest)' END AS ext, CAST(sum(files) AS BIGINT) AS files, CAST(sum(loc) AS BIGINT) AS loc FROM r GROUP BY 1")
def skip_banner_topk(t):
    g = skips(t).groupBy(F.col("reason").alias("ext")).agg(F.count(F.lit(1)).alias("files"), F.sum("loc").alias("loc"))
    return O.top_and_rest(g, "ext", F.desc("loc"), 5, ["files", "loc"])


FEATURES = "f AS (SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, len(regexp_extract_all(text, 'the')) AS n_the, len(regexp_extract_all(text, ',')) AS n_commas, n_chars FROM documents)"


def features(t):
    return t.documents.select("doc_id", F.size(F.split("text", "\n")).alias("n_lines"), F.regexp_count("text", F.lit("the")).alias("n_the"), F.regexp_count("text", F.lit(",")).alias("n_commas"), "n_chars")


@query(f"WITH {FEATURES} SELECT doc_id, round((CASE WHEN n_the > 0 THEN 0.3 ELSE 0 END) + (CASE WHEN n_commas > 0 THEN 0.2 ELSE 0 END) + (CASE WHEN n_lines > 1 THEN 0.2 ELSE 0 END) + (CASE WHEN n_chars > 500 THEN 0.2 ELSE 0 END) + (CASE WHEN n_lines > 10 AND n_the / n_lines > 0.05 THEN 0.1 ELSE 0 END), 3) AS score FROM f")
def quality_score_v1(t):
    return features(t).select("doc_id", O.weighted_score([(F.col("n_the") > 0, 0.3), (F.col("n_commas") > 0, 0.2), (F.col("n_lines") > 1, 0.2), (F.col("n_chars") > 500, 0.2), ((F.col("n_lines") > 10) & (F.col("n_the") / F.col("n_lines") > 0.05), 0.1)]).alias("score"))


@query(f"WITH {FEATURES} SELECT doc_id, round(0.5 * least(1.0, n_the / 10) + 0.3 * least(1.0, n_commas / 5) + 0.2 * least(1.0, n_lines / 4), 4) AS score FROM f")
def quality_weighted_v2(t):
    return features(t).select("doc_id", O.profile_score({"n_the": (0.5, 10), "n_commas": (0.3, 5), "n_lines": (0.2, 4)}).alias("score"))


@query("""
WITH q AS (SELECT d.lang AS grammar, l.quality AS q, CASE WHEN contains(d.text, ' the ') THEN 1 ELSE 0 END AS has FROM documents d JOIN labels l USING (doc_id)),
g AS (SELECT grammar, count(*) AS files, avg(q) FILTER (WHERE has = 1) AS w, avg(q) FILTER (WHERE has = 0) AS o FROM q GROUP BY grammar)
SELECT grammar, files, round(w - o, 6) AS gain, files >= 10 AND w - o >= 0.1 AS promote FROM g WHERE w IS NOT NULL AND o IS NOT NULL""")
def pattern_promotion(t):
    rows = t.documents.select("doc_id", F.col("lang").alias("grammar"), F.col("text").contains(" the ").alias("has")).join(t.labels.select("doc_id", F.col("quality").alias("q")), "doc_id")
    return O.promotion(rows, "grammar", "has", "q")


@query("SELECT source AS pattern, count(*) FILTER (WHERE quality = 1) AS hits, count(*) FILTER (WHERE quality = 0) AS misses, NOT (count(*) >= 20 AND count(*) FILTER (WHERE quality = 1) / count(*) < 0.3) AS active FROM labels JOIN documents USING (doc_id) GROUP BY source")
def pattern_decay(t):
    g = t.labels.join(t.documents.select("doc_id", F.col("source").alias("pattern")), "doc_id").groupBy("pattern").agg(F.count_if(F.expr("quality = 1")).alias("hits"), F.count_if(F.expr("quality = 0")).alias("misses"))
    n = F.col("hits") + F.col("misses")
    return g.withColumn("active", ~((n >= 20) & (F.col("hits") / n < 0.3)))


@query("""
WITH e AS (SELECT user_id, event_id, ts, CASE WHEN event_type IN ('click','view') THEN 3 ELSE -5 END AS d FROM events),
s AS (SELECT *, sum(d) OVER w AS s FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id, CAST(s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS lines FROM s""")
def timeline_clamped_sum(t):
    e = t.events.withColumn("d", F.when(F.col("event_type").isin("click", "view"), 3).otherwise(-5))
    return O.clamped_sum(e, ["user_id"], ["ts", "event_id"], "d", "lines").select("user_id", "event_id", "lines")


@query("SELECT user_id, min(ts) AS first_seen, arg_min(event_type, struct_pack(a := ts, b := event_id)) AS first_author, max(ts) AS last_modified, count(*) AS changes FROM events GROUP BY user_id")
def timeline_first_last(t):
    return t.events.groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.min_by("event_type", F.struct("ts", "event_id")).alias("first_author"), F.max("ts").alias("last_modified"), F.count(F.lit(1)).alias("changes"))


@query("WITH r AS (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_id FROM r WHERE (k - 1) % greatest(1, n // 100) = 0 OR k = n")
def every_kth(t):
    n = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    r = positions(t.events.select("event_type", "event_id", "ts"), ["event_type"], ["ts", "event_id"], "k").join(n, "event_type")
    return r.where("k % greatest(1, n div 100) = 0 or k = n - 1").select("event_id")


@query("SELECT event_id, user_id, (event_id % 7) AS sequence, row_number() OVER (PARTITION BY user_id ORDER BY event_id) + 10 AS seq FROM events".replace("(event_id % 7) AS sequence, ", ""))
def sequence_allocation(t):
    return t.events.select("event_id", "user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) + 10).cast("long").alias("seq"))


@query("""
WITH c AS (SELECT l_partkey, count(*) AS callers FROM lineitem GROUP BY 1)
SELECT p_partkey, 2 * coalesce(callers, 0) + CASE WHEN p_size > 25 THEN 5 ELSE 0 END + p_size % 4 + CASE WHEN starts_with(p_brand, 'Brand#1') THEN 0 ELSE 1 END AS score,
 CASE WHEN 2 * coalesce(callers, 0) + CASE WHEN p_size > 25 THEN 5 ELSE 0 END + p_size % 4 + CASE WHEN starts_with(p_brand, 'Brand#1') THEN 0 ELSE 1 END >= 90 THEN 'critical' WHEN 2 * coalesce(callers, 0) + CASE WHEN p_size > 25 THEN 5 ELSE 0 END + p_size % 4 + CASE WHEN starts_with(p_brand, 'Brand#1') THEN 0 ELSE 1 END >= 40 THEN 'high' WHEN 2 * coalesce(callers, 0) + CASE WHEN p_size > 25 THEN 5 ELSE 0 END + p_size % 4 + CASE WHEN starts_with(p_brand, 'Brand#1') THEN 0 ELSE 1 END >= 20 THEN 'medium' WHEN 2 * coalesce(callers, 0) + CASE WHEN p_size > 25 THEN 5 ELSE 0 END + p_size % 4 + CASE WHEN starts_with(p_brand, 'Brand#1') THEN 0 ELSE 1 END >= 8 THEN 'low' ELSE 'info' END AS label
FROM part LEFT JOIN c ON l_partkey = p_partkey""")
def severity_rank(t):
    c = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("callers"))
    p = t.part.join(c, "p_partkey", "left")
    score = O.severity_score(F.coalesce("callers", F.lit(0)), F.col("p_size") > 25, F.col("p_size") % 4, ~F.startswith("p_brand", F.lit("Brand#1")))
    return p.select("p_partkey", score.alias("score"), O.severity_label(score).alias("label"))


@query("SELECT o_orderkey, CAST(floor(CASE WHEN loc <= 3 AND br = 0 AND cyc <= 2 THEN 25 WHEN loc > 50 OR br > 5 OR cyc > 10 THEN 200 ELSE 100 END * CASE WHEN recent THEN 1.5 ELSE 1.0 END) AS BIGINT) AS examples FROM (SELECT o_orderkey, o_orderkey % 60 AS loc, o_orderkey % 8 AS br, o_custkey % 12 AS cyc, o_orderstatus = 'O' AS recent FROM orders)")
def test_budget_tiers(t):
    return t.orders.select("o_orderkey", O.test_budget(F.col("o_orderkey") % 60, F.col("o_orderkey") % 8, F.col("o_custkey") % 12, F.col("o_orderstatus") == "O").alias("examples"))


@query("SELECT l_linenumber, l_quantity, count(DISTINCT l_suppkey) AS callers FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) >= 2")
def boundary_literals(t):
    return t.lineitem.groupBy("l_linenumber", "l_quantity").agg(F.count_distinct("l_suppkey").alias("callers")).where("callers >= 2")


@query("WITH u AS (SELECT user_id, strftime(ts, '%Y-%m') AS month, count(*) AS used FROM events GROUP BY 1, 2) SELECT user_id, month, used, CASE WHEN user_id % 3 = 0 THEN false ELSE used >= CASE WHEN user_id % 3 = 1 THEN 5 ELSE 50 END END AS denied FROM u")
def monthly_quota(t):
    u = t.events.groupBy("user_id", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("used"))
    limit = F.when(F.col("user_id") % 3 == 1, 5).when(F.col("user_id") % 3 == 2, 50)
    return u.withColumn("denied", F.coalesce(F.col("used") >= limit, F.lit(False)))


@query("WITH r AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS w FROM conversations), d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS w FROM benchmark) SELECT coalesce(r.w, d.w) AS w, CASE WHEN d.w IS NULL THEN 'missing' ELSE 'extra' END AS status FROM r FULL JOIN d ON r.w = d.w WHERE r.w IS NULL OR d.w IS NULL")
def dep_coverage(t):
    def words(df):
        return df.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))).alias("w")).distinct()

    return O.coverage(words(t.conversations), words(t.benchmark), "w")


@query("WITH l AS (SELECT unnest(['critical','high','medium','low','info']) AS severity), s AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'other' END AS severity FROM orders) SELECT l.severity, count(s.severity) AS n FROM l LEFT JOIN s USING (severity) GROUP BY 1")
def scan_manifest_rollup(t):
    s = t.orders.select(F.when(F.col("o_orderpriority") == "1-URGENT", "critical").when(F.col("o_orderpriority") == "2-HIGH", "high").when(F.col("o_orderpriority") == "3-MEDIUM", "medium").otherwise("other").alias("severity"))
    return O.zero_filled(s, "severity", ["critical", "high", "medium", "low", "info"])


@query("SELECT source, count(*) AS n, count(*) FILTER (WHERE lang = 'en') AS n_en, CAST(greatest(count(*) FILTER (WHERE lang = 'fr'), count(*) FILTER (WHERE n_chars > 1000)) AS BIGINT) AS n_decl, max(n_chars) AS n_lines FROM documents GROUP BY source")
def file_parse_stats(t):
    return t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("lang = 'en'")).alias("n_en"), F.greatest(F.count_if(F.expr("lang = 'fr'")), F.count_if(F.expr("n_chars > 1000"))).alias("n_decl"), F.max("n_chars").alias("n_lines"))


@query("WITH a AS (SELECT conv_id AS node, turn AS n, role = 'assistant' AS passed FROM conversations), p AS (SELECT node, max(n) AS final FROM a WHERE passed GROUP BY node), c AS (SELECT node, count(*) AS attempts FROM a GROUP BY node) SELECT c.node, p.final, c.attempts, p.node IS NULL AS exhausted FROM c LEFT JOIN p ON c.node = p.node")
def retry_report(t):
    a = t.conversations.select(F.col("conv_id").alias("node"), F.col("turn").alias("n"), (F.col("role") == "assistant").alias("passed"))
    g = a.groupBy("node").agg(F.max(F.when(F.col("passed"), F.col("n"))).alias("final"), F.count(F.lit(1)).alias("attempts"))
    return g.withColumn("exhausted", F.col("final").isNull())


@query("WITH d AS (SELECT unnest(['click','view','never']) AS provider), m AS (SELECT event_type AS provider, max(ts) AS ok FROM events WHERE value > 50 GROUP BY 1) SELECT d.provider, m.ok IS NULL OR TIMESTAMP '2024-01-30 23:59:59' - m.ok < INTERVAL 1 DAY AS available FROM d LEFT JOIN m USING (provider)")
def provider_health(t):
    m = t.events.where("value > 50").groupBy(F.col("event_type").alias("provider")).agg(F.max("ts").alias("ok"))
    d = t.spark.createDataFrame([("click",), ("view",), ("never",)], "provider string")
    age = F.expr("timestamp_ntz'2024-01-30 23:59:59' - cast(ok as timestamp_ntz)")
    return d.join(m, "provider", "left").select("provider", (F.col("ok").isNull() | (age < F.expr("interval 1 day"))).alias("available"))


@query(merkle_sql("SELECT CAST(b AS BIGINT) AS i, string_agg(doc_id || chr(9) || n_chars, chr(10) ORDER BY doc_id) AS c FROM (SELECT doc_id, n_chars, (row_number() OVER (ORDER BY doc_id) - 1) // 1000 AS b FROM documents) GROUP BY b"))
def codebase_fingerprint(t):
    return H.fingerprint(t.documents.select("doc_id", F.concat(F.col("doc_id"), F.lit("\t"), F.col("n_chars")).alias("line")), "doc_id", "line")


@query("SELECT doc_id, sha256(array_to_string(string_split(text, chr(10))[2:4], chr(10))) AS snippet FROM documents WHERE len(string_split(text, chr(10))) >= 4")
def line_range_snippet(t):
    lines = F.split("text", "\n")
    return t.documents.where(F.size(lines) >= 4).select("doc_id", F.sha2(F.array_join(F.slice(lines, 2, 3), "\n"), 256).alias("snippet"))
