"""Roll-ups, scores, JSON leaves and dependency checks over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ops as O
from ..operators import rollups as U
from .base import query
from .transform_queries import EMB, mapping_status

PROVIDERS = {"click": 500.0, "view": 100.0, "purchase": 900.0, "never": 7.0}


@query("""
WITH c AS (SELECT unnest(['click', 'view', 'purchase', 'never']) AS provider, unnest([500.0, 100.0, 900.0, 7.0]) AS cap),
d AS (SELECT event_type AS provider, CAST(ts AS DATE) = DATE '2024-01-15' AS now, user_id % 4 <> 0 AS ok, event_id % 100 AS ti, user_id AS tout, value, ts FROM events),
e AS (SELECT c.provider, count(*) FILTER (WHERE now) AS today_calls, coalesce(sum(ti) FILTER (WHERE now AND ok), 0) AS today_tokens_in, coalesce(sum(tout) FILTER (WHERE now AND ok), 0) AS today_tokens_out, coalesce(sum(value) FILTER (WHERE now AND ok), 0) AS today_usd, coalesce(sum(value) FILTER (WHERE ok), 0) AS month_usd, count(d.ts) AS month_calls, max(ts) AS last_call_at, any_value(cap) AS cap FROM c LEFT JOIN d ON c.provider = d.provider GROUP BY 1)
SELECT provider, today_calls, CAST(today_tokens_in AS BIGINT) AS today_tokens_in, CAST(today_tokens_out AS BIGINT) AS today_tokens_out, CAST(round(today_usd, 6) AS DOUBLE) AS today_usd, CAST(round(month_usd, 6) AS DOUBLE) AS month_usd, month_calls, last_call_at, CAST(round(greatest(0, CAST(cap AS DOUBLE) - today_usd), 6) AS DOUBLE) AS remaining_today FROM e
UNION ALL SELECT 'total', CAST(sum(today_calls) AS BIGINT), CAST(sum(today_tokens_in) AS BIGINT), CAST(sum(today_tokens_out) AS BIGINT), CAST(round(sum(today_usd), 6) AS DOUBLE), CAST(round(sum(month_usd), 6) AS DOUBLE), CAST(sum(month_calls) AS BIGINT), NULL, NULL FROM e""")
def spend_remaining(t):
    calls = t.events.select(F.col("event_type").alias("provider"), F.to_date("ts").alias("day"), F.when(F.col("user_id") % 4 != 0, "ok").otherwise("failed").alias("status"), (F.col("event_id") % 100).alias("tokens_in"), F.col("user_id").alias("tokens_out"), F.col("value").alias("usd"), F.col("ts").alias("at"))
    caps = t.spark.createDataFrame(list(PROVIDERS.items()), "provider string, cap double")
    return U.spend(calls, caps, F.lit("2024-01-15").cast("date"))


SKIPS = "s AS (SELECT source AS ext, lang AS reason, CASE WHEN n_chars <= 0 THEN 0 ELSE greatest(1, n_chars // 45) END AS loc FROM documents)"


def skips(t):
    return t.documents.select(F.col("source").alias("ext"), F.col("lang").alias("reason"), O.estimated_loc(F.col("n_chars")).alias("loc"))


@query(f"WITH {SKIPS}, g AS (SELECT ext, sum(loc) AS loc FROM s GROUP BY 1), k AS (SELECT ext, row_number() OVER (ORDER BY loc DESC, ext) AS r FROM g) SELECT CASE WHEN r <= 5 THEN s.ext ELSE '(rest)' END AS ext, count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc, array_to_string(list_sort(list(DISTINCT reason) FILTER (WHERE reason IS NOT NULL)), ',') AS reasons FROM s JOIN k ON s.ext = k.ext GROUP BY 1")
def skip_banner_reasons(t):
    return U.skip_banner(skips(t).where("ext is not null")).withColumn("reasons", F.array_join("reasons", ","))


@query(f"WITH {SKIPS} SELECT round(sum(loc) FILTER (WHERE reason = 'fr') / sum(loc), 6) AS ratio, CASE WHEN sum(loc) FILTER (WHERE reason = 'fr') / sum(loc) > 0.2 THEN 2 ELSE 0 END AS rc FROM s")
def skip_verdict(t):
    s = skips(t)
    return U.skip_verdict(s.where("reason = 'fr'"), s.where("not (reason <=> 'fr')"), 0.2)


@query(f"WITH {EMB}, s AS (SELECT legacy, max(sim) FILTER (WHERE rank = 1) AS a, max(sim) FILTER (WHERE rank = 2) AS b FROM k GROUP BY legacy), m AS (SELECT CASE WHEN a < 0.6 THEN 'no_match' WHEN a - b < 0.05 THEN 'ambiguous' WHEN a >= 0.85 THEN 'ok' ELSE 'low_confidence' END AS status FROM s) SELECT count(*) FILTER (WHERE status = 'ok') AS n_ok, count(*) FILTER (WHERE status = 'low_confidence') AS n_low_confidence, count(*) FILTER (WHERE status = 'ambiguous') AS n_ambiguous, count(*) FILTER (WHERE status = 'no_match') AS n_no_match, count(*) FILTER (WHERE status <> 'ok') > 0 AS requires_review FROM m")
def mapping_counts(t):
    return U.mapping_counts(mapping_status(t))


@query("SELECT max(abs(o_totalprice)) AS max_abs, min(abs(o_totalprice)) AS min_abs, CASE WHEN max(abs(o_totalprice)) > 99999 THEN 'blocker' ELSE 'ok' END AS exceeds_precision, 'warn' AS scale_truncation FROM orders")
def precision_bounds(t):
    return U.precision_bounds(t.orders, "o_totalprice", 5, 4, 2)


@query("WITH f AS (SELECT CASE user_id % 6 WHEN 0 THEN 'warn' WHEN 1 THEN 'info' WHEN 2 THEN 'timeout' WHEN 3 THEN 'error' ELSE 'ok' END AS severity, event_id = 17 AS human FROM events) SELECT count(*) FILTER (WHERE severity = 'blocker') AS n_blocker, count(*) FILTER (WHERE severity = 'warn') AS n_warn, count(*) FILTER (WHERE severity = 'info') AS n_info, count(*) FILTER (WHERE severity = 'timeout') AS n_timeout, count(*) FILTER (WHERE severity = 'error') AS n_error, count(*) FILTER (WHERE severity = 'blocker') > 0 OR coalesce(bool_or(human), false) AS requires_review FROM f")
def manifest_counts(t):
    k = F.col("user_id") % 6
    s = F.when(k == 0, "warn").when(k == 1, "info").when(k == 2, "timeout").when(k == 3, "error").otherwise("ok")
    return U.manifest_counts(t.events.select(s.alias("severity"), (F.col("event_id") == 17).alias("human")))


@query("SELECT p_brand || CASE WHEN p_size % 3 = 0 THEN '.PY' ELSE '.rs' END AS file_path, p_name AS name, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END AS start_line FROM part WHERE p_size % 3 <> 0 AND p_type IN ('ECONOMY', 'STANDARD')")
def scan_targets(t):
    kind = F.when(F.col("p_type") == "ECONOMY", "function").when(F.col("p_type") == "STANDARD", "method").otherwise("class")
    n = t.part.select(F.concat("p_brand", F.when(F.col("p_size") % 3 == 0, ".PY").otherwise(".rs")).alias("file_path"), "p_name", kind.alias("type"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("start_line"))
    return U.targets(n.withColumnRenamed("p_name", "name"))


@query("""
SELECT p_partkey, round(CASE WHEN p_size % 2 = 1 THEN 0.2 ELSE 0 END + CASE WHEN p_size % 3 = 1 THEN 0.3 ELSE 0 END + CASE WHEN p_size >= 1 THEN 0.15 ELSE 0 END, 4) AS cobol,
 round(CASE WHEN p_size % 3 >= 1 THEN 0.3 ELSE 0 END + CASE WHEN p_size >= 5 THEN 0.2 ELSE 0 END, 4) AS hlasm, round(CASE WHEN p_size % 5 >= 1 THEN 0.25 ELSE 0 END + CASE WHEN p_size > 10 THEN 0.1 ELSE 0 END, 4) AS fortran FROM part""")
def language_scores(t):
    n = F.col("p_size")
    stats = lambda **kw: F.create_map(*[x for k, v in kw.items() for x in (F.lit(k), v)])
    one = lambda c: F.when(c, 1).otherwise(0)
    return t.part.select("p_partkey", U.language_score("cobol", stats(has_identification_division=one(n % 2 == 1), has_procedure_division=one(n % 3 == 1), n_paragraphs_in_procedure=n)).alias("cobol"), U.language_score("hlasm", stats(n_csect_or_rsect=n % 3, n_instruction_statements=n)).alias("hlasm"), U.language_score("fortran", stats(n_use=F.lit(0), n_program_or_module_or_sub_or_function=n % 5, n_lines=n)).alias("fortran"))


@query("""
WITH j AS (SELECT event_id, '{"a": {"b": [' || event_id || ', "x"], "e": {}}, "p": ' || props || '}' AS t FROM events)
SELECT event_id, unnest(['a.b[0]', 'a.b[1]', 'p.k']) AS path, unnest([t->>'$.a.b[0]', '"x"', t->>'$.p.k']) AS value FROM j""")
def json_leaves(t):
    j = F.concat(F.lit('{"a": {"b": ['), "event_id", F.lit(', "x"], "e": {}}, "p": '), "props", F.lit("}"))
    return t.events.select("event_id", F.explode(U.json_leaves(j)).alias("l")).select("event_id", "l.path", "l.value")


@query(r"""
WITH s AS (SELECT p_partkey AS unit, 'import a.b.C' || (p_size % 5) || '; x.y.z.call' || (p_size % 4) || '(1); if (q) { run(); }' AS text FROM part),
d AS (SELECT p_partkey AS unit, unnest(['a.b.C1', 'lib.call2', 'run', 'other.gone' || (p_size % 2)]) AS target FROM part),
r AS (SELECT DISTINCT unit, unnest(list_concat(regexp_extract_all(text, 'import\s+(?:static\s+)?([A-Za-z_][\w.]*)', 1), regexp_extract_all(text, '([A-Za-z_][\w.]*)\s*\(', 1))) AS ref FROM s),
k AS (SELECT *, regexp_extract(ref, '([^.]*)$', 1) AS last FROM r WHERE ref NOT IN ('if', 'for')), w AS (SELECT *, regexp_extract(target, '([^.]*)$', 1) AS last FROM d)
SELECT unit, target AS name, 'missing' AS status FROM w WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.unit = w.unit AND k.last = w.last)
UNION ALL SELECT unit, ref, 'extra' FROM k WHERE len(string_split(ref, '.')) >= 3 AND NOT EXISTS (SELECT 1 FROM w WHERE k.unit = w.unit AND k.last = w.last)""")
def dependency_report(t):
    size = F.col("p_size")
    s = t.part.select(F.col("p_partkey").alias("unit"), F.concat(F.lit("import a.b.C"), size % 5, F.lit("; x.y.z.call"), size % 4, F.lit("(1); if (q) { run(); }")).alias("text"))
    d = t.part.select(F.col("p_partkey").alias("unit"), F.explode(F.array(F.lit("a.b.C1"), F.lit("lib.call2"), F.lit("run"), F.concat(F.lit("other.gone"), size % 2))).alias("target"))
    return U.dependency_report(s, d)


@query("WITH a AS (SELECT conv_id AS node, turn AS n, role = 'assistant' AND conv_id % 3 <> 0 AS passed, role AS error FROM conversations), f AS (SELECT node, min(n) FILTER (WHERE passed) AS final FROM a GROUP BY 1) SELECT a.node, any_value(final) AS final, coalesce(string_agg(CASE WHEN final IS NULL THEN n || ':' || error END, ',' ORDER BY n), '') AS history FROM a JOIN f ON a.node = f.node GROUP BY 1")
def retry_history(t):
    a = t.conversations.select(F.col("conv_id").alias("node"), F.col("turn").alias("n"), ((F.col("role") == "assistant") & (F.col("conv_id") % 3 != 0)).alias("passed"), F.col("role").alias("error"))
    return U.retry_history(a).withColumn("history", F.array_join(F.transform("history", lambda x: F.concat(x["n"], F.lit(":"), x["error"])), ","))
