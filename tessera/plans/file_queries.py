"""Files, findings and routing over the tables: documents stand for files, events for calls and commits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import files as W
from ..operators import findings as X
from ..operators import ops as O
from ..operators import patterns as P
from ..operators.ordered import previous
from .base import query


@query("""
WITH w AS (SELECT doc_id, md5(text) AS d, n_chars AS m FROM documents WHERE doc_id % 13 <> 0),
k AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE md5(text) END AS d, CASE WHEN doc_id % 7 = 0 THEN n_chars + 0.5 ELSE n_chars END AS m FROM documents WHERE doc_id % 11 <> 0)
SELECT coalesce(w.doc_id, k.doc_id) AS path, CASE WHEN w.doc_id IS NULL THEN 'stale' WHEN k.doc_id IS NULL THEN 'new' WHEN w.d IS NOT DISTINCT FROM k.d AND abs(w.m - k.m) < 1e-6 THEN 'cached' ELSE 'changed' END AS status FROM w FULL JOIN k ON w.doc_id = k.doc_id""")
def file_changes(t):
    d = t.documents.select(F.col("doc_id").alias("path"), F.md5("text").alias("digest"), F.col("n_chars").cast("double").alias("mtime"))
    old = d.where("path % 11 <> 0").select("path", F.when(F.col("path") % 5 == 0, "old").otherwise(F.col("digest")).alias("digest"), F.when(F.col("path") % 7 == 0, F.col("mtime") + 0.5).otherwise(F.col("mtime")).alias("mtime"))
    return W.file_changes(d.where("path % 13 <> 0"), old)


@query("WITH m AS (SELECT n_name AS key, CAST(n_regionkey AS VARCHAR) AS value FROM nation), w AS (SELECT unnest(['NATION_1', 'NATION_2', 'NATION_3', 'gone']) AS key, unnest(['1', '9', '3', '0']) AS expected) SELECT w.key, CASE WHEN value IS NULL THEN 'missing' ELSE 'changed' END AS reason FROM w LEFT JOIN m ON w.key = m.key WHERE value IS NULL OR value <> expected")
def rebuild_reasons(t):
    meta = t.nation.select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    return W.rebuild_reasons(meta, {"NATION_1": "1", "NATION_2": "9", "NATION_3": "3", "gone": "0"})


PATHS = "p AS (SELECT page_id, regexp_replace(url, '^https?://[^/]+', '') AS path FROM pages)"


def paths(t):
    return t.pages.select("page_id", F.regexp_replace("url", "^https?://[^/]+", "").alias("path"))


@query(f"WITH {PATHS} SELECT page_id, path = '/fr' OR starts_with(path, '/fr/') OR path = '/de' OR starts_with(path, '/de/') AS allowed FROM p")
def path_allowed(t):
    return paths(t).select("page_id", W.under_roots(F.col("path"), ["/fr/", "/de"]).alias("allowed"))


@query(f"WITH {PATHS}, s AS (SELECT page_id, CASE WHEN path = '/fr' OR starts_with(path, '/fr/') THEN CASE WHEN len(string_split(substr(path, 5), '/')) = 1 THEN 'HIGH' ELSE 'MEDIUM' END WHEN path = '/de' OR starts_with(path, '/de/') THEN 'LOW' ELSE 'HIGH' END AS severity FROM p) SELECT page_id, severity, CASE severity WHEN 'HIGH' THEN 18 WHEN 'MEDIUM' THEN 12 ELSE 6 END AS score FROM s")
def path_severity(t):
    s = W.path_severity(F.col("path"), "/fr", "/de")
    return paths(t).select("page_id", s.alias("severity"), W.path_score(s).alias("score"))


@query("SELECT lang, CASE max(CASE source WHEN 'src0' THEN 1 WHEN 'src1' THEN 2 ELSE 3 END) WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' ELSE 'HIGH' END AS worst FROM documents GROUP BY lang")
def worst_severity(t):
    s = F.when(F.col("source") == "src0", "LOW").when(F.col("source") == "src1", "MEDIUM").otherwise("HIGH")
    return t.documents.groupBy("lang").agg(W.worst_severity(s).alias("worst"))


@query("WITH e AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  .PY' WHEN 3 THEN 'Rs' ELSE '?' END AS raw FROM part) SELECT p_partkey, CASE WHEN coalesce(raw, '') = '' THEN '?' WHEN starts_with(ltrim(raw), '.') OR ltrim(raw) = '?' THEN lower(ltrim(raw)) ELSE '.' || lower(ltrim(raw)) END AS ext FROM e")
def extension_normalise(t):
    k = F.col("p_partkey") % 5
    raw = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, "").when(k == 2, "  .PY").when(k == 3, "Rs").otherwise("?")
    return t.part.select("p_partkey", W.extension(raw).alias("ext"))


@query("WITH e AS (SELECT DISTINCT '.' || lower(p_brand) AS ext FROM part WHERE p_brand <> 'Brand#3') SELECT ext FROM e ORDER BY ext LIMIT 3")
def unknown_extensions_top3(t):
    known = t.spark.createDataFrame([(".brand#3",)], "ext string")
    seen = t.part.select(W.extension(F.col("p_brand")).alias("ext")).distinct()
    return seen.join(known, "ext", "left_anti").orderBy("ext").limit(3)


@query("SELECT page_id, CASE WHEN starts_with(url, 'http://t') THEN 'ignored' WHEN ends_with(url, '.d.ts') THEN 'declaration' WHEN length(html) > 4000 THEN 'too_large' END AS skipped FROM pages")
def walk_skips(t):
    return t.pages.select("page_id", W.ignored(F.col("url"), ["http://t"], F.length("html"), 4000).alias("skipped"))


@query("SELECT page_id, url FROM pages WHERE page_id BETWEEN 10 AND 700 ORDER BY page_id DESC LIMIT 500")
def mtime_range_feed(t):
    """Entries between two times, newest first, at most 500 whatever is asked for."""
    return O.feed(t.pages.select("page_id", "url"), "page_id", since=10, until=700, limit=10_000)


@query("SELECT event_id, event_type, ts FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 20")
def mutation_feed(t):
    return O.feed(t.events.select("event_id", "event_type", "ts"), "ts", equal={"event_type": "click"}, limit=20, tie="event_id")


@query("SELECT event_id FROM events WHERE CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_type END IS NULL OR event_type IN ('click', 'view')")
def namespace_gate(t):
    ns = F.when(F.col("event_id") % 9 != 0, F.col("event_type"))
    return t.events.where(O.allowed(ns, ["click", "view"])).select("event_id")


FINDINGS = "f AS (SELECT l_orderkey AS id, l_linenumber AS line, CASE l_returnflag WHEN 'A' THEN 'memory_pathology' WHEN 'N' THEN 'pbt' ELSE '' END AS kind, CASE WHEN l_linenumber = 2 THEN 'filesystem_hygiene' ELSE '' END AS dimension, CASE WHEN l_linestatus = 'F' THEN 'fuzz' ELSE '' END AS runner, 'f' || l_suppkey AS function, l_quantity AS score FROM lineitem)"


def findings(t):
    k = F.when(F.col("l_returnflag") == "A", "memory_pathology").when(F.col("l_returnflag") == "N", "pbt").otherwise("")
    return t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), k.alias("kind"), F.when(F.col("l_linenumber") == 2, "filesystem_hygiene").otherwise("").alias("dimension"), F.when(F.col("l_linestatus") == "F", "fuzz").otherwise("").alias("runner"), F.concat(F.lit("f"), "l_suppkey").alias("function"), F.col("l_quantity").alias("score"))


@query(f"WITH {FINDINGS} SELECT id, line, CASE WHEN kind = 'memory_pathology' THEN 'find_bugs.memory_pathology' WHEN dimension = 'filesystem_hygiene' THEN 'find_bugs.filesystem_hygiene' WHEN runner <> '' THEN 'find_bugs.layer6.' || runner WHEN kind <> '' THEN 'find_bugs.' || kind ELSE 'find_bugs.pbt_failure' END || '#' || function AS rule, CASE WHEN dimension = 'filesystem_hygiene' THEN dimension WHEN kind <> '' THEN kind ELSE 'pbt_failure' END AS bug_class FROM f")
def finding_rules(t):
    c = [F.col(x) for x in ("kind", "dimension", "runner", "function")]
    return findings(t).select("id", "line", X.rule_id(*c).alias("rule"), X.bug_class(c[0], c[1]).alias("bug_class"))


@query("SELECT o_totalprice AS score, o_orderpriority AS file, o_orderkey AS function FROM orders ORDER BY score DESC, file, function LIMIT 25")
def findings_ranked(t):
    return X.ranked(t.orders.select(F.col("o_totalprice").alias("score"), F.col("o_orderpriority").alias("file"), F.col("o_orderkey").alias("function")), 25)


@query("WITH n AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'anonymous_' || p_partkey WHEN 1 THEN ' node_' || p_partkey WHEN 2 THEN '  ' WHEN 3 THEN 'node_x' ELSE p_name END AS n FROM part) SELECT p_partkey, p_partkey % 5 < 3 AS synthetic FROM n")
def synthetic_names(t):
    k = F.col("p_partkey") % 5
    n = F.when(k == 0, F.concat(F.lit("anonymous_"), "p_partkey")).when(k == 1, F.concat(F.lit(" node_"), "p_partkey")).when(k == 2, "  ").when(k == 3, "node_x").otherwise(F.col("p_name"))
    return t.part.select("p_partkey", X.synthetic_name(n).alias("synthetic"))


@query("SELECT o_custkey, o_orderpriority AS gate, count(*) FILTER (WHERE o_orderstatus = 'F') AS errors, min(CASE WHEN o_orderstatus = 'F' THEN 'order ' || o_orderkey END) AS first_error, count(*) FILTER (WHERE o_orderstatus = 'F') = 0 AS passed FROM orders GROUP BY 1, 2")
def gate_results(t):
    checks = t.orders.select("o_custkey", F.col("o_orderpriority").alias("gate"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("order "), "o_orderkey")).alias("error"))
    return X.gate_results(checks, ["o_custkey"])


TYPES = "c AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'int' WHEN 'view' THEN 'str' WHEN 'error' THEN 'NoneType' WHEN 'purchase' THEN 'int64' ELSE 'float' END AS name, event_id FROM events)"


def type_counts(t):
    n = F.when(F.col("event_type") == "click", "int").when(F.col("event_type") == "view", "str").when(F.col("event_type") == "error", "NoneType").when(F.col("event_type") == "purchase", "int64").otherwise("float")
    return t.events.groupBy("user_id", n.alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TYPES} SELECT user_id, name, count(*) AS n FROM c GROUP BY 1, 2")
def literal_type_counts(t):
    return type_counts(t)


@query(f"WITH {TYPES}, g AS (SELECT user_id, name, count(*) AS n FROM c GROUP BY 1, 2), k AS (SELECT *, CASE WHEN name LIKE 'int%' THEN 'int' WHEN name = 'str' THEN 'str' WHEN name = 'NoneType' THEN 'none' END AS cls FROM g), m AS (SELECT user_id, cls, min(struct_pack(d := -n, name := name)) AS first FROM k WHERE cls IS NOT NULL GROUP BY 1, 2) SELECT user_id, string_agg(cls, ',' ORDER BY first) AS preference FROM m GROUP BY 1")
def type_preferences(t):
    return X.type_preferences(type_counts(t), ["user_id"]).select("user_id", F.array_join("preference", ",").alias("preference"))


@query("""
WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN ['b', 'x', 'a'] END AS agent, CASE WHEN c_custkey % 3 = 0 THEN ['c', 'b'] END AS task, CASE WHEN c_custkey % 10 = 0 THEN 'c' WHEN c_custkey % 10 = 1 THEN 'nope' END AS o FROM customer),
h AS (SELECT c_custkey, CASE WHEN o IN ('a', 'b', 'c') THEN [o] ELSE list_filter(coalesce(agent, task, ['a', 'b', 'c']), lambda p: p IN ('a', 'b', 'c')) END AS chain FROM r)
SELECT c_custkey, array_to_string(list_filter(chain, lambda p: p <> 'b'), ',') AS chain, array_to_string(list_filter(chain, lambda p: p = 'b'), ',') AS skipped FROM h""")
def routing_chain(t):
    k = F.col("c_custkey")
    lists = lambda *x: F.array(*map(F.lit, x))
    agent, task = F.when(k % 4 == 0, lists("b", "x", "a")), F.when(k % 3 == 0, lists("c", "b"))
    over = F.when(k % 10 == 0, "c").when(k % 10 == 1, "nope")
    healthy = F.create_map(F.lit("b"), F.lit(False), F.lit("a"), F.lit(True))
    r = X.routing_chain(agent, task, lists("a", "b", "c"), over, ["a", "b", "c"], healthy)
    return t.customer.select("c_custkey", F.array_join(r["chain"], ",").alias("chain"), F.array_join(r["skipped"], ",").alias("skipped"))


@query("SELECT user_id, event_type, ts, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type) AS INTEGER) AS place FROM (SELECT user_id, event_type, max(ts) AS ts FROM events GROUP BY 1, 2) QUALIFY place <= 3")
def recent_items(t):
    return X.recent(t.events, ["user_id"], "event_type", "ts", 3)


@query("SELECT user_id, event_type, min(event_id) AS since FROM events GROUP BY 1, 2")
def accumulated_set(t):
    return X.first_seen(t.events, ["user_id"], "event_type", "event_id")


@query("""
WITH p AS (SELECT lang AS grammar, count(*) AS files, sum(n_chars % 10 / 10.0) AS quality FROM documents WHERE lang IS NOT NULL GROUP BY 1),
a AS (SELECT lang AS grammar, count(*) AS active_patterns FROM documents WHERE doc_id % 17 = 0 GROUP BY 1),
m AS (SELECT lang AS grammar, count(*) FILTER (WHERE doc_id >= 600) AS recent_mutations, arg_max(CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE ' ' || source || ' ' END, doc_id) AS r FROM documents GROUP BY 1)
SELECT p.grammar, files AS files_parsed, round(quality / files, 3) AS avg_quality, coalesce(active_patterns, 0) AS active_patterns, coalesce(recent_mutations, 0) AS recent_mutations, nullif(trim(r), '') AS last_receipt FROM p LEFT JOIN a ON a.grammar = p.grammar LEFT JOIN m ON m.grammar = p.grammar""")
def grammar_status(t):
    d = t.documents.select(F.col("lang").alias("grammar"), "doc_id", "source", (F.col("n_chars") % 10 / 10.0).alias("quality"))
    profile = X.accumulate_profile(d.limit(0).select("grammar", F.lit(0).cast("long").alias("files"), "quality"), d.where("grammar is not null"))
    mutations = d.select("grammar", F.col("doc_id").alias("observed_at"), F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "source", F.lit(" "))).alias("receipt"))
    return X.grammar_status(profile, d.where("doc_id % 17 = 0"), mutations, F.lit(600))


@query("""
WITH n AS (SELECT lang || source AS owner, split_part(text, ' ', 1) AS name, doc_id AS place FROM documents WHERE length(split_part(text, ' ', 1)) BETWEEN 3 AND 20),
m AS (SELECT owner, name, min(place) AS place FROM n WHERE regexp_matches(lower(name), '[a-z0-9_]') AND owner IS NOT NULL GROUP BY 1, 2)
SELECT owner, item_id AS path, arg_min(name, struct_pack(a := place, b := name)) AS name FROM m JOIN benchmark b ON contains(lower(b.text), lower(name)) GROUP BY 1, 2""")
def contained_names(t):
    first = F.split("text", " ")[0]
    n = t.documents.select(F.concat("lang", "source").alias("owner"), first.alias("name"), F.col("doc_id").alias("place")).where(F.length("name").between(3, 20) & F.col("owner").isNotNull())
    n = n.where(F.lower("name").rlike("[a-z0-9_]")).groupBy("owner", "name").agg(F.min("place").alias("place"))
    return P.contained_names(n, t.benchmark.select(F.col("item_id").alias("path"), "text"))


ITEM_WORDS = "w AS (SELECT item_id AS owner, unnest(l) AS name, unnest(range(1, len(l) + 1)) AS place FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z]{5,}') AS l FROM benchmark))"
SOURCE_FILES = "f AS (SELECT 'src/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.tsx' ELSE '.md' END AS path, text FROM documents)"


def item_words(t):
    """The longer words of each item, in order."""
    words = F.regexp_extract_all("text", F.lit("([A-Za-z]{5,})"))
    return t.benchmark.select(F.col("item_id").alias("owner"), F.posexplode(words).alias("place", "name"))


def files(t):
    end = F.element_at(F.array(*map(F.lit, (".py", ".ts", ".tsx", ".md"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return t.documents.select(F.concat(F.lit("src/"), "doc_id", end).alias("path"), "text")


@query(f"""
WITH {ITEM_WORDS}, {SOURCE_FILES}, v AS (SELECT owner, name FROM w QUALIFY row_number() OVER (PARTITION BY owner ORDER BY place) <= 20 UNION SELECT DISTINCT owner, unnest(['os.environ', 'os.getenv', 'process.env.', 'settings.', 'config.']) FROM w),
h AS (SELECT name, path FROM (SELECT DISTINCT name FROM v) JOIN f ON path NOT LIKE '%.md' AND contains(text, name))
SELECT DISTINCT owner, path FROM v JOIN h USING (name)""")
def env_consumers(t):
    """Files that name one of an item's first twenty words, as if these were variables of an environment."""
    return P.environment_consumers(item_words(t), files(t))


@query(f"""
WITH {ITEM_WORDS}, {SOURCE_FILES}, r AS (SELECT DISTINCT name, name || '[^A-Za-z]+([A-Za-z]+[^A-Za-z]+){{0,2}}' || after AS pattern FROM (SELECT name, lead(name) OVER (PARTITION BY owner ORDER BY place) AS after FROM w) WHERE after IS NOT NULL)
SELECT name || ' ' || pattern AS rule, path FROM r JOIN f ON contains(text, name) AND regexp_matches(text, pattern)""")
def pattern_consumers(t):
    """Files in which a longer word of an item is closely followed by the item's next one: thousands of patterns."""
    w = previous(item_words(t).withColumn("back", -F.col("place")), ["owner"], ["back"], "name", "after").where("after is not null")
    r = w.select("name", F.concat("name", F.lit("[^A-Za-z]+([A-Za-z]+[^A-Za-z]+){0,2}"), "after").alias("pattern")).distinct()
    return P.matches(r.select(F.concat_ws(" ", "name", "pattern").alias("rule"), "name", "pattern"), files(t))


@query("""
WITH c AS (SELECT 'o' || l_orderkey AS source, 'p' || l_partkey AS target, min(l_linenumber) AS place FROM lineitem GROUP BY 1, 2),
r AS (SELECT source, target FROM c QUALIFY row_number() OVER (PARTITION BY target ORDER BY place, source) <= 120),
l AS (SELECT 'o' || l_orderkey AS source, 'p' || l_partkey AS target, unnest([0, 1, 2]) AS place, unnest([CASE WHEN l_quantity > 25 THEN 'int' ELSE 'float' END, l_returnflag, CASE WHEN l_linenumber = 1 THEN NULL ELSE 'str' END]) AS kind FROM lineitem)
SELECT target, place, coalesce(kind, 'None') AS kind, count(*) AS n FROM l JOIN r USING (source, target) GROUP BY 1, 2, 3""")
def caller_literal_kinds(t):
    i = t.lineitem.select(F.concat(F.lit("o"), "l_orderkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), "l_linenumber", "l_quantity", "l_returnflag")
    calls = i.groupBy("source", "target").agg(F.min("l_linenumber").alias("at"))
    kinds = F.array(F.when(F.col("l_quantity") > 25, "int").otherwise("float"), "l_returnflag", F.when(F.col("l_linenumber") != 1, "str"))
    literals = i.select(F.col("source").alias("caller"), F.col("target").alias("callee"), F.posexplode(kinds).alias("place", "kind"))
    return P.caller_literals(calls, literals)


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[A-Z]{4,}!!') THEN 'shout' WHEN regexp_matches(text, '\\|[^|]*\\|') THEN 'table' END AS kind FROM documents WHERE regexp_matches(text, '[A-Z]{4,}!!|\\|[^|]*\\|')")
def regex_consumers(t):
    """Texts that match one of several patterns, with the first that they match."""
    return O.first_match(t.documents.select("doc_id", "text"), "text", [("shout", "[A-Z]{4,}!!"), ("table", r"\|[^|]*\|")]).select("doc_id", "kind")


@query("""
WITH e AS (SELECT user_id AS path, event_id AS seq, sum(CASE WHEN event_type = 'error' THEN -40 ELSE CAST(floor(value) AS INTEGER) END) OVER w AS s, first_value(event_type) OVER w AS author FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
c AS (SELECT seq, 'd' || (path % 5) || '/f' || path AS path, author, s - least(0, min(s) OVER (PARTITION BY path ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS lines, lead(seq) OVER (PARTITION BY path ORDER BY seq) AS nxt FROM e),
n AS (SELECT event_id AS now FROM events WHERE event_id % greatest(1, (SELECT count(*) FROM events) // 100) = 0 OR event_id = (SELECT count(*) FROM events) - 1)
SELECT now AS commit, split_part(path, '/', 1) AS directory, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, array_to_string(list_sort(list(DISTINCT author)), ',') AS authors FROM c JOIN n ON seq <= now AND now < coalesce(nxt, 1000000000000) WHERE lines > 0 GROUP BY 1, 2""")
def commit_timeline(t):
    e = t.events.select(F.col("user_id").alias("u"), F.col("event_id").alias("at"), F.when(F.col("event_type") == "error", -40).otherwise(F.floor("value").cast("int")).alias("d"), "event_type")
    c = O.clamped_sum(e, ["u"], ["at"], "d", "lines")
    author = t.events.groupBy(F.col("user_id").alias("u")).agg(F.min_by("event_type", "event_id").alias("author"))
    c = c.join(author, "u").select("at", F.format_string("d%d/f%d", F.col("u") % 5, F.col("u")).alias("path"), "lines", "author")
    out = X.timeline(c, t.events.select(F.col("event_id").alias("commit"), F.col("event_id").alias("at")))
    return out.withColumn("authors", F.array_join("authors", ","))


@query("WITH l AS (SELECT * FROM events ORDER BY event_id DESC LIMIT 1000) SELECT count(*) AS calls, count(*) FILTER (WHERE event_type <> 'error') AS successes, count(*) FILTER (WHERE event_type = 'error') AS failures, round(sum(value), 6) AS total_cost FROM l")
def telemetry_totals(t):
    last = t.events.orderBy(F.desc("event_id")).limit(1000)
    return last.agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("event_type") != "error").alias("successes"), F.count_if(F.col("event_type") == "error").alias("failures"), F.round(F.sum("value"), 6).alias("total_cost"))


@query("SELECT s_name AS name, s_acctbal * 1000 AS cumulative_ms, s_nationkey AS calls, s_acctbal * 1000 / greatest(1, s_nationkey) AS avg_ms FROM supplier ORDER BY s_acctbal DESC, s_name LIMIT 5")
def hot_generators(t):
    r = t.supplier.select(F.col("s_name").alias("name"), (F.col("s_acctbal") * 1000).alias("cumulative_ms"), F.col("s_nationkey").alias("calls")).orderBy(F.desc("cumulative_ms"), "name").limit(5)
    return r.withColumn("avg_ms", F.col("cumulative_ms") / F.greatest(F.lit(1), F.col("calls")))


@query("SELECT CAST(sum(floor(CASE WHEN o_orderkey % 60 <= 3 AND o_orderkey % 8 = 0 AND o_custkey % 12 <= 2 THEN 25 WHEN o_orderkey % 60 > 50 OR o_orderkey % 8 > 5 OR o_custkey % 12 > 10 THEN 200 ELSE 100 END * CASE WHEN o_orderstatus = 'O' THEN 1.5 ELSE 1.0 END)) AS BIGINT) AS examples FROM orders")
def test_budget_total(t):
    b = O.test_budget(F.col("o_orderkey") % 60, F.col("o_orderkey") % 8, F.col("o_custkey") % 12, F.col("o_orderstatus") == "O")
    return t.orders.agg(F.sum(b).alias("examples"))


test_budget_total.__test__ = False
