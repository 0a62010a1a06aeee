"""Change-data capture and observation queries over the event log."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import redact as R
from ..operators import cdc as C
from ..operators.graph import shared_dir
from ..operators.ordered import previous
from ..sources import observe as O
from ..sources import replication as W
from ..streaming.store import BucketStore
from .base import query


@query("SELECT event_id, upper(printf('%x/%x', n >> 32, n & 4294967295)) AS lsn, n AS number FROM (SELECT event_id, event_id * 8000000011 AS n FROM events)")
def lsn_round_trip(t):
    e = t.events.select("event_id", (F.col("event_id") * 8000000011).alias("n"))
    return e.select("event_id", C.lsn_text(F.col("n")).alias("lsn"), C.lsn_number(C.lsn_text(F.col("n"))).alias("number"))


EVENTS = "e AS (SELECT event_id, event_type AS tab, (event_id * 7919) % 10007 AS lsn, event_id % 3 AS seq FROM events)"


@query(f"WITH {EVENTS} SELECT event_id, tab, coalesce(lsn * 10 + seq > max(lsn * 10 + seq) OVER (PARTITION BY tab ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM e")
def cdc_dedupe_watermark(t):
    e = t.events.select("event_id", F.col("event_type").alias("tab"), ((F.col("event_id") * 7919) % 10007).alias("lsn"), (F.col("event_id") % 3).alias("seq"))
    return C.watermark(e, "tab", ["lsn", "seq"], "event_id").select("event_id", "tab", "fresh")


@query("""
WITH c AS (SELECT user_id AS k, event_id, ts, event_type, value, CASE WHEN event_type IN ('click','view') THEN 'U' WHEN event_type = 'error' THEN 'D' ELSE 'I' END AS op FROM events),
l AS (SELECT k, arg_max(op, event_id) AS op, arg_max(value, event_id) AS v FROM c GROUP BY k)
SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey NOT IN (SELECT k FROM l) UNION ALL SELECT k, v FROM l WHERE op <> 'D'""")
def cdc_apply_latest(t):
    op = F.when(F.col("event_type").isin("click", "view"), "U").when(F.col("event_type") == "error", "D").otherwise("I")
    changes = t.events.select(F.col("user_id").alias("k"), F.col("value").alias("v"), op.alias("op"), "event_id")
    return C.apply_changes(t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")), changes, "k", "op", ["event_id"])


@query("""
WITH c AS (SELECT user_id AS k, event_id, value, CASE WHEN event_type IN ('click','view') THEN 'U' WHEN event_type = 'error' THEN 'D' ELSE 'I' END AS op FROM events),
l AS (SELECT k, arg_max(op, event_id) AS op, arg_max(value, event_id) AS v FROM c GROUP BY k)
SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey NOT IN (SELECT k FROM l) UNION ALL SELECT k, v FROM l WHERE op <> 'D'""")
def cdc_bucketed_state(t):
    """The same changes, applied in four batches to a state in buckets, with the rows of ``customer`` as the first batch."""
    op = F.when(F.col("event_type").isin("click", "view"), "U").when(F.col("event_type") == "error", "D").otherwise("I")
    changes = t.events.select(F.col("user_id").alias("k"), F.col("value").alias("v"), op.alias("op"), F.col("event_id").cast("long").alias("seq"))
    first = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit("I").alias("op"), F.lit(-1).cast("long").alias("seq"))
    store = BucketStore(t.spark, f"{shared_dir(t.spark)}/state-{uuid.uuid4().hex}", ["k"], "op", ["seq"], buckets=16)
    for epoch, batch in enumerate([first, *[changes.where(F.pmod(F.xxhash64("seq"), F.lit(4)) == i) for i in range(4)]]):
        store.apply(batch, epoch)
    return store.current().select("k", "v")


@query("SELECT coalesce(CASE WHEN event_type = 'error' THEN 'unmapped_column' WHEN event_type = 'signup' THEN 'unknown_relation' WHEN value > 90 THEN 'schema_drift' END, 'apply') AS reason, count(*) AS n FROM events GROUP BY 1")
def cdc_classify(t):
    op = F.when(F.col("event_type") == "error", "T").otherwise("U")
    why = C.classify(op, F.col("event_type") != "signup", F.col("value"), F.when(F.col("value") <= 90, F.col("value")))
    return t.events.select(F.coalesce(why, F.lit("apply")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, greatest(0, event_id * 1000 - user_id * 5000) AS lag_bytes, greatest(0, event_id * 1000 - user_id * 5000) / 1000000.0 AS lag_seconds FROM events")
def lag_series(t):
    e = t.events.select("event_id", (F.col("event_id") * 1000).alias("w"), (F.col("user_id") * 5000).alias("a"))
    return C.lag_series(e, "w", "a").select("event_id", "lag_bytes", "lag_seconds")


@query("""
WITH e AS (SELECT event_type AS unit, event_id * 60 AS tick, event_id % 40 <> 39 AS good, event_id % 11 <> 5 AS parity FROM events),
i AS (SELECT *, sum(CASE WHEN good THEN 0 ELSE 1 END) OVER (PARTITION BY unit ORDER BY tick ROWS UNBOUNDED PRECEDING) AS isle FROM e),
s AS (SELECT *, min(CASE WHEN good AND parity THEN tick END) OVER (PARTITION BY unit, isle ORDER BY tick ROWS UNBOUNDED PRECEDING) AS start FROM i)
SELECT unit, tick, CASE WHEN NOT good THEN 'reset' WHEN NOT parity THEN 'investigate_divergence' WHEN tick - start >= 900 THEN 'operator_sign' ELSE 'wait' END AS action FROM s""")
def cutover_windows(t):
    e = t.events.select(F.col("event_type").alias("unit"), (F.col("event_id") * 60).alias("tick"), F.when(F.col("event_id") % 40 == 39, 100.0).otherwise(5.0).alias("lag"), F.lit(True).alias("up"), (F.col("event_id") % 11 != 5).alias("parity"))
    return C.cutover(e, "unit", "tick", "lag", "up", "parity")


@query("WITH b AS (SELECT c_custkey, CASE WHEN c_custkey % 29 = 0 THEN 'X' ELSE c_name END AS c_name, c_acctbal FROM customer WHERE c_custkey % 31 <> 0), j AS (SELECT a.c_custkey, b.c_custkey AS k, a.c_name IS DISTINCT FROM b.c_name OR a.c_acctbal IS DISTINCT FROM b.c_acctbal OR b.c_custkey IS NULL AS bad FROM customer a FULL JOIN b ON a.c_custkey = b.c_custkey) SELECT count(*) AS rows_compared, count(*) FILTER (WHERE bad) AS rows_diverged, round(count(*) FILTER (WHERE bad) / count(*), 6) AS divergence_rate FROM j")
def parity_metric(t):
    b = t.customer.where("c_custkey % 31 <> 0").withColumn("c_name", F.when(F.col("c_custkey") % 29 == 0, "X").otherwise(F.col("c_name")))
    return C.parity(t.customer, b, "c_custkey", ["c_name", "c_acctbal"])


@query("SELECT user_id, arg_max(greatest(0, least(100, CAST(floor(value) AS INTEGER) * 2 - 50)), event_id) AS weight, 100 - arg_max(greatest(0, least(100, CAST(floor(value) AS INTEGER) * 2 - 50)), event_id) AS legacy FROM events GROUP BY user_id")
def route_table_fold(t):
    e = t.events.select("user_id", "event_id", (F.floor("value").cast("int") * 2 - 50).alias("w"))
    return C.route_weights(e, "user_id", "w", "event_id")


@query("WITH l AS (SELECT event_type, event_id, lag(event_id) OVER (PARTITION BY event_type ORDER BY event_id) AS p FROM events) SELECT event_type, event_id, greatest(0, event_id - coalesce(p, 0)) AS delta FROM l")
def interval_deltas(t):
    e = previous(t.events.select("event_type", "event_id"), ["event_type"], ["event_id"], "event_id", "p")
    return e.select("event_type", "event_id", F.greatest(F.lit(0), F.col("event_id") - F.coalesce("p", F.lit(0))).alias("delta"))


@query("SELECT event_id FROM events WHERE event_id > (SELECT coalesce(max(event_id), -1) FROM events WHERE event_id = 500)")
def replay_after_id(t):
    at = t.events.where("event_id = 500").agg(F.coalesce(F.max("event_id"), F.lit(-1)).alias("at"))
    return t.events.select("event_id").join(at, F.col("event_id") > F.col("at")).select("event_id")


@query("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 200")
def ring_buffer(t):
    return t.events.select("event_id").orderBy(F.desc("event_id")).limit(200)


@query("SELECT user_id, count(*) FILTER (WHERE gap IS NULL OR gap > INTERVAL 120 SECOND) AS expired, count(*) AS n FROM (SELECT user_id, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) - ts AS gap FROM events) GROUP BY user_id")
def ttl_expiry(t):
    gap = F.unix_micros(F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    e = t.events.select("user_id", gap.alias("gap"))
    return e.groupBy("user_id").agg(F.count_if(F.expr("gap is null or gap > 120000000")).alias("expired"), F.count(F.lit(1)).alias("n"))


#: DuckDB's word boundaries know ASCII only, hence the letters spelt out, and the separator before a letter beyond it taken after the fact.
MAIL = r"\b[\p{L}\p{N}_.\-]+@[\p{L}\p{N}_.\-]+\.[\p{L}\p{N}_]+\b"


@query(rf"""SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{MAIL}', '<email>', 'g'), '\b\d{{3}}-\d{{2}}-\d{{4}}\b', '<ssn>', 'g'), '\b(?:\d[ -]?){{13,19}}\b', '<pan>', 'g'), '<pan>[ -]([À-ɏ])', '<pan>\1', 'g'), '\b\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\b', '<ipv4>', 'g')) END AS digest, regexp_matches(text, '{MAIL}') AS had_email FROM documents""")
def redact_pii(t):
    return t.documents.select("doc_id", F.md5(R.redact(F.col("text"))).alias("digest"), (F.contains("text", F.lit("@")) & F.col("text").rlike(R.PATTERNS[0][1])).alias("had_email"))


@query("SELECT user_id, CASE WHEN user_id % 4 = 0 THEN 'anthropic' WHEN user_id % 4 = 1 THEN 'google' WHEN user_id % 4 = 2 THEN 'openai' END AS provider, CASE WHEN user_id % 4 = 3 THEN 's****hort' ELSE substr(k, 1, 12) || '****...' || substr(k, length(k) - 3) END AS preview FROM (SELECT DISTINCT user_id, CASE user_id % 4 WHEN 0 THEN 'sk-ant-api03-' WHEN 1 THEN 'AIza' ELSE 'sk-proj-' END || repeat('aB3_', 9) || lpad(CAST(user_id AS VARCHAR), 6, '0') AS k FROM events)")
def credential_classify(t):
    u = t.events.select("user_id").distinct()
    head = F.when(F.col("user_id") % 4 == 0, "sk-ant-api03-").when(F.col("user_id") % 4 == 1, "AIza").otherwise("sk-proj-")
    k = F.when(F.col("user_id") % 4 == 3, "s-short").otherwise(F.concat(head, F.repeat(F.lit("aB3_"), 9), F.lpad(F.col("user_id").cast("string"), 6, "0")))
    u = u.withColumn("k", k)
    return u.select("user_id", R.credential(F.col("k")).alias("provider"), R.masked(F.col("k")).alias("preview"))


@query("SELECT CASE WHEN event_type = 'click' THEN 'http_request' WHEN event_type = 'purchase' THEN 'sql_query' WHEN event_type = 'view' THEN 'dns_lookup' ELSE 'process_exec' END AS kind, count(*) AS received, count(*) FILTER (WHERE value > 50) AS kept, count(*) FILTER (WHERE NOT value > 50) AS filtered FROM events GROUP BY 1")
def observe_counters(t):
    """Events as JSON lines of a collector, of which a label lets some through."""
    holds = F.when(F.col("event_type") == "click", "http_request").when(F.col("event_type") == "purchase", "sql").when(F.col("event_type") == "view", "dns").otherwise("process_exec")
    passes = F.when(F.col("value") > 50, "true").otherwise("false")
    lines = t.events.select(F.format_string('{"pod": {"name": "p%s", "labels": {"observe": "%s"}}, "%s": {"id": %s}}', F.col("user_id").cast("string"), passes, holds, F.col("event_id").cast("string")).alias("value"))
    return O.counters(O.json_lines(lines))


def order_messages(t):
    """All orders as replication messages of one slot: a transaction for each 100 keys, a description that gains a column, truncations."""
    o = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.round("o_totalprice").cast("long").alias("p"), F.col("o_orderpriority").alias("y"))
    key, status, price, more = (F.col(c).cast("string") for c in "kspy")
    late = F.col("k") >= 5000
    row = F.when(late, W.tuple_data([key, status, price, more])).otherwise(W.tuple_data([key, status, price]))
    old = F.when(late, W.tuple_data([key, F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")])).otherwise(W.tuple_data([key, F.lit(None).cast("string"), F.lit(None).cast("string")]))
    head = lambda c: F.concat(F.lit(c).cast("binary"), W.number(F.lit(7), 4))
    mark = lambda c: F.lit(c).cast("binary")
    change = F.when(F.col("k") % 10 == 0, F.concat(head("D"), mark("K"), old)).when(F.col("k") % 10 < 3, F.concat(head("U"), mark("O"), row, mark("N"), row)).otherwise(F.concat(head("I"), mark("N"), row))
    changes = o.select((F.col("k") * 16 + 8).alias("position"), change.alias("payload"))
    x = o.select(F.expr("k div 100").alias("x")).distinct()
    begins = x.select((F.col("x") * 1600 + 1).alias("position"), F.concat(mark("B"), W.number(F.col("x") * 1600 + 5000000000, 8), W.number(F.col("x"), 8), W.number(F.col("x") + 1, 4)).alias("payload"))
    cleared = x.where("x % 7 = 0").select((F.col("x") * 1600 + 3).alias("position"), F.concat(mark("T"), W.number(F.lit(2), 4), W.number(F.lit(0), 1), W.number(F.lit(7), 4), W.number(F.lit(9), 4)).alias("payload"))
    columns = [("k", 20, True), ("s", 25, False), ("p", 20, False), ("y", 25, False)]
    described = t.spark.createDataFrame([(0, W.relation_message(7, "public", "orders", columns[:3])), (50 * 1600 + 2, W.relation_message(7, "public", "orders", columns))], "position long, payload binary")
    return changes.union(begins).union(cleared).union(described).select(F.lit("main").alias("slot"), "position", "payload")


@query("""
WITH e AS (SELECT o_orderkey * 16 + 8 AS position, o_orderkey // 100 AS x, CASE WHEN o_orderkey % 10 = 0 THEN 'D' WHEN o_orderkey % 10 < 3 THEN 'U' ELSE 'I' END AS op, o_orderkey AS k, o_orderstatus AS s, CAST(round(o_totalprice) AS BIGINT) AS p, CASE WHEN o_orderkey >= 5000 THEN o_orderpriority END AS y FROM orders
  UNION ALL SELECT DISTINCT (o_orderkey // 100) * 1600 + 3, o_orderkey // 100, 'T', NULL, NULL, NULL, NULL FROM orders WHERE o_orderkey // 100 % 7 = 0)
SELECT position, op, 'orders' AS table_name, upper(printf('%x/%x', (x * 1600 + 5000000000) >> 32, (x * 1600 + 5000000000) & 4294967295)) AS lsn, x + 1 AS xid, row_number() OVER (PARTITION BY x ORDER BY position) - 1 AS seq,
  k, CASE WHEN op <> 'D' THEN s END AS status, CASE WHEN op <> 'D' THEN p END AS price, CASE WHEN op <> 'D' THEN y END AS priority, CASE WHEN op = 'U' THEN s END AS old_status FROM e""")
def wal_decode(t):
    """Replication messages of all orders, decoded side by side."""
    d = W.decoded(order_messages(t))
    field = lambda image, c: F.get_json_object(image, f"$.{c}")
    k = F.coalesce(field("after", "k"), field("before", "k")).cast("long")
    return d.select("position", "op", "table_name", "lsn", "xid", "seq", k.alias("k"), field("after", "s").alias("status"), field("after", "p").cast("long").alias("price"), field("after", "y").alias("priority"), field("before", "s").alias("old_status"))
