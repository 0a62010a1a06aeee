"""Transformers, bulk import, matching and provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fallback as B
from ..functions import transform as T
from ..operators import matching as M
from ..operators import provenance as H
from .base import merkle_sql, query


@query("SELECT c_custkey, upper(c_name) || '-' || substr(c_mktsegment, 1, 3) AS a, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 5000 THEN 'rich' ELSE 'even' END AS b, c_custkey - 7 * floor(c_custkey / 7) AS m FROM customer")
def transform_compiled(t):
    a = T.compile_transformer("def transform(v):\n    return v.upper() + '-'", F.col("c_name"))
    s = T.compile_transformer("def transform(v):\n    return v[0:3]", F.col("c_mktsegment"))
    b = T.compile_transformer("def transform(v):\n    if v < 0:\n        return 'debt'\n    x = v - 5000\n    return 'rich' if x > 0 else 'even'", F.col("c_acctbal"))
    m = T.compile_transformer("def transform(v):\n    return v % 7", F.col("c_custkey"))
    return t.customer.select("c_custkey", F.concat(a, s).alias("a"), b.alias("b"), m.cast("double").alias("m"))


@query("""SELECT o_orderkey, trim('  ' || o_orderstatus || ' ') AS strip, lower(trim(' ' || o_orderpriority)) AS email_lower, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END AS sentinel_to_null,
 CAST(round(CAST(o_totalprice AS DECIMAL(38,10)), 2) AS DOUBLE) AS decimal_2dp, CAST(o_custkey AS BIGINT) AS int_widen, CASE WHEN o_custkey * 3000000 <= 2147483647 THEN CAST(o_custkey * 3000000 AS INTEGER) END AS int_narrow,
 o_orderkey % 2 = 1 AS to_bool, regexp_replace(o_orderpriority, '[^0-9]', '', 'g') AS digits_only FROM orders""")
def transform_sketches(t):
    S = T.SKETCHES
    return t.orders.select("o_orderkey", S["strip"](F.concat(F.lit("  "), "o_orderstatus", F.lit(" "))).alias("strip"), S["email_lower"](F.concat(F.lit(" "), "o_orderpriority")).alias("email_lower"), S["sentinel_to_null"](F.when(F.col("o_orderstatus") == "O", "N/A").otherwise(F.col("o_orderstatus"))).alias("sentinel_to_null"), S["decimal_2dp"](F.col("o_totalprice")).cast("double").alias("decimal_2dp"), S["int_widen"](F.col("o_custkey")).alias("int_widen"), S["int_narrow"](F.col("o_custkey") * 3000000).alias("int_narrow"), S["to_bool"](F.col("o_orderkey") % 2).alias("to_bool"), S["digits_only"](F.col("o_orderpriority")).alias("digits_only"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE lower(o_orderstatus) END AS v FROM orders")
def sql_case_tier(t):
    return t.orders.select("o_orderkey", T.sql_case("CASE WHEN legacy_col = 'F' THEN 'done' ELSE lower(legacy_col) END", "o_orderstatus").alias("v"))


@query("WITH b AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 5000 AS batch_no FROM orders) SELECT batch_no, count(*) AS n, sha256('m1|orders|' || batch_no) AS batch_id, min(o_orderkey) AS first FROM b GROUP BY batch_no")
def bulk_batches(t):
    b = T.batch_numbers(t.orders.select("o_orderkey"), "o_orderkey", 5000)
    return b.groupBy("batch_no").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first")).withColumn("batch_id", T.batch_id("m1", "orders", F.col("batch_no")))


SPLIT = "q AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 45 THEN NULL ELSE l_suppkey END AS s, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_partkey END AS p, l_partkey FROM lineitem), r AS (SELECT *, CASE WHEN s IS NULL THEN 'target_constraint_violation' WHEN l_partkey IS NOT NULL AND p IS NULL THEN 'transform_error' END AS reason FROM q)"


def split(t):
    q = t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") <= 45, F.col("l_suppkey")).alias("s"), F.when(F.col("l_linenumber") != 7, F.col("l_partkey")).alias("p"), "l_partkey")
    return T.quarantine_split(q, T.Rules(not_null=("s",), failed=(("l_partkey", "p"),)))


@query(f"WITH {SPLIT} SELECT l_orderkey, l_linenumber, reason FROM r WHERE reason IS NOT NULL")
def bulk_quarantine_split(t):
    return split(t).where("reason is not null").select("l_orderkey", "l_linenumber", "reason")


@query(f"WITH {SPLIT} SELECT l_orderkey % 10 AS batch, count(*) AS rows_read, count(*) FILTER (WHERE reason IS NULL) AS written, count(reason) AS quarantined, true AS conserved FROM r GROUP BY 1")
def bulk_conservation(t):
    g = split(t).groupBy((F.col("l_orderkey") % 10).alias("batch")).agg(F.count(F.lit(1)).alias("rows_read"), F.count_if(F.col("reason").isNull()).alias("written"), F.count("reason").alias("quarantined"))
    return g.withColumn("conserved", F.col("rows_read") == F.col("written") + F.col("quarantined"))


EMB = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.vec_id AS legacy, b.vec_id AS target, list_cosine_similarity(a.v, b.v) AS sim FROM e a JOIN e b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1), k AS (SELECT *, row_number() OVER (PARTITION BY legacy ORDER BY sim DESC, target) AS rank FROM p)"


@query(f"WITH {EMB} SELECT legacy, CAST(rank AS INTEGER) AS rank, target, round(sim, 6) AS sim FROM k WHERE rank <= 3")
def embedding_top3(t):
    """The three most similar target columns (odd ids) for each legacy column (even ids): the two sides of a mapping."""
    return candidates(t, 3)


def candidates(t, k, digits=6):
    e = t.embeddings.select("vec_id", "embedding")
    return M.top_candidates(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1"), "vec_id", "embedding", k, digits)


@query(f"WITH {EMB}, s AS (SELECT legacy, max(sim) FILTER (WHERE rank = 1) AS a, max(sim) FILTER (WHERE rank = 2) AS b FROM k GROUP BY legacy) SELECT legacy, CASE WHEN a < 0.6 THEN 'no_match' WHEN a - b < 0.05 THEN 'ambiguous' WHEN a >= 0.85 THEN 'ok' ELSE 'low_confidence' END AS status FROM s")
def mapping_status(t):
    """What the best two similarities of a legacy column say, which are not rounded for it."""
    top = candidates(t, 2, None)
    a = F.max(F.when(F.col("rank") == 1, F.col("sim")))
    b = F.max(F.when(F.col("rank") == 2, F.col("sim")))
    return top.groupBy("legacy").agg(M.status(a, b).alias("status"))


@query()
def assignment(t):
    """One-to-one mapping of largest total similarity within each pair of tables (here 100 ids: 50 columns each), side by side."""
    e = t.embeddings.select(F.expr("vec_id div 100").alias("pair"), "vec_id", "embedding", (F.col("vec_id") % 100 < 50).alias("legacy"))
    return M.assignments(e, "pair", "vec_id", "embedding", "legacy")


@query("SELECT sha256('m1|orders|' || (o_orderkey // 500)) AS batch_id, o_orderkey FROM orders")
def batch_digest(t):
    return t.orders.select(T.batch_id("m1", "orders", F.expr("o_orderkey div 500")).alias("batch_id"), "o_orderkey")


@query(merkle_sql("""SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, '{"k":' || o_orderkey || ',"n":"' || o_orderpriority || '"}' AS c FROM orders""", 20))
def merkle_root(t):
    leaves = t.orders.select("o_orderkey", H.canonical([("k", "o_orderkey"), ("n", "o_orderpriority")]).alias("c"))
    return H.merkle_root(leaves, "o_orderkey", "c")


@query("WITH RECURSIVE l AS (SELECT o_custkey AS g, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderpriority AS v FROM orders), c AS (SELECT g, CAST(0 AS BIGINT) AS i, 'GENESIS' AS h FROM (SELECT DISTINCT g FROM l) UNION ALL SELECT l.g, l.i, sha256(c.h || l.v) FROM c JOIN l ON l.g = c.g AND l.i = c.i + 1) SELECT g AS o_custkey, arg_max(h, i) AS head FROM c GROUP BY g")
def hash_chain(t):
    """A chain of receipts for each customer: sequential by nature within one, side by side over them."""
    return H.chain_head(t.orders.select("o_custkey", "o_orderkey", "o_orderpriority"), ["o_custkey"], "o_orderkey", "o_orderpriority")


@query("""
WITH o AS (SELECT o_orderkey, o_orderpriority, CAST(left(o_orderpriority, 1) AS INTEGER) - 3 AS d, split_part(o_orderpriority, '-', 2) AS rest FROM orders)
SELECT o_orderkey, CASE WHEN d <> 0 THEN array_to_string(list_transform(range(1, len(rest) + 1, 2), lambda i: substr(rest, CAST(i AS INTEGER), 1)), '') || CAST(CAST(floor(10.0 / d) AS INTEGER) AS VARCHAR) END AS value, CASE WHEN d = 0 THEN 'transform_error' END AS reason FROM o""")
def transform_fallback(t):
    """A transformer that has no column form, walked in Arrow batches; what it raises sends the row to quarantine."""
    source = "def transform(v):\n    head, rest = v.rsplit('-', 1)\n    return rest[::2] + str(10 // (int(head) - 3))"
    return B.transformed(t.orders.select("o_orderkey", "o_orderpriority"), source, "o_orderpriority", "string").select("o_orderkey", "value", "reason")
