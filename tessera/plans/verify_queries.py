"""Verification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import verify as V
from .base import query

VARS = ("l_quantity", "l_linenumber", "l_discount")


def _kinds(v):
    lo, hi = f"min({v})", f"max({v})"
    cases = [(f"{lo} = {hi}", "constant"), (f"{lo} <> {hi} AND bool_and({v} <> 0)", "nonzero"), (f"{lo} <> {hi} AND {lo} >= 0", "nonnegative"), (f"{lo} <> {hi} AND {hi} <= 0", "nonpositive"), (f"{lo} <> {hi} AND bool_and({v} = floor({v})) AND {hi} - {lo} < 32", "range")]
    return [f"SELECT l_returnflag, '{v}' AS variable, '{k}' AS kind FROM lineitem GROUP BY l_returnflag HAVING {c}" for c, k in cases]


SCALAR = " UNION ALL ".join(s for v in VARS for s in _kinds(v))


@query(SCALAR)
def invariants_scalar(t):
    return V.scalar_invariants(t.lineitem, "l_returnflag", list(VARS))


@query("SELECT l_returnflag, 2.0 AS a, 3.0 AS b FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_quantity) > 1")
def invariants_linear(t):
    d = t.lineitem.select("l_returnflag", "l_quantity", (F.col("l_quantity") * 2 + 3).alias("y"))
    return V.linear_invariant(d, "l_returnflag", "l_quantity", "y")


@query("SELECT l_returnflag, CASE WHEN bool_and(l_discount < l_quantity) THEN '<' WHEN bool_and(l_discount <= l_quantity) THEN '<=' WHEN bool_and(l_discount > l_quantity) THEN '>' WHEN bool_and(l_discount >= l_quantity) THEN '>=' END AS relation FROM lineitem GROUP BY 1")
def invariants_ordering(t):
    return V.ordering_invariant(t.lineitem, "l_returnflag", "l_discount", "l_quantity")


@query("SELECT label, bool_and(len(embedding) > 0) AS non_empty, bool_and(list_aggregate(embedding, 'min') > 0) AS all_positive, bool_and(embedding = list_sort(embedding)) AS is_sorted FROM embeddings WHERE list_aggregate(embedding, 'count') > 0 GROUP BY label")
def invariants_sequence(t):
    return V.sequence_invariants(t.embeddings.where("size(embedding) > 0"), "label", "embedding")


@query(f"WITH o AS ({SCALAR}), n AS (SELECT CASE WHEN l_returnflag = 'A' THEN 'Z' ELSE l_returnflag END AS l_returnflag, variable, kind FROM o) SELECT coalesce(o.l_returnflag, n.l_returnflag) AS l_returnflag, coalesce(o.variable, n.variable) AS variable, coalesce(o.kind, n.kind) AS kind, CASE WHEN n.kind IS NULL THEN 'violated' WHEN o.kind IS NULL THEN 'introduced' ELSE 'agreed' END AS status FROM o FULL JOIN n ON o.l_returnflag = n.l_returnflag AND o.variable = n.variable AND o.kind = n.kind")
def invariants_compare(t):
    o = invariants_scalar(t)
    return V.compare_sets(o, o.withColumn("l_returnflag", F.when(F.col("l_returnflag") == "A", "Z").otherwise(F.col("l_returnflag"))))


LEAVES = """
p AS (SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events UNION ALL SELECT event_id, 'type', event_type FROM events),
s AS (SELECT event_id, path, CASE WHEN path = 'k' AND event_id % 400 = 399 THEN value || 'x' ELSE value END AS value FROM p),
c AS (SELECT event_id, path, CASE WHEN event_id % 5 = 0 THEN value || 'y' ELSE value END AS value FROM p WHERE NOT (path = 'type' AND event_id % 7 = 0)),
noise AS (SELECT p.path, min(p.event_id) AS first FROM p JOIN s USING (event_id, path) WHERE p.value IS DISTINCT FROM s.value GROUP BY p.path),
raw AS (SELECT p.event_id, p.path FROM p LEFT JOIN c USING (event_id, path) WHERE c.event_id IS NULL OR p.value IS DISTINCT FROM c.value),
d AS (SELECT raw.* FROM raw LEFT JOIN noise USING (path) WHERE first IS NULL OR first > event_id)"""


def replicas(t):
    e = t.events.select("event_id", F.inline(F.array(F.struct(F.lit("k").alias("path"), F.get_json_object("props", "$.k").alias("value")), F.struct(F.lit("type").alias("path"), F.col("event_type").alias("value")))))
    s = e.withColumn("value", F.when(F.expr("path = 'k' and event_id % 400 = 399"), F.concat("value", F.lit("x"))).otherwise(F.col("value")))
    c = e.where("not (path = 'type' and event_id % 7 = 0)").withColumn("value", F.when(F.expr("event_id % 5 = 0"), F.concat("value", F.lit("y"))).otherwise(F.col("value")))
    return e, s, c


@query(f"WITH {LEAVES} SELECT path, count(*) AS n FROM d GROUP BY path")
def diff_noise_paths(t):
    e, s, c = replicas(t)
    d = V.remove_noise(V.leaf_difference(e, c, "event_id"), V.leaf_difference(e, s, "event_id"), "event_id")
    return d.groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LEAVES} SELECT count(*) AS total, count(*) FILTER (WHERE event_id NOT IN (SELECT event_id FROM d)) AS matched, count(*) FILTER (WHERE event_id IN (SELECT event_id FROM d)) AS mismatched FROM events")
def diff_noise_report(t):
    e, s, c = replicas(t)
    d = V.remove_noise(V.leaf_difference(e, c, "event_id"), V.leaf_difference(e, s, "event_id"), "event_id")
    return V.diff_report(t.events.select("event_id"), d, "event_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE abs(l_extendedprice * (1 - l_discount) - (l_extendedprice - CASE WHEN l_linenumber = 3 THEN 0 ELSE l_extendedprice * l_discount END)) > 0.01")
def shadow_mismatches(t):
    p, d = F.col("l_extendedprice"), F.col("l_discount")
    out = V.shadow_mismatches(t.lineitem, p * (1 - d), p - F.when(F.col("l_linenumber") == 3, 0).otherwise(p * d), F.abs(F.col("control") - F.col("candidate")) <= 0.01)
    return out.select("l_orderkey", "l_linenumber")
