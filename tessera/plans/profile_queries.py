"""Profiling queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import planner as N
from ..operators import profile as P
from .base import query

ROW = "SELECT '{t}' AS table_name, '{c}' AS column_name, '{p}' AS probe, CAST({a} AS BIGINT) AS affected, CAST({n} AS BIGINT) AS total, round(CASE WHEN {n} > 0 THEN {a} / {n} ELSE 0.0 END, 6) AS rate, {s} AS severity FROM {t}"


def _row(t, c, p, a, n, s):
    return ROW.format(t=t, c=c, p=p, a=a, n=n, s=s.format(a=a, n=n))


RATED = "CASE WHEN {{n}} > 0 AND {{a}} / {{n}} >= {floor} THEN '{level}' ELSE 'ok' END"
ZERO = "CASE WHEN {{a}} > 0 THEN '{level}' ELSE 'ok' END"
NULLS = [("customer", c) for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")] + [("orders", c) for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")] + [("part", c) for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")]
NULL_SQL = " UNION ALL ".join(_row(t, c, "null_distribution", f"count(*) FILTER (WHERE {c} IS NULL)", "count(*)", RATED.format(floor=0.01, level="info")) for t, c in NULLS)


@query(NULL_SQL)
def probe_null_distribution(t):
    names = dict.fromkeys(x for x, _ in NULLS)
    return reduce(lambda a, b: a.union(b), [P.run_probes(getattr(t, n), n, [P.null_probe(c) for x, c in NULLS if x == n]) for n in names])


SENTINELS = [("customer", "c_mktsegment", "string"), ("customer", "c_nationkey", "integer"), ("orders", "o_orderpriority", "string"), ("orders", "o_orderdate", "date"), ("part", "p_size", "integer")]
LISTS = {"string": "{c} IN ('N/A','NULL','UNKNOWN','','-')", "integer": "{c} IN (-1, 99999, 999999)", "date": "CAST({c} AS DATE) IN (DATE '1900-01-01', DATE '1970-01-01', DATE '9999-12-31')"}
SENTINEL_SQL = " UNION ALL ".join(_row(t, c, "sentinel_value", f"count(*) FILTER (WHERE {LISTS[k].format(c=c)})", f"count({c})", RATED.format(floor=0.01, level="warn")) for t, c, k in SENTINELS)


@query(SENTINEL_SQL)
def probe_sentinel(t):
    names = dict.fromkeys(x for x, _, _ in SENTINELS)
    return reduce(lambda a, b: a.union(b), [P.run_probes(getattr(t, n), n, [P.sentinel_probe(c, k) for x, c, k in SENTINELS if x == n]) for n in names])


MIDNIGHT = [("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts")]


@query(" UNION ALL ".join(_row(t, c, "timezone_drift", f"count(*) FILTER (WHERE hour({c}) = 0 AND minute({c}) = 0)", f"count({c})", RATED.format(floor=0.5, level="warn")) for t, c in MIDNIGHT))
def probe_midnight(t):
    return reduce(lambda a, b: a.union(b), [P.run_probes(getattr(t, n), n, [P.midnight_probe(c)]) for n, c in MIDNIGHT])


PRECISION = [("lineitem", "l_extendedprice"), ("orders", "o_totalprice"), ("customer", "c_acctbal")]


@query(" UNION ALL ".join(_row(t, c, "precision_boundary", f"count(*) FILTER (WHERE abs({c}) > 9999)", f"count({c})", ZERO.format(level="blocker")) for t, c in PRECISION))
def probe_precision(t):
    return reduce(lambda a, b: a.union(b), [P.run_probes(getattr(t, n), n, [P.precision_probe(c, 4)]) for n, c in PRECISION])


ORPHANS = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("supplier", "s_nationkey", "nation", "n_nationkey")]
ORPHAN_SQL = " UNION ALL ".join(f"SELECT '{a}' AS table_name, '{b}' AS column_name, 'orphan_fk' AS probe, CAST(count(*) FILTER (WHERE {d} IS NULL AND {b} IS NOT NULL) AS BIGINT) AS affected, CAST(count(*) AS BIGINT) AS total, round(count(*) FILTER (WHERE {d} IS NULL AND {b} IS NOT NULL) / count(*), 6) AS rate, CASE WHEN count(*) FILTER (WHERE {d} IS NULL AND {b} IS NOT NULL) > 0 THEN 'blocker' ELSE 'ok' END AS severity FROM {a} LEFT JOIN {c} ON {b} = {d}" for a, b, c, d in ORPHANS)


@query(ORPHAN_SQL)
def probe_orphan_fk(t):
    return reduce(lambda a, b: a.union(b), [P.orphan_probe(getattr(t, a), getattr(t, c), [(b, d)], a) for a, b, c, d in ORPHANS])


@query("SELECT o_orderkey, CASE WHEN o_custkey % 97 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS k FROM orders WHERE o_custkey % 97 = 0")
def orphan_rows(t):
    child = t.orders.select("o_orderkey", F.when(F.col("o_custkey") % 97 == 0, F.col("o_custkey") + 1_000_000).otherwise(F.col("o_custkey")).alias("k"))
    return P.orphan_keys(child, t.customer, [("k", "c_custkey")])


@query(f"SELECT * FROM ({NULL_SQL}) UNION ALL SELECT * FROM ({SENTINEL_SQL}) UNION ALL SELECT * FROM ({ORPHAN_SQL})")
def probe_profile(t):
    """The fused profile: each table is scanned once for all its column probes."""
    out = []
    for n in ("customer", "orders", "part"):
        out.append(P.run_probes(getattr(t, n), n, [P.null_probe(c) for x, c in NULLS if x == n] + [P.sentinel_probe(c, k) for x, c, k in SENTINELS if x == n]))
    out += [P.orphan_probe(getattr(t, a), getattr(t, c), [(b, d)], a) for a, b, c, d in ORPHANS]
    return reduce(lambda a, b: a.union(b), out)


@query(f"SELECT count(*) FILTER (WHERE severity = 'blocker') AS n_blocker, count(*) FILTER (WHERE severity = 'warn') AS n_warn, count(*) FILTER (WHERE severity = 'info') AS n_info, count(*) FILTER (WHERE severity = 'ok') AS n_ok, count(*) FILTER (WHERE severity = 'blocker') > 0 AS requires_review FROM (SELECT * FROM ({NULL_SQL}) UNION ALL SELECT * FROM ({SENTINEL_SQL}) UNION ALL SELECT * FROM ({ORPHAN_SQL}))")
def probe_manifest_stats(t):
    return P.manifest_stats(probe_profile(t))


@query("""
WITH v AS (SELECT DISTINCT CASE WHEN doc_id % 50 = 0 THEN text || 'Ã©' WHEN doc_id % 50 = 1 THEN text || chr(7) ELSE text END AS v FROM documents WHERE text IS NOT NULL)
SELECT CASE WHEN regexp_matches(v, 'Ã|Â[\\x{00a0}-\\x{00bf}]|\\x{fffd}') THEN 'mojibake' WHEN regexp_matches(v, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]') THEN 'control_chars' ELSE 'clean' END AS kind, count(*) AS n_values, array_to_string(list_transform(list(v ORDER BY v)[1:5], lambda x: md5(x)), ',') AS samples FROM v GROUP BY 1""")
def probe_encoding(t):
    d = t.documents.select(F.when(F.col("doc_id") % 50 == 0, F.concat("text", F.lit("Ã©"))).when(F.col("doc_id") % 50 == 1, F.concat("text", F.chr(F.lit(7)))).otherwise(F.col("text")).alias("text"))
    out = P.encoding_probe(d, "text", None)
    return out.withColumn("samples", F.array_join(F.transform("samples", F.md5), ","))


COLUMNS = {"region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]}
_STATES = "CASE WHEN share > 0.9 THEN 'ok' WHEN share > 0.2 THEN 'low_confidence' WHEN share > 0.002 THEN 'ambiguous' ELSE 'no_match' END"
_SHARES = " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(DISTINCT {c}) / count(*) AS share, {i} AS place FROM {t}" for i, (t, c) in enumerate((t, c) for t, cs in COLUMNS.items() for c in cs))
_JOINT = ["b0 * {0} AS j0{1}, b1 * {2} AS j1{1}, b2 * {3} AS j2{1}".format(*x) for x in (("(1.0 - signal)", "a", "signal", "CAST(0.55 AS DOUBLE)"), ("signal", "c", "(1.0 - signal)", "CAST(0.45 AS DOUBLE)"))]
_POST = lambda o: " + ".join(f"(j{i}{o} / p{o}) * ln(j{i}{o} / p{o} + 1e-12)" for i in range(3))
def plan_sql(budget: int, most: int) -> str:
    """The plan of ``mappings``, walked probe by probe."""
    return f"""WITH RECURSIVE m AS (SELECT table_name, column_name, place, {_STATES} AS status FROM ({_SHARES})),
st AS (SELECT * FROM (VALUES {", ".join(f"('{s}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), CAST({c} AS DOUBLE))" for s, (a, b, c) in N.BELIEFS.items() if s != "no_match")}) v(status, b0, b1, b2)),
ca AS (SELECT * FROM (VALUES {", ".join(f"('{c}', {i}, CAST({x} AS DOUBLE), {P.PROBE_COSTS[c]})" for i, (c, x) in enumerate(N.SIGNALS.items()))}) v(category, ordinal, signal, cost)),
j AS (SELECT *, {_JOINT[0]}, {_JOINT[1]} FROM st, ca), k AS (SELECT *, j0a + j1a + j2a AS pa, j0c + j1c + j2c AS pc FROM j),
e AS (SELECT status, category, ordinal, cost, -(b0 * ln(b0 + 1e-12) + b1 * ln(b1 + 1e-12) + b2 * ln(b2 + 1e-12)) + pa * ({_POST("a")}) + pc * ({_POST("c")}) + (j0a - j1a) + (j0c - j1c) AS v FROM k),
pr AS (SELECT status, category, ordinal, cost, CASE WHEN status = 'ok' THEN tanh(0.5 + v) * 0.5 + 0.5 ELSE least(1.0, tanh(0.5 + v) * 0.5 + 0.65) END AS priority FROM e),
c AS (SELECT row_number() OVER (ORDER BY round(priority, 12) DESC, cost, place, ordinal) AS i, table_name, column_name, category, priority, cost FROM m JOIN pr USING (status)),
w AS (SELECT CAST(0 AS BIGINT) AS i, 0 AS used, 0 AS n, '' AS state UNION ALL
  SELECT c.i, used + CASE WHEN n < {most} AND used + cost <= {budget} THEN cost ELSE 0 END, n + CASE WHEN n < {most} AND used + cost <= {budget} THEN 1 ELSE 0 END, CASE WHEN n >= {most} THEN 'cut' WHEN used + cost <= {budget} THEN 'scheduled' ELSE 'deferred' END FROM w JOIN c ON c.i = w.i + 1)
SELECT table_name, column_name, category, round(priority, 9) AS priority, CAST(cost AS BIGINT) AS cost, state, CASE WHEN state = 'scheduled' THEN CAST(n - 1 AS BIGINT) END AS place, CASE WHEN state = 'scheduled' THEN CAST(used AS BIGINT) END AS used,
  CASE WHEN state = 'deferred' THEN 'deferred: budget {budget}ms exhausted (' || used || ' used, this probe needs ' || cost || ')' END AS reason FROM w JOIN c USING (i)
UNION ALL SELECT table_name, column_name, NULL, NULL, NULL, 'excluded', NULL, NULL, 'no match, nothing to probe' FROM m WHERE status = 'no_match'"""


def mappings(t):
    """The columns of six tables, whose status comes from the share of distinct values in each."""
    parts = []
    for name, columns in COLUMNS.items():
        one = getattr(t, name).agg(*[(F.count_distinct(c) / F.count(F.lit(1))).alias(c) for c in columns])
        parts.append(one.select(F.inline(F.array(*[F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.col(c).alias("share")) for c in columns]))))
    order = {c: i for i, c in enumerate(c for cs in COLUMNS.values() for c in cs)}
    place = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col("column_name")]
    status = F.when(F.col("share") > 0.9, "ok").when(F.col("share") > 0.2, "low_confidence").when(F.col("share") > 0.002, "ambiguous").otherwise("no_match")
    return reduce(lambda a, b: a.union(b), parts).select("table_name", "column_name", status.alias("status"), place.alias("place"))


@query(plan_sql(30_000, 120))
def probe_plan_profiled(t):
    """The probe plan of the columns under the usual budget."""
    return N.probe_plan(mappings(t)).withColumn("priority", F.round("priority", 9))


@query(f"SELECT table_name || '.' || column_name || ':' || category AS probe, state = 'scheduled' AS scheduled FROM ({plan_sql(4000, 6)}) WHERE category IS NOT NULL")
def probe_plan_greedy(t):
    """Which probes of the columns run under a tight budget."""
    plan = N.probe_plan(mappings(t), 4000, 1).where("category is not null")
    return plan.select(F.concat("table_name", F.lit("."), "column_name", F.lit(":"), "category").alias("probe"), (F.col("state") == "scheduled").alias("scheduled"))
