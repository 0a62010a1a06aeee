"""Datalog programs over the small tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .base import query
from .datalog import evaluate


def _edb(t):
    return {"nation": t.nation.select("n_nationkey", "n_name", "n_regionkey"), "region": t.region.select("r_regionkey", "r_name"), "customer": t.customer.select("c_custkey", "c_nationkey"), "supplier": t.supplier.select("s_suppkey", "s_nationkey")}


def _run(t, program, names):
    return evaluate(t.spark, program, _edb(t), "target").toDF(*names)


@query("SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def datalog_join(t):
    return _run(t, "target(N, R) :- nation(K, N, G), region(G, R).", ["nation", "region"])


@query("SELECT n_nationkey AS k FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 20)")
def datalog_negation(t):
    return _run(t, "near(N) :- supplier(S, N), S < 20. target(K) :- nation(K, M, G), not near(K).", ["k"])


@query("WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey // 2 AS b FROM part WHERE p_partkey >= 2), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a, b FROM r")
def datalog_recursive(t):
    e = t.part.where("p_partkey >= 2").select("p_partkey", F.expr("p_partkey div 2"))
    return evaluate(t.spark, "path(X, Y) :- edge(X, Y). path(X, Z) :- path(X, Y), edge(Y, Z).", {"edge": e}, "path").toDF("a", "b")


@query("WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey // 2 AS b FROM part WHERE p_partkey >= 2), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a, b FROM r")
def datalog_recursive_whole(t):
    e = t.part.where("p_partkey >= 2").select("p_partkey", F.expr("p_partkey div 2"))
    return evaluate(t.spark, "path(X, Y) :- edge(X, Y). path(X, Z) :- path(X, Y), edge(Y, Z).", {"edge": e}, "path").toDF("a", "b")


@query("SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1")
def datalog_agg_count(t):
    return _run(t, "target(N, C) :- customer(K, N), C = count(K).", ["nation", "n"])


@query("SELECT c_nationkey AS nation, CAST(sum(c_custkey) AS BIGINT) AS s FROM customer GROUP BY 1")
def datalog_agg_sum(t):
    return _run(t, "target(N, S) :- customer(K, N), S = sum(K).", ["nation", "s"])


@query("SELECT min(c_custkey) AS lo FROM customer")
def datalog_agg_min(t):
    return _run(t, "target(M) :- customer(K, N), M = min(K).", ["lo"])


@query("SELECT s_nationkey AS nation, max(s_suppkey) AS hi FROM supplier GROUP BY 1")
def datalog_agg_max(t):
    return _run(t, "target(N, M) :- supplier(K, N), M = max(K).", ["nation", "hi"])


@query("SELECT n_nationkey AS k, CAST((n_regionkey + 1) * 2 AS BIGINT) AS y FROM nation WHERE n_nationkey % 3 = 1")
def datalog_arith(t):
    return _run(t, "target(K, Y) :- nation(K, N, G), Y == G + 1 * 2, K % 3 == 1.", ["k", "y"]).select("k", F.col("y").cast("long").alias("y"))


@query("SELECT n_name AS nation FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def datalog_constants(t):
    return _run(t, 'target(N) :- nation(K, N, G), region(G, "ASIA").', ["nation"])


@query("SELECT n_nationkey AS k, CAST(n_regionkey + 1 * (n_nationkey - (2 + 3)) AS BIGINT) AS y FROM nation WHERE (n_nationkey + 1) % 2 = 0")
def datalog_parentheses(t):
    # operators have no precedence, so the product is put in parentheses
    return _run(t, "target(K, Y) :- nation(K, N, G), Y == G + (1 * (K - (2 + 3))), (K + 1) % 2 == 0.", ["k", "y"]).select("k", F.col("y").cast("long").alias("y"))
