"""Likely invariants, response differences with noise removed, shadow comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scalar_invariants(df: DataFrame, point: str, variables: list[str]) -> DataFrame:
    """(point, variable, kind): constants, signs and small integer ranges, from one grouped scan."""
    aggs = []
    for v in variables:
        c = F.col(v)
        aggs += [F.min(c).alias(f"{v}_lo"), F.max(c).alias(f"{v}_hi"), F.bool_and(c != 0).alias(f"{v}_nz"), F.bool_and(c == F.floor(c)).alias(f"{v}_int")]
    g = df.groupBy(point).agg(*aggs)
    found = []
    for v in variables:
        lo, hi, nz, whole = (F.col(f"{v}_{k}") for k in ("lo", "hi", "nz", "int"))
        constant = lo == hi
        kinds = [(constant, "constant"), (~constant & nz, "nonzero"), (~constant & (lo >= 0), "nonnegative"), (~constant & (hi <= 0), "nonpositive"), (~constant & whole & (hi - lo < 32), "range")]
        found += [F.when(cond, F.struct(F.lit(v).alias("variable"), F.lit(k).alias("kind"))) for cond, k in kinds]
    return g.select(point, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("f")).select(point, "f.variable", "f.kind")


def linear_invariant(df: DataFrame, point: str, x: str, y: str, tolerance: float = 1e-9) -> DataFrame:
    """y = a x + b through the points of smallest and largest x, kept if no row is off by more than the tolerance."""
    ends = df.groupBy(point).agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min_by(y, x).alias("y0"), F.max_by(y, x).alias("y1")).where("x0 < x1")
    ends = ends.withColumn("a", (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))).withColumn("b", F.col("y0") - F.col("a") * F.col("x0"))
    off = df.join(ends, point).groupBy(point).agg(F.first("a").alias("a"), F.first("b").alias("b"), F.max(F.abs(F.col("a") * F.col(x) + F.col("b") - F.col(y))).alias("off"))
    return off.where(F.col("off") <= tolerance).select(point, "a", "b")


def ordering_invariant(df: DataFrame, point: str, x: str, y: str) -> DataFrame:
    a, b = F.col(x), F.col(y)
    g = df.groupBy(point).agg(F.bool_and(a < b).alias("lt"), F.bool_and(a <= b).alias("le"), F.bool_and(a > b).alias("gt"), F.bool_and(a >= b).alias("ge"))
    rel = F.when(F.col("lt"), "<").when(F.col("le"), "<=").when(F.col("gt"), ">").when(F.col("ge"), ">=")
    return g.select(point, rel.alias("relation")).where("relation is not null")


def sequence_invariants(df: DataFrame, point: str, arr: str) -> DataFrame:
    c = F.col(arr)
    return df.groupBy(point).agg(F.bool_and(F.size(c) > 0).alias("non_empty"), F.bool_and(F.forall(c, lambda v: v > 0)).alias("all_positive"), F.bool_and(c == F.array_sort(c)).alias("is_sorted"))


def compare_sets(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.subtract(new).withColumn("status", F.lit("violated")).union(new.subtract(old).withColumn("status", F.lit("introduced"))).union(old.intersect(new).withColumn("status", F.lit("agreed")))


def leaf_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, path) of leaves that differ; a missing leaf differs from any value, null included."""
    x = a.withColumn("_a", F.lit(True)).withColumnRenamed("value", "va")
    y = b.withColumn("_b", F.lit(True)).withColumnRenamed("value", "vb")
    j = x.join(y, [key, "path"], "full_outer")
    return j.where(F.col("_a").isNull() | F.col("_b").isNull() | ~F.col("va").eqNullSafe(F.col("vb"))).select(key, "path")


def remove_noise(diff: DataFrame, noise: DataFrame, key: str) -> DataFrame:
    """Drops paths that were noise in this or an earlier request (by ``key`` order)."""
    first = noise.groupBy("path").agg(F.min(key).alias("first"))
    return diff.join(first, "path", "left").where(F.col("first").isNull() | (F.col("first") > F.col(key))).select(key, "path")


def diff_report(requests: DataFrame, diff: DataFrame, key: str) -> DataFrame:
    bad = diff.select(key).distinct().withColumn("bad", F.lit(1))
    return requests.join(bad, key, "left").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("bad").isNull()).alias("matched"), F.count("bad").alias("mismatched"))


def shadow_mismatches(df: DataFrame, control: Column, candidate: Column, same: Column) -> DataFrame:
    """Rows where the candidate fails (null) or the comparator says no; the control is always returned."""
    return df.withColumn("control", control).withColumn("candidate", candidate).where(F.col("candidate").isNull() | ~same)
