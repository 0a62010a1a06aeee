"""Operational analytics: roll-ups, scores, ordered sums and top lists, as column expressions and DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def spend_rollup(calls: DataFrame, providers: list[str], today: str) -> DataFrame:
    """A row for each provider, also for one without calls."""
    dim = calls.sparkSession.createDataFrame([(p,) for p in providers], "provider string")
    g = calls.groupBy("provider").agg(F.count_if(F.to_date("ts") == F.lit(today).cast("date")).alias("today_calls"), F.count(F.lit(1)).alias("month_calls"), F.round(F.sum("value"), 4).alias("month_usd"), F.max("ts").alias("last_call_at"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("today_calls", "month_calls")]
    return dim.join(g, "provider", "left").select("provider", *zero, F.coalesce("month_usd", F.lit(0.0)).alias("month_usd"), "last_call_at")


def last_n(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def estimated_loc(size: Column) -> Column:
    return F.when(size <= 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), F.floor(size / 45)))


def top_and_rest(g: DataFrame, name: str, order, k: int, sums: list[str]) -> DataFrame:
    """The first k groups and one row for the others.  ``g`` has a row for each group."""
    top = g.orderBy(order, name).limit(k).select(F.col(name).alias("_n"))
    out = g.join(top, g[name] == top["_n"], "left").withColumn(name, F.coalesce("_n", F.lit("(rest)")))
    return out.groupBy(name).agg(*[F.sum(c).alias(c) for c in sums])


def weighted_score(parts: list[tuple[Column, float]]) -> Column:
    total = F.lit(0.0)
    for cond, w in parts:
        total = total + F.when(cond, F.lit(w)).otherwise(F.lit(0.0))
    return F.round(total, 3)


def profile_score(weights: dict[str, tuple[float, float]]) -> Column:
    """Weights of features, each up to its minimum for the full share."""
    total = F.lit(0.0)
    for name, (w, least) in weights.items():
        total = total + F.lit(w) * F.least(F.lit(1.0), F.col(name) / F.lit(least))
    return F.round(total, 4)


def promotion(rows: DataFrame, group: str, has: str, quality: str, files: int = 10, gain: float = 0.1) -> DataFrame:
    g = rows.groupBy(group).agg(F.count(F.lit(1)).alias("files"), F.avg(F.when(F.col(has), F.col(quality))).alias("w"), F.avg(F.when(~F.col(has), F.col(quality))).alias("o"))
    g = g.where("w is not null and o is not null")
    return g.select(group, "files", F.round(F.col("w") - F.col("o"), 6).alias("gain"), ((F.col("files") >= files) & (F.col("w") - F.col("o") >= gain)).alias("promote"))


def clamped_sum(df: DataFrame, keys: list[str], order: list[str], delta: str, name: str) -> DataFrame:
    """A running sum that never falls below zero: ``S - min(0, min S)`` of the plain running sum S."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    s = df.withColumn("_s", F.sum(delta).over(w))
    return s.withColumn(name, F.col("_s") - F.least(F.lit(0), F.min("_s").over(w))).drop("_s")


def severity_score(callers: Column, reachable: Column, failures: Column, public: Column) -> Column:
    return callers * 2 + F.when(reachable, 5).otherwise(0) + failures + F.when(public, 1).otherwise(0)


def severity_label(score: Column) -> Column:
    return F.when(score >= 90, "critical").when(score >= 40, "high").when(score >= 20, "medium").when(score >= 8, "low").otherwise("info")


def test_budget(loc: Column, branches: Column, cyclomatic: Column, recent: Column) -> Column:
    base = F.when((loc <= 3) & (branches == 0) & (cyclomatic <= 2), 25).when((loc > 50) | (branches > 5) | (cyclomatic > 10), 200).otherwise(100)
    return F.floor(base * F.when(recent, 1.5).otherwise(1.0))


test_budget.__test__ = False  # not a pytest case


def coverage(referenced: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """Referenced but not declared: missing; declared but not referenced: extra."""
    missing = referenced.join(declared, key, "left_anti").withColumn("status", F.lit("missing"))
    return missing.union(declared.join(referenced, key, "left_anti").withColumn("status", F.lit("extra")))


def zero_filled(rows: DataFrame, column: str, labels: list[str]) -> DataFrame:
    dim = rows.sparkSession.createDataFrame([(x,) for x in labels], f"{column} string")
    g = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return dim.join(g, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def cost_usd(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """An unknown model (null price) costs the highest tier."""
    return F.round(tokens_in / 1e6 * F.coalesce(price_in, F.lit(15.0)) + tokens_out / 1e6 * F.coalesce(price_out, F.lit(75.0)), 6)


def feed(rows: DataFrame, at: str, *, since=None, until=None, equal: dict | None = None, limit: int = 100, tie: str | None = None) -> DataFrame:
    """Newest first, between two times (inclusive), of equal values; ``limit`` is held to 1 to 500."""
    for c, v in (equal or {}).items():
        rows = rows.where(F.col(c) == v)
    if since is not None:
        rows = rows.where(F.col(at) >= since)
    if until is not None:
        rows = rows.where(F.col(at) <= until)
    return rows.orderBy(F.desc(at), *([F.desc(tie)] if tie else [])).limit(min(500, max(1, limit)))


def allowed(namespace: Column, names: list[str]) -> Column:
    """An empty list allows all; what has no namespace passes."""
    return (namespace.isNull() | namespace.isin(*names)) if names else F.lit(True)


def first_match(rows: DataFrame, column: str, patterns: list[tuple[str, str]]) -> DataFrame:
    """Rows that match a pattern, with the name of the first that does."""
    kind = F.coalesce(*[F.when(F.col(column).rlike(p), name) for name, p in patterns])
    return rows.withColumn("kind", kind).where("kind is not null")
