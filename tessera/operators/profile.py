"""Data-quality probes.  All probes of a table are aggregates of one scan; findings are unpivoted afterwards."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Sentinels by type family, rate floors, regular expressions of damaged text.
DATE_SENTINELS = ("1900-01-01", "1970-01-01", "9999-12-31")
INT_SENTINELS = (-1, 99999, 999999)
STRING_SENTINELS = ("N/A", "NULL", "UNKNOWN", "", "-")
RATE_FLOOR = 0.01
MIDNIGHT_FLOOR = 0.5
MOJIBAKE = "Ã|Â[\\u00a0-\\u00bf]|\\ufffd"
CONTROL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"


@dataclass(frozen=True)
class Probe:
    """One measure of one column: rows affected out of a total, and its severity."""

    column: str
    probe: str
    affected: Column
    total: Column
    severity: object  # (affected, total) -> Column


def _rate(a: Column, n: Column) -> Column:
    return F.when(n > 0, a / n).otherwise(F.lit(0.0))


def null_probe(column: str, nullable: bool = True) -> Probe:
    def severity(a, n):
        if not nullable:
            return F.when(a > 0, "blocker").otherwise("ok")
        return F.when(_rate(a, n) >= RATE_FLOOR, "info").otherwise("ok")

    return Probe(column, "null_distribution", F.count_if(F.col(column).isNull()), F.count(F.lit(1)), severity)


def sentinel_probe(column: str, family: str) -> Probe:
    """family: string, integer or date; other types have no sentinels."""
    values = {"string": STRING_SENTINELS, "integer": INT_SENTINELS, "date": DATE_SENTINELS}[family]
    c = F.col(column).cast("date").cast("string") if family == "date" else F.col(column)
    return Probe(column, "sentinel_value", F.count_if(c.isin(*values)), F.count(F.col(column)), lambda a, n: F.when(_rate(a, n) >= RATE_FLOOR, "warn").otherwise("ok"))


def midnight_probe(column: str, seconds: bool = False) -> Probe:
    c = F.col(column)
    at = (F.hour(c) == 0) & (F.minute(c) == 0)
    if seconds:
        at = at & (F.second(c) == 0)
    return Probe(column, "timezone_drift", F.count_if(at), F.count(c), lambda a, n: F.when(_rate(a, n) >= MIDNIGHT_FLOOR, "warn").otherwise("ok"))


def precision_probe(column: str, precision: int) -> Probe:
    """Values beyond ``10^precision - 1``, whatever the scale; ``affected`` counts them."""
    bound = float(10**precision - 1)
    return Probe(column, "precision_boundary", F.count_if(F.abs(F.col(column)) > bound), F.count(F.col(column)), lambda a, n: F.when(a > 0, "blocker").otherwise("ok"))


def run_probes(df: DataFrame, name: str, probes: list[Probe]) -> DataFrame:
    """(table, column, probe, affected, total, rate, severity): one scan, one row for each probe."""
    one = df.agg(*[x.alias(f"{k}{i}") for i, p in enumerate(probes) for k, x in (("a", p.affected), ("n", p.total))])
    rows = [F.struct(F.lit(name).alias("table_name"), F.lit(p.column).alias("column_name"), F.lit(p.probe).alias("probe"), F.col(f"a{i}").alias("affected"), F.col(f"n{i}").alias("total"), F.round(_rate(F.col(f"a{i}"), F.col(f"n{i}")), 6).alias("rate"), p.severity(F.col(f"a{i}"), F.col(f"n{i}")).alias("severity")) for i, p in enumerate(probes)]
    return one.select(F.inline(F.array(*rows)))


def orphan_keys(child: DataFrame, parent: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Child rows without a parent; of a composite key only the first child column must not be null."""
    cond = [child[c] == parent[p] for c, p in keys]
    return child.where(F.col(keys[0][0]).isNotNull()).join(parent, cond, "left_anti")


def orphan_probe(child: DataFrame, parent: DataFrame, keys: list[tuple[str, str]], name: str) -> DataFrame:
    orphans = orphan_keys(child, parent, keys).agg(F.count(F.lit(1)).alias("affected"))
    total = child.agg(F.count(F.lit(1)).alias("total"))
    # two one-row sides
    both = orphans.withColumn("k", F.lit(1)).join(total.withColumn("k", F.lit(1)), "k")
    return both.select(F.lit(name).alias("table_name"), F.lit(",".join(c for c, _ in keys)).alias("column_name"), F.lit("orphan_fk").alias("probe"), "affected", "total", F.round(_rate(F.col("affected"), F.col("total")), 6).alias("rate"), F.when(F.col("affected") > 0, "blocker").otherwise("ok").alias("severity"))


def encoding_probe(df: DataFrame, column: str, limit: int | None = 1000, samples: int = 5) -> DataFrame:
    """(kind, n_values, samples): damaged values among the first ``limit`` distinct ones in value order (None: all).

    ``samples`` are the first few of a kind, in value order.
    """
    values = df.select(F.col(column).alias("v")).where("v is not null").distinct()
    if limit:
        values = values.orderBy("v").limit(limit)
    bad = F.when(F.col("v").rlike(MOJIBAKE), "mojibake").when(F.col("v").rlike(CONTROL), "control_chars").otherwise("clean")
    kinds = values.withColumn("kind", bad)
    first = Window.partitionBy("kind").orderBy("v")
    few = kinds.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= samples)
    few = few.groupBy("kind").agg(F.array_sort(F.collect_list("v")).alias("samples"))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n_values")).join(few, "kind")


def manifest_stats(findings: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("blocker", "warn", "info", "ok")]
    return findings.agg(*counts).withColumn("requires_review", F.col("n_blocker") > 0)


#: Probe costs in milliseconds, beliefs by mapping status, signals by category.
PROBE_COSTS = {"null_distribution": 300, "encoding_anomaly": 800, "orphan_fk": 1500, "timezone_drift": 600, "precision_boundary": 400, "sentinel_value": 500}


def greedy_plan(candidates: list[tuple[str, float, int]], budget: int, most: int) -> tuple[list[str], list[str]]:
    """(name, priority, cost) by falling priority, then cost: taken while the budget holds, else deferred."""
    taken, deferred, used = [], [], 0
    for name, _, cost in sorted(candidates, key=lambda c: (-c[1], c[2])):
        if used + cost > budget:
            deferred.append(name)
            continue
        taken.append(name)
        used += cost
        if len(taken) >= most:
            break
    return taken, deferred


def entropy(p: list[float]) -> float:
    return -sum(x * math.log(max(x, 1e-16)) for x in p)


def information_gain(belief: list[float], likelihood: list[list[float]]) -> float:
    """Prior entropy less the expected entropy after one observation."""
    gain = entropy(belief)
    for o in range(len(likelihood[0])):
        joint = [b * row[o] for b, row in zip(belief, likelihood, strict=True)]
        p = sum(joint)
        if p >= 1e-9:
            gain -= p * entropy([j / p for j in joint])
    return gain
