"""Which probes to run on which mapped columns under a budget: values of probes as a relation, and a greedy choice by classes.

A probe's value depends only on the mapping's status and the probe's category, so candidates fall into a few classes of equal
priority and cost.  The greedy walk (take what fits, skip what does not, stop at a number of probes) takes of each class the
first so many in the order of the input.  It is therefore folded over the classes, and each candidate
is compared with what its class was granted: a plan of any number of columns is a running position and a small join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordered import positions
from .profile import PROBE_COSTS

#: Belief that a column of a status survives, blocks or is unknown; how well a probe tells; in their order.
BELIEFS = {"ok": (0.80, 0.05, 0.15), "low_confidence": (0.45, 0.20, 0.35), "ambiguous": (0.40, 0.25, 0.35), "no_match": (0.10, 0.55, 0.35)}
SIGNALS = {"null_distribution": 0.65, "encoding_anomaly": 0.55, "orphan_fk": 0.70, "timezone_drift": 0.60, "precision_boundary": 0.65, "sentinel_value": 0.50}
#: What one would like to see of the three states, what is added for an uncertain mapping, and the floor of a logarithm.
PREFERENCE, UNCERTAIN, FLOOR = (1.0, -1.0, 0.0), 0.15, 1e-12
BUDGET, ITERATIONS = 30_000, 20


def _entropy(p: list[Column]) -> Column:
    return -sum((x * F.log(x + FLOOR) for x in p), F.lit(0.0))


def _values(belief: list[Column], signal: Column) -> tuple[Column, Column]:
    """Expected information gain of a probe, and expected agreement with the preference."""
    seen = [[1.0 - signal, signal], [signal, 1.0 - signal], [F.lit(0.55), F.lit(0.45)]]  # of an anomaly or none, in each state
    gain, agreement = _entropy(belief), F.lit(0.0)
    for o in range(2):
        joint = [b * row[o] for b, row in zip(belief, seen, strict=True)]
        p = joint[0] + joint[1] + joint[2]
        after = [j / p for j in joint]
        gain = gain - p * _entropy(after)
        agreement = agreement + p * sum((a * w for a, w in zip(after, PREFERENCE, strict=True)), F.lit(0.0))
    return gain, agreement


def probe_values(spark: SparkSession) -> DataFrame:
    """(status, category, ordinal, cost, epistemic, pragmatic, efe, priority) for each status that can be probed and each category."""
    rows = [(s, *BELIEFS[s], c, i, SIGNALS[c], PROBE_COSTS[c]) for s in BELIEFS if s != "no_match" for i, c in enumerate(SIGNALS)]
    v = spark.createDataFrame(rows, "status string, b0 double, b1 double, b2 double, category string, ordinal int, signal double, cost long")
    gain, agreement = _values([F.col("b0"), F.col("b1"), F.col("b2")], F.col("signal"))
    v = v.select("status", "category", "ordinal", "cost", gain.alias("epistemic"), agreement.alias("pragmatic")).withColumn("efe", -(F.col("epistemic") + F.col("pragmatic")))
    priority = F.tanh(0.5 - F.col("efe")) * 0.5 + 0.5
    return v.withColumn("priority", F.when(F.col("status") == "ok", priority).otherwise(F.least(F.lit(1.0), priority + UNCERTAIN)))


@dataclass
class Grant:
    """Of a class: how many are taken, what was spent before it and after it, whether the walk ended in it."""

    priority: float
    cost: int
    taken: int
    before: int
    after: int
    ended: bool


def fold(classes: list[tuple[float, int, int]], budget: int, most: int) -> list[Grant]:
    """The greedy walk over classes (priority, cost, members)."""
    used, n, out = 0, 0, []
    for priority, cost, members in sorted(classes, key=lambda c: (-c[0], c[1])):
        if out and out[-1].ended:
            out.append(Grant(priority, cost, 0, used, used, True))
            continue
        taken = max(0, min(members, (budget - used) // cost, most - n))
        out.append(Grant(priority, cost, taken, used, used + taken * cost, taken > 0 and n + taken >= most))
        used, n = used + taken * cost, n + taken
    return out


def probe_plan(mappings: DataFrame, budget: int = BUDGET, iterations: int = ITERATIONS) -> DataFrame:
    """(table_name, column_name, category, priority, cost, state, place, used, reason) of all probes of the mappings.

    ``mappings``: table_name, column_name, status, place (their order).  ``state``: ``scheduled``, with its ``place`` in the plan
    and the cost ``used`` with it; ``deferred``, as it did not fit when its turn came; ``cut``, as enough were scheduled;
    ``excluded``, a mapping without a match (no category).  An unknown status counts as without a match.
    """
    spark = mappings.sparkSession
    m = mappings.select("table_name", "column_name", F.when(F.col("status").isin(*[s for s in BELIEFS if s != "no_match"]), F.col("status")).alias("status"), F.col("place").cast("long").alias("at"))
    rows = m.where("status is not null").join(F.broadcast(probe_values(spark)), "status")
    rows = positions(rows.select("table_name", "column_name", "category", "priority", "cost", "at", "ordinal"), ["priority", "cost"], ["at", "ordinal"], "i")
    classes = [(r.priority, r.cost, r.n) for r in rows.groupBy("priority", "cost").agg(F.count(F.lit(1)).alias("n")).collect()]  # at most one for each status and category
    grants, first = [], 0
    for g in fold(classes, budget, 6 * iterations):
        grants.append((g.priority, g.cost, g.taken, g.before, g.after, g.ended, first))
        first += g.taken
    granted = spark.createDataFrame(grants, "priority double, cost long, taken long, before long, after long, ended boolean, first long")
    state = F.when(F.col("i") < F.col("taken"), "scheduled").when(F.col("ended"), "cut").otherwise("deferred")
    reason = F.when(F.col("state") == "deferred", F.format_string(f"deferred: budget {budget}ms exhausted (%d used, this probe needs %d)", "after", "cost"))
    done = rows.join(F.broadcast(granted), ["priority", "cost"]).withColumn("state", state)
    scheduled = F.col("state") == "scheduled"
    done = done.select("table_name", "column_name", "category", "priority", "cost", "state", F.when(scheduled, F.col("first") + F.col("i")).alias("place"), F.when(scheduled, F.col("before") + (F.col("i") + 1) * F.col("cost")).alias("used"), reason.alias("reason"))
    none = m.where("status is null").select("table_name", "column_name", F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("long"), F.lit("excluded"), F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit("no match, nothing to probe"))
    return done.union(none)


def unprobed(plan: DataFrame) -> DataFrame:
    """(table_name, column_name, reason): every mapping without a scheduled probe, with the first reason there is."""
    g = plan.groupBy("table_name", "column_name").agg(F.count_if(F.col("state") == "scheduled").alias("n"), F.min("reason").alias("reason"))
    return g.where("n = 0").select("table_name", "column_name", F.coalesce("reason", F.lit("cut: enough probes were scheduled")).alias("reason"))
