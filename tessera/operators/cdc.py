"""Change-data capture on DataFrames: positions, watermark, apply, lag and cutover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import greatest_before


def lsn_number(lsn: Column) -> Column:
    """``X/Y`` hex to a number; null if it is no position."""
    part = [F.conv(F.split(lsn, "/")[i], 16, 10).cast("long") for i in (0, 1)]
    return F.when(lsn.rlike("^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$"), F.shiftleft(part[0], 32) + part[1])


def lsn_text(n: Column) -> Column:
    return F.concat(F.hex(F.shiftright(n, 32)), F.lit("/"), F.hex(n.bitwiseAND(F.lit(0xFFFFFFFF))))


def watermark(events: DataFrame, table: str, position: list[str], arrival: str) -> DataFrame:
    """Adds ``fresh``: whether an event is beyond every earlier arrival of its table."""
    top = greatest_before(events, [table], [arrival], F.struct(*position), "_top")
    return top.withColumn("fresh", F.col("_top").isNull() | (F.struct(*position) > F.col("_top"))).drop("_top")


def classify(op: Column, known_table: Column, before: Column, after: Column) -> Column:
    """The quarantine reason of an event; null for one that may be applied."""
    return (
        F.when(op == "T", "unmapped_column").when(~known_table, "unknown_relation").when((op == "I") & after.isNull(), "schema_drift").when((op == "U") & after.isNull(), "schema_drift").when((op == "D") & before.isNull(), "schema_drift")
    )


def apply_changes(target: DataFrame, changes: DataFrame, key: str, op: str, order: list[str]) -> DataFrame:
    """Target after the last change of each key; changes carry the target's columns, op and order."""
    columns = target.columns
    last = changes.groupBy(key).agg(F.max_by(F.struct(op, *[c for c in columns if c != key]), F.struct(*order)).alias("r"))
    kept = target.join(last.select(key), key, "left_anti")
    new = last.where(F.col(f"r.{op}") != "D").select(*[F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in columns])
    return kept.unionByName(new)


def lag_series(ticks: DataFrame, written: str, applied: str, rate: float = 1_000_000.0) -> DataFrame:
    d = F.greatest(F.lit(0), F.col(written) - F.col(applied))
    return ticks.withColumn("lag_bytes", d).withColumn("lag_seconds", d / rate)


def cutover(ticks: DataFrame, unit: str, order: str, lag: str, reachable: str, parity_ok: str, most: float = 60.0, sustain: float = 900.0) -> DataFrame:
    """(unit, order, action) for the ticks of each migrated unit: ticks of bad lag end a window; parity failures
    neither start nor end one and ask for a look."""
    w = Window.partitionBy(unit).orderBy(order)
    good = F.coalesce((F.col(lag) < most) & F.col(reachable), F.lit(False))
    t = ticks.withColumn("_good", good).withColumn("_isle", F.sum((~good).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.min(F.when(F.col("_good") & F.col(parity_ok), F.col(order))).over(Window.partitionBy(unit, "_isle").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    action = F.when(~F.col("_good"), "reset").when(~F.col(parity_ok), "investigate_divergence").when(F.col(order) - start >= sustain, "operator_sign").otherwise("wait")
    return t.select(unit, order, action.alias("action"))


def parity(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    x = a.select(key, F.struct(*columns).alias("_a"))
    y = b.select(key, F.struct(*columns).alias("_b"))
    j = x.join(y, key, "full_outer")
    bad = F.count_if(~F.col("_a").eqNullSafe(F.col("_b")))
    return j.agg(F.count(F.lit(1)).alias("rows_compared"), bad.alias("rows_diverged")).withColumn("divergence_rate", F.round(F.when(F.col("rows_compared") > 0, F.col("rows_diverged") / F.col("rows_compared")).otherwise(0.0), 6))


def route_weights(shifts: DataFrame, unit: str, weight: str, order: str) -> DataFrame:
    w = F.greatest(F.lit(0), F.least(F.lit(100), F.col(weight)))
    return shifts.groupBy(unit).agg(F.max_by(w, order).alias("weight")).withColumn("legacy", 100 - F.col("weight"))


def predicate(op: Column, before: Column, after: Column, key_columns: Column) -> Column:
    """(values, reason): the columns that locate the target row of an update or deletion, as a map.

    The replica identity's columns of the image before (else after), the whole image before
    where no identity is known; else a reason for the quarantine.  Images are maps, keys an array.
    """
    image = F.coalesce(before, after)
    keyed = F.map_filter(image, lambda k, _: F.array_contains(key_columns, k))
    has_key = F.coalesce(F.size(key_columns) > 0, F.lit(False))
    values = F.when(has_key, keyed).otherwise(before)
    reason = F.when(~op.isin("U", "D"), None).when(image.isNull(), "schema_drift").when(values.isNull() | (F.size(values) == 0), "schema_drift")
    return F.struct(F.when(op.isin("U", "D") & reason.isNull(), values).alias("values"), reason.alias("reason"))


def verifiers_clean(summary: Column) -> Column:
    """Of a map of counts: not empty, no violation or mismatch, and property tests, if any, passed."""
    count = lambda k: F.coalesce(F.try_element_at(summary, F.lit(k)), F.lit(0))
    clean = (count("daikon_violated") <= 0) & (count("scientist_mismatches") <= 0) & (count("diffy_mismatches") <= 0)
    passed = F.coalesce(F.try_element_at(summary, F.lit("hypothesis_passed")), F.lit(1)) > 0
    return F.coalesce((F.size(summary) > 0) & clean & passed, F.lit(False))


def shift_log(requests: DataFrame, unit: str, order: str) -> DataFrame:
    """Adds ``rejected_reason`` and ``percentage`` (of the unit after the request) to requests (target, clean, rollback)."""
    ok = F.coalesce(F.col("rollback") | F.col("clean"), F.lit(False))
    w = Window.partitionBy(unit).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    state = F.coalesce(F.last(F.when(ok, F.col("target")), ignorenulls=True).over(w), F.lit(0))
    reason = F.when(~F.col("target").between(0, 100), "out_of_range").when(~ok, "verifier_mismatch")
    return requests.withColumn("rejected_reason", reason).where(F.col("target").between(0, 100)).withColumn("percentage", state)


def sampled(rows: DataFrame, key: str, rate: float, seed: int = 0) -> DataFrame:
    """A share of the rows chosen by a hash of their key: the same ones on every run."""
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) < int(rate * 1_000_000))
