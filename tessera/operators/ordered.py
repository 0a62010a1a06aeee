"""Running values over keys of any size: rows are range-partitioned by key and order, and what came before
a partition is carried in, so that no task holds all rows of a key.

The partitioned rows are written once (see ``Steps``), as both passes must see the same ranges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import Steps


def ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ``_p``, the number of the range a row is in."""
    return Steps(df).put(df.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()))


def _carried(rows: DataFrame, keys: list[str], total: Column, carry: Callable) -> DataFrame:
    """Adds ``_before``: what ``carry`` makes of the totals of the key's earlier ranges (a row for each key and range)."""
    parts = rows.groupBy("_p", *keys).agg(total.alias("_total"))
    before = carry(F.col("_total"), Window.partitionBy(*keys).orderBy("_p"))
    parts = parts.select(F.col("_p").alias("_q"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], before.alias("_before"))
    same = F.col("_p") == F.col("_q")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(parts, same).drop("_q", *[f"_k{i}" for i in range(len(keys))])


def _own(keys: list[str], order: list[str]):
    return Window.partitionBy("_p", *keys).orderBy(*order)


def positions(df: DataFrame, keys: list[str], order: list[str], name: str = "_i") -> DataFrame:
    """Adds the place of a row among those of its key, from 0."""
    rows = _carried(ranged(df, keys, order), keys, F.count(F.lit(1)), lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.withColumn(name, (F.row_number().over(_own(keys, order)) - 1 + F.col("_before")).cast("long")).drop("_p", "_before")


def greatest_before(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the greatest value of the key's earlier rows, null for the first."""
    rows = _carried(ranged(df.withColumn("_v", value), keys, order), keys, F.max("_v"), lambda m, w: F.max(m).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    here = F.max("_v").over(_own(keys, order).rowsBetween(Window.unboundedPreceding, -1))
    best = F.when(F.col("_before").isNull() | (here > F.col("_before")), here).otherwise(F.col("_before"))
    return rows.withColumn(name, F.coalesce(best, "_before")).drop("_p", "_v", "_before")


def previous(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds the value of the key's row before, null for the first."""
    at = F.struct(*order)
    rows = _carried(ranged(df, keys, order), keys, F.max_by(F.struct(value), at), lambda last, w: F.lag(last).over(w))
    here = F.lag(F.struct(value)).over(_own(keys, order))
    return rows.withColumn(name, F.coalesce(here, "_before")[value]).drop("_p", "_before")
