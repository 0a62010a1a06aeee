"""Registry of queries over the fixed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Tables:
    """Attribute access to the tables of one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)


def query(sql: str | None = None):
    """Registers ``f(tables)`` under its name, with its DuckDB SQL if there is one."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return register


def merkle_sql(leaves: str, levels: int = 16) -> str:
    """SQL of the Merkle root of ``leaves``, a query of i (from 0) and c, of up to ``2 ** levels`` leaves."""
    out = [f"WITH l0 AS (SELECT i, unhex(sha256(c)) AS h FROM ({leaves}))"]
    for k in range(levels):
        joined = f"SELECT i // 2 AS i, unhex(sha256(arg_min(h, i) || arg_max(h, i))) AS h FROM l{k} GROUP BY i // 2"
        out.append(f"l{k + 1} AS (SELECT i, h FROM l{k} WHERE (SELECT count(*) FROM l{k}) = 1 UNION ALL SELECT i, h FROM ({joined}) WHERE (SELECT count(*) FROM l{k}) > 1)")
    return ", ".join(out) + f" SELECT lower(hex(h)) AS root FROM l{levels}"
