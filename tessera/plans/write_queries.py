"""Writes to a target database."""

from __future__ import annotations

import contextlib
import fcntl
import functools
import sqlite3
import uuid

from pyspark.sql import functions as F

from ..functions import transform as T
from ..operators.graph import shared_dir
from ..sources.target_writer import Target, write_batches
from .base import query

ROWS = """r AS (SELECT o_orderkey AS k, o_custkey AS c, round(o_totalprice) AS p, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS batch_no, (row_number() OVER (ORDER BY o_orderkey) - 1) % 1000 AS place FROM orders),
v AS (SELECT *, CASE WHEN k % 97 = 0 THEN 'shared' ELSE CAST(k AS VARCHAR) END AS ref, c % 50 <> 0 AND p < 400000 AS good FROM r),
w AS (SELECT *, good AND row_number() OVER (PARTITION BY batch_no, ref, good ORDER BY k) = 1 AS written FROM v)"""


def opened(path: str) -> sqlite3.Connection:
    """A connection whose transactions outlive its process, as the journal is kept, but not a power failure, as nothing waits for the disk."""
    con = sqlite3.connect(path, timeout=300, isolation_level=None)
    con.execute("PRAGMA synchronous = OFF")
    con.execute("PRAGMA journal_mode = PERSIST")
    return con


@contextlib.contextmanager
def turn(path: str):
    """A lock that wakes the next writer at once; without it, or where files cannot be locked so, SQLite's own lock is polled."""
    with open(path, "a") as f:
        with contextlib.suppress(OSError):
            fcntl.flock(f, fcntl.LOCK_EX)
        yield


def sqlite_target(path: str, ddl: str, table: str) -> Target:
    """A table of an SQLite file that all tasks reach."""
    connect = functools.partial(opened, path)
    con = connect()
    con.execute(ddl)
    con.close()
    return Target(connect, table, begin=("BEGIN IMMEDIATE",), stepwise=True, turn=functools.partial(turn, f"{path}.turn"))


@query(f"""WITH {ROWS} SELECT batch_no, count(*) AS n_rows, count(*) FILTER (WHERE written) AS n_written, count(*) FILTER (WHERE NOT written) AS n_quarantined, true AS conserved,
  coalesce(string_agg(CAST(place AS VARCHAR), ',' ORDER BY place) FILTER (WHERE NOT written), '') AS offsets,
  sha256('{{"batch_id":"' || sha256('m2|orders|' || batch_no) || '","quarantine_offsets":[' || coalesce(string_agg(CAST(place AS VARCHAR), ',' ORDER BY place) FILTER (WHERE NOT written), '') || '],"rows_quarantined":' || count(*) FILTER (WHERE NOT written) || ',"rows_read":' || count(*) || ',"rows_written":' || count(*) FILTER (WHERE written) || ',"table":"orders"}}') AS receipt_hash
FROM w GROUP BY batch_no""")
def bulk_target_write(t):
    """All orders written to a table with constraints, in batches of 1,000 by key: what each batch's ledger says."""
    where = shared_dir(t.spark).removeprefix("file://")
    if "://" in where:
        raise RuntimeError("the target is an SQLite file: spark.checkpoint.dir must be a folder that all tasks mount")
    rows = T.batch_numbers(t.orders.select("o_orderkey", "o_custkey", F.round("o_totalprice").cast("double").alias("price")), "o_orderkey", 1000)
    rows = rows.select("batch_no", T.batch_id("m2", "orders", F.col("batch_no")).alias("batch"), F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 50 != 0, F.col("o_custkey")).alias("customer"), "price", F.when(F.col("o_orderkey") % 97 == 0, "shared").otherwise(F.col("o_orderkey").cast("string")).alias("ref"))
    ddl = "CREATE TABLE orders (id INTEGER PRIMARY KEY, customer INTEGER NOT NULL, price REAL CHECK (price < 400000), ref TEXT, _batch_id TEXT NOT NULL, UNIQUE (_batch_id, ref))"
    done = write_batches(rows, sqlite_target(f"{where}/target-{uuid.uuid4().hex}.db", ddl, "orders"), "batch", ["id"], ["id"], ["id", "customer", "price", "ref"])
    names = rows.groupBy("batch").agg(F.first("batch_no").alias("batch_no"))
    refused = F.size("quarantine").cast("long")
    conserved = (F.col("n_stored") == F.col("n_written")) & (F.col("n_rows") == F.col("n_written") + refused)
    return done.join(names, F.col("batch_id") == F.col("batch")).select("batch_no", "n_rows", "n_written", refused.alias("n_quarantined"), conserved.alias("conserved"), F.array_join(F.transform("quarantine", lambda e: e["row_offset"].cast("string")), ",").alias("offsets"), "receipt_hash")
