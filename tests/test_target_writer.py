"""Batches written to SQLite: constraints, a task that dies, lost connections, retries."""

import functools
import hashlib
import json
import os
import sqlite3
import sys

import pytest
from pyspark import cloudpickle
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from tessera.sources import target_writer as W

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not see this file

DDL = "CREATE TABLE pets (id INTEGER PRIMARY KEY, name TEXT NOT NULL, owner INTEGER CHECK (owner < 90), _batch_id TEXT NOT NULL)"
NAMES = ["id", "name", "owner"]


def opened(path, die=None, marker=None):
    """A connection; with ``die``, the process ends in the middle of that batch, once."""
    con = sqlite3.connect(path, timeout=60, isolation_level=None)
    if die and not os.path.exists(marker):

        def check(batch):
            if batch == die and not os.path.exists(marker):
                with open(marker, "w"):
                    pass
                os._exit(7)
            return batch

        con.create_function("seen", 1, check)
        con.execute("CREATE TEMP TRIGGER kill AFTER INSERT ON main.pets WHEN NEW.id % 10 = 5 BEGIN SELECT seen(NEW._batch_id); END")
    return con


@pytest.fixture
def path(tmp_path):
    p = str(tmp_path / "t.db")
    with sqlite3.connect(p) as con:
        con.execute("PRAGMA journal_mode=WAL")
        con.execute(DDL)
    return p


def target(path, **more):
    return W.Target(functools.partial(opened, path), "pets", begin=("BEGIN IMMEDIATE",), **more)


def rows_of(spark, n=100):
    # ids repeat within their batch, names are missing, owners too large
    return spark.range(n).select(F.concat(F.lit("b"), F.floor(F.col("id") / 10)).alias("batch"), F.col("id").alias("k"), F.when(F.col("id") % 10 == 4, F.col("id") - 1).otherwise(F.col("id")).alias("id"), F.when(F.col("id") % 25 != 0, F.concat(F.lit("n"), "id")).alias("name"), F.col("id").alias("owner"))


def expected(n=100):
    out = {}
    for b in range(n // 10):
        bad = [k for k in range(10 * b, 10 * b + 10) if k % 10 == 4 and (k - 1) % 25 and k - 1 < 90 or k % 25 == 0 or k >= 90]
        out[f"b{b}"] = [k - 10 * b for k in bad]
    return out


def check(path, got, n=100):
    want = expected(n)
    assert {r.batch_id: [e.row_offset for e in r.quarantine] for r in got} == want
    assert all(r.n_rows == 10 and r.n_stored == r.n_written == 10 - len(want[r.batch_id]) for r in got)
    assert {e.category for r in got for e in r.quarantine} == {"target_constraint_violation"}
    assert all(hashlib.sha256(r.receipt.encode()).hexdigest() == r.receipt_hash and json.loads(r.receipt)["quarantine_offsets"] == want[r.batch_id] for r in got)
    con = sqlite3.connect(path)
    stored = dict(con.execute("SELECT _batch_id, count(*) FROM pets GROUP BY 1").fetchall())
    assert {b: stored.get(b, 0) for b in want} == {b: 10 - len(v) for b, v in want.items()}
    assert con.execute("SELECT count(*) FROM _batch_ledger").fetchone()[0] == len(want)


def test_isolation_and_resumption(spark, path):
    t = target(path)
    done = W.write_batches(rows_of(spark), t, "batch", ["k"], ["k"], NAMES, writers=3)
    got = done.collect()
    check(path, got)
    assert not any(r.already for r in got)
    again = done.collect()  # nothing is written twice, and the receipts are the same
    assert all(r.already for r in again)
    assert sorted((r.batch_id, r.receipt_hash) for r in again) == sorted((r.batch_id, r.receipt_hash) for r in got)
    check(path, again)
    assert {e.pk_hash for r in got for e in r.quarantine if r.batch_id == "b0"} == {hashlib.sha256(b'{"k":%d}' % k).hexdigest() for k in (0, 4)}
    t.undo(["b3", "b4"])
    check(path, W.write_batches(rows_of(spark), t, "batch", ["k"], ["k"], NAMES).collect())
    with pytest.raises(PythonException, match="other rows"):
        W.write_batches(rows_of(spark).withColumn("name", F.lit("x")), t, "batch", ["k"], ["k"], NAMES).collect()
    assert W.write_batches(rows_of(spark).limit(0), t, "batch", ["k"], ["k"], NAMES).count() == 0


def test_task_killed_midway(spark, path, tmp_path):
    marker = str(tmp_path / "died")
    t = W.Target(functools.partial(opened, path, "b6", marker), "pets", begin=("BEGIN IMMEDIATE",))
    done = W.write_batches(rows_of(spark), t, "batch", ["k"], ["k"], NAMES, writers=1)
    with pytest.raises(Exception, match="(?i)python worker|crashed|EOF"):
        done.collect()
    assert os.path.exists(marker)
    con = sqlite3.connect(path)
    assert con.execute("SELECT count(*) FROM pets WHERE _batch_id = 'b6'").fetchone()[0] == 0
    before = con.execute("SELECT count(*) FROM _batch_ledger").fetchone()[0]
    assert 0 < before < 10
    got = W.write_batches(rows_of(spark), t, "batch", ["k"], ["k"], NAMES, writers=1).collect()
    check(path, got)
    assert sum(r.already for r in got) == before


class Cursor:
    def __init__(self, con):
        self.con = con

    def __getattr__(self, name):
        return getattr(self.con.real, name)

    def execute(self, sql, *args):
        self.con.log.append(sql)
        if sql.startswith("INSERT INTO \"pets\"") and self.con.fails(args[0]):
            raise sqlite3.OperationalError("server is busy")
        self.last = self.con.raw.execute(sql, *args)

    def executemany(self, sql, rows):
        self.con.log.append(f"many {len(rows)}")
        for r in rows:
            if self.con.fails(r):
                raise sqlite3.OperationalError("server is busy")
        self.con.raw.executemany(sql, rows)

    def fetchone(self):
        return self.last.fetchone()

    def copy_expert(self, sql, text):
        self.con.copied.append((sql, text.read()))
        raise sqlite3.OperationalError("COPY failed")


class Connection:
    def __init__(self, path, fails, log, copied):
        self.raw, self.fails, self.log, self.copied = opened(path), fails, log, copied

    def cursor(self):
        return Cursor(self)

    def commit(self):
        self.raw.commit()

    def rollback(self):
        self.raw.rollback()

    def close(self):
        self.raw.close()


def test_transient_errors_are_tried_again(path):
    left, waits, log = {3: 2, 5: 99}, [], []

    def fails(row):
        left[row[0]] = left.get(row[0], 0) - 1
        return left[row[0]] >= 0

    t = W.Target(lambda: Connection(path, fails, log, []), "pets", begin=("BEGIN IMMEDIATE",), sleep=waits.append)
    t.create_ledger()
    out = W.BatchWriter(t, NAMES).write("b", [(i, "n", 1) for i in range(8)], [str(i) for i in range(8)])
    assert [(e["row_offset"], e["category"], e["retry_count"]) for e in out["quarantine"]] == [(5, "target_connection_error", 3)]
    assert out["n_stored"] == 7 and waits == [2, 4, 5]
    # two bad rows of 1024 take far fewer statements than rows
    log.clear()
    left.clear()
    out = W.BatchWriter(t, NAMES).write("c", [(100 + i, None if i in (17, 900) else "n", 1) for i in range(1024)], ["k"] * 1024)
    assert [e["row_offset"] for e in out["quarantine"]] == [17, 900] and len([x for x in log if x.startswith("many")]) < 50


def test_copy_falls_back_and_lost_connections(path):
    copied = []
    t = W.Target(lambda: Connection(path, lambda r: False, [], copied), "pets", begin=("BEGIN IMMEDIATE",), bulk=W.copy_rows)
    t.create_ledger()
    out = W.BatchWriter(t, NAMES).write("b", [(1, 'a,"b"', None), (2, None, 3)], ["1", "2"])
    assert copied == [('COPY "pets" ("id", "name", "owner", "_batch_id") FROM STDIN WITH (FORMAT csv, NULL \'\\N\')', '1,"a,""b""",\\N,b\n2,\\N,3,b\n')]
    assert [e["row_offset"] for e in out["quarantine"]] == [1]
    assert [W.copy_value(v) for v in (True, False, 1.5, "\\N", "x\ny")] == ["t", "f", "1.5", '"\\N"', '"x\ny"']
    tries = []

    def connect():
        tries.append(1)
        if len(tries) < 3:
            raise ConnectionError("no route")
        return opened(path)

    late = W.Target(connect, "pets", begin=("BEGIN IMMEDIATE",), sleep=lambda s: None)
    assert W.BatchWriter(late, NAMES).write("z", [(70, "n", 1)], ["70"])["n_written"] == 1
    gone = W.Target(lambda: 1 / 0, "pets", sleep=lambda s: None)
    with pytest.raises(W.TargetWriteError):
        W.BatchWriter(gone, NAMES).write("y", [(71, "n", 1)], ["71"])
    with pytest.raises(W.TargetSchemaError):
        W.BatchWriter(W.Target(connect, 'pets"; --'), NAMES)
