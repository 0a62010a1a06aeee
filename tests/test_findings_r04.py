"""What the findings of round 4 were about."""

import dataclasses
import datetime
import math
import sqlite3

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import mapping
from tessera.operators import matching
from tessera.plans import write_queries
from tessera.sources import target_writer as W


def against_sql(spark, name, folder, tables):
    """Rows of a query and of its SQL over the same folder."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    found = con.execute(catalog.SQL[name])
    names = [d[0] for d in found.description]
    want = sorted(found.fetchall(), key=repr)
    return sorted((tuple(r) for r in catalog.QUERIES[name](spark, str(folder)).select(*names).collect()), key=repr), want


def test_timestamps_without_a_fraction(spark, tmp_path):
    # 15625 days of 86400.123456 s are whole seconds; the last ids lie beyond the year 9999
    spark.createDataFrame([(i,) for i in (0, 1, 15624, 15625, 31250, 2_932_896, 36_000_000)], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    got, want = against_sql(spark, "pg_timestamps", tmp_path, ["events"])
    assert got == want and len(got) == 6
    micros = [0, 1, 1_000_000, -1, 86_400_000_000 * 15625]
    df = spark.createDataFrame([(m,) for m in micros], "m long")
    for spec in ("auto", "microseconds"):
        epoch = datetime.datetime(2000, 1, 1, tzinfo=datetime.UTC)
        assert {r.m: r.t for r in df.select("m", mapping.pg_timestamp(F.col("m"), spec).alias("t")).collect()} == {m: (epoch + datetime.timedelta(microseconds=m)).isoformat(timespec=spec) for m in micros}


def test_precision_bounds(spark, tmp_path):
    balances = [-999.99, -999.0, -5000.0, 999.0, 999.01, 1000.0, 5000.0, None, 0.0]
    spark.createDataFrame([(11 + 35 * i, b) for i, b in enumerate(balances)], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    got, want = against_sql(spark, "property_checks", tmp_path, ["supplier"])
    assert got == want == [(0, 0, 3)]
    df = spark.createDataFrame([(b, b) for b in balances], "a double, b double")
    # a target of three digits takes magnitudes below 1000
    assert mapping.property_checks(df, "a", "b", precision=3).first().within_target_precision == 3


DDL = "CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT NOT NULL, _batch_id TEXT NOT NULL, UNIQUE (_batch_id, v))"


def written(target, rows, batch="b", log=None):
    writer = W.BatchWriter(target, ["id", "v"])
    target.create_ledger()
    writer.con = target.connect()
    if log is not None:
        writer.con.set_trace_callback(log.append)
    try:
        return writer.write(batch, rows, [str(r[0]) for r in rows])
    finally:
        writer.close()


def test_rows_are_sent_once(tmp_path):
    # a fourth of the rows is refused: missing values, values and ids that are there, the first and the last row
    rows = [(i - 3 if i % 13 == 5 else i, None if i % 11 == 0 or i == 999 else "same" if i % 17 == 0 else f"v{i}") for i in range(1000)]
    log = []
    target = write_queries.sqlite_target(str(tmp_path / "a.db"), DDL, "t")
    got = written(target, rows, log=log)
    assert sum(x.startswith('INSERT INTO "t"') for x in log) == len(rows)
    halved = written(dataclasses.replace(write_queries.sqlite_target(str(tmp_path / "b.db"), DDL, "t"), stepwise=False), rows)
    assert got == halved and len(got["quarantine"]) > 200 and got["n_stored"] == got["n_written"]
    assert written(target, rows) == got | {"already": True}
    assert written(target, [], "empty")["n_rows"] == 0


def test_other_errors_leave_the_pass(tmp_path):
    target = dataclasses.replace(write_queries.sqlite_target(str(tmp_path / "a.db"), DDL, "t"), sleep=lambda s: None)
    # a number that the driver does not take is no broken constraint
    got = written(target, [(1, "a"), (2**70, "b"), (2, None), (3, "c")])
    assert [(e["row_offset"], e["category"]) for e in got["quarantine"]] == [(1, "target_connection_error"), (2, "target_constraint_violation")] and got["n_stored"] == 2
    # a refusal that ends the transaction leaves nothing behind
    path = str(tmp_path / "c.db")
    lost = dataclasses.replace(write_queries.sqlite_target(path, DDL.replace("NOT NULL,", "NOT NULL ON CONFLICT ROLLBACK,"), "t"), sleep=lambda s: None)
    with pytest.raises(W.TargetWriteError):
        written(lost, [(1, "a"), (2, None), (3, "c")])
    assert sqlite3.connect(path).execute("SELECT count(*) FROM t").fetchone()[0] == 0


def table_of(spark, folder, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{folder}/embeddings.parquet")


def test_nearest_targets(spark, tmp_path, monkeypatch):
    # small units, parts and tiles; copies, turned and stretched copies, vectors that are missing or not finite
    for name, value in (("UNIT", 16), ("PART", 32), ("TILE", 8), ("CHUNK", 4), ("PAIRS", 64)):
        monkeypatch.setattr(matching, name, value)
    r = np.random.default_rng(4)
    some = r.standard_normal((40, 6)).astype(np.float32)
    rows = [(i, (some[i % 7] if i % 3 == 0 else some[r.integers(40)] * float(2 ** r.integers(3)) if i % 3 == 1 else r.standard_normal(6)).tolist()) for i in range(200)]
    rows += [(200, None), (201, None), (203, None), (204, [math.inf, *[1.0] * 5]), (205, [math.nan] * 6)]
    table_of(spark, tmp_path, rows)
    for name in ("embedding_top3", "mapping_status", "mapping_counts"):
        got, want = against_sql(spark, name, tmp_path, ["embeddings"])
        assert repr(got) == repr(want)
    # in one tile as in many
    few = tmp_path / "few"
    table_of(spark, few, [(i, some[i % 40].tolist()) for i in (0, 1, 2, 4, 5)])
    got, want = against_sql(spark, "embedding_top3", few, ["embeddings"])
    assert repr(got) == repr(want) and len(got) == 6


def test_pairs_are_left_out_by_blocks():
    r = np.random.default_rng(4)
    x, y = r.standard_normal((64, 16)), r.standard_normal((8192, 16))
    near, compared = matching.Nearest(np.arange(64), x, 3), []
    merge = near._merge
    near._merge = lambda i, *rest: (compared.append(len(i)), merge(i, *rest))
    for a in range(0, len(y), 1024):
        near.add(np.arange(a, a + 1024), y[a : a + 1024])
    ids, targets, sims = near.hits()
    full = matching.unit(x) @ matching.unit(y).T
    assert (targets.reshape(64, 3) == np.argsort(-full, axis=1)[:, :3]).all() and np.allclose(sims.reshape(64, 3), -np.sort(-full, axis=1)[:, :3])
    assert sum(compared) < full.size / 100


def bounds(spark, folder):
    """Leads of nearly 0.05, best similarities of nearly 0.6 and 0.85: rounded to six digits they are at the bounds."""
    rows, at = [], 0
    for n, (best, second) in enumerate([(0.9, 0.85 + 2e-7), (0.9, 0.85 - 2e-7), (0.6 - 3e-7, 0.1), (0.6 + 3e-7, 0.1), (0.85 - 3e-7, 0.1), (0.85 + 3e-7, 0.1)]):
        for i, (x, y) in ((0, (1.0, 0.0)), (1, (best, math.sqrt(1 - best**2))), (3, (second, math.sqrt(1 - second**2)))):
            rows.append((at + i, [0.0] * (2 * n) + [x, y] + [0.0] * (10 - 2 * n)))
        at += 4
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{folder}/embeddings.parquet")


def test_status_of_similarities_that_are_not_rounded(spark, tmp_path):
    bounds(spark, tmp_path)
    got, want = against_sql(spark, "mapping_status", tmp_path, ["embeddings"])
    assert got == want and [s for _, s in sorted(want)] == ["ambiguous", "ok", "no_match", "low_confidence", "low_confidence", "ok"]


def test_counts_of_statuses(spark, tmp_path):
    bounds(spark, tmp_path)
    got, want = against_sql(spark, "mapping_counts", tmp_path, ["embeddings"])
    assert got == want == [(2, 2, 1, 1, True)]
