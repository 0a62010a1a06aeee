"""The bucketed state of a change stream against a plain dictionary."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.streaming.store import BucketStore, key_changes, replay_into

SCHEMA = "k long, v string, op string, lsn long"


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def test_batches_against_a_dictionary(spark, tmp_path):
    r, lsn, state = random.Random(4), 0, {}
    store = BucketStore(spark, str(tmp_path), ["k"], "op", ["lsn"], buckets=4, share=0.5, most=2)
    with pytest.raises(FileNotFoundError):
        store.current()
    for epoch in range(6):
        rows = []
        for _ in range(r.choice([0, 3, 30])):
            lsn += r.choice([1, 1, -5])  # some come late
            rows.append((r.randint(0, 40), f"v{lsn}", r.choice("IUUD"), lsn * 100 + len(rows)))
        for k, v, op, n in rows:
            if n > state.get(k, (None, None, -(10**9)))[2]:
                state[k] = (v, op, n)
        df = spark.createDataFrame(rows, SCHEMA)
        store.apply(df, epoch)
        if epoch == 3:  # a batch that is retried changes nothing
            store.apply(df, epoch)
        got = {x.k: x.v for x in store.current().collect()}
        assert got == {k: v for k, (v, op, _) in state.items() if op != "D"}
    assert len(store.epochs()) == 2
    named = {int(e) for e in os.listdir(tmp_path / "data")}
    m = store.manifest()
    assert {at["base"] for at in m.buckets.values() if at["base"] >= 0} <= named


def test_a_failed_batch_leaves_the_state(spark, tmp_path, monkeypatch):
    store = BucketStore(spark, str(tmp_path), ["k"], "op", ["lsn"], buckets=2)
    store.apply(spark.createDataFrame([(1, "a", "I", 1)], SCHEMA), 0)
    with monkeypatch.context() as m:
        m.setattr(store.folder, "write", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.apply(spark.createDataFrame([(1, "b", "U", 2), (2, "c", "I", 3)], SCHEMA), 1)
    assert [(r.k, r.v) for r in store.current().collect()] == [(1, "a")]
    store.apply(spark.createDataFrame([(1, "b", "U", 2), (2, "c", "I", 3)], SCHEMA), 1)
    assert sorted((r.k, r.v) for r in store.current().collect()) == [(1, "b"), (2, "c")]


def test_a_small_batch_writes_little(spark, tmp_path):
    n = 200_000
    text = F.sha2(F.col("id").cast("string"), 256)
    store = BucketStore(spark, str(tmp_path), ["k"], "op", ["lsn"], buckets=8)
    store.apply(spark.range(n).select(F.col("id").alias("k"), text.alias("v"), F.lit("I").alias("op"), F.col("id").alias("lsn")), 0)
    whole = size(tmp_path / "data" / f"{0:012d}")
    one = spark.range(n).where("id % 100 = 7").select(F.col("id").alias("k"), F.reverse(text).alias("v"), F.lit("U").alias("op"), (F.col("id") + n).alias("lsn"))
    assert store.apply(one, 1) == {"delta": n // 100, "base": 0}
    assert size(tmp_path / "data" / f"{1:012d}") < 0.02 * size(tmp_path / "data" / f"{0:012d}") and whole > 0
    few = spark.createDataFrame([(3, "x", "U", 10 * n)], SCHEMA)
    assert store.apply(few, 2) == {"delta": 1, "base": 0}
    assert len(os.listdir(tmp_path / "data" / f"{2:012d}" / "delta")) <= 4  # one bucket, and Spark's marks
    assert store.current().where("k in (3, 7, 8)").count() == 3 and store.current().count() == n
    # many changes of all buckets: they are merged
    assert store.apply(spark.range(n).select(F.col("id").alias("k"), F.lit("z").alias("v"), F.lit("U").alias("op"), (F.col("id") + 20 * n).alias("lsn")), 3)["base"] == n


def test_columns_that_come_later_and_changed_keys(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path), ["k"], "op", ["lsn"], buckets=2)
    store.apply(spark.createDataFrame([(1, "a", "I", 1)], SCHEMA), 0)
    moved = spark.createDataFrame([(5, 1, "U", 2, "b", 9), (6, None, "I", 3, "c", 8), (6, 6, "U", 4, "d", 7)], "k long, old long, op string, lsn long, v string, w int")
    store.apply(key_changes(moved, "k", "old", "op"), 1)
    assert sorted((r.k, r.v, r.w) for r in store.current().collect()) == [(5, "b", 9), (6, "d", 7)]
    with pytest.raises(ValueError, match="column w"):
        store.apply(spark.createDataFrame([(1, "x")], "k long, w string").withColumns({"op": F.lit("I"), "lsn": F.lit(9).cast("long")}), 2)


def test_replay_stops_goes_on_and_quarantines(spark, tmp_path):
    src = str(tmp_path / "in")
    for i in range(4):
        spark.createDataFrame([(i, f"v{i}", "I", i), (50 + i, None, "T", i)], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    store = BucketStore(spark, str(tmp_path / "state"), ["k"], "op", ["lsn"], buckets=2)

    def run(most):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        q = replay_into(stream, store, str(tmp_path / "cp"), F.when(F.col("op") == "T", "unmapped_column"), most)
        try:
            q.awaitTermination()
        except Exception as e:
            assert "stopped after" in str(e)

    run(2)
    assert store.current().count() == 2
    run(None)
    assert sorted(r.k for r in store.current().collect()) == [0, 1, 2, 3]
    bad = spark.read.parquet(str(tmp_path / "state" / "quarantine"))
    assert sorted(r.k for r in bad.collect()) == [50, 51, 52, 53] and {r.reason for r in bad.collect()} == {"unmapped_column"}
    assert json.loads((tmp_path / "state" / "manifests" / f"{3:012d}.json").read_text())["epoch"] == 3
