"""Timers, lag and deadlines."""

import json
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import cdc, deadline
from tessera.streaming import bus, expiry, lag
from tessera.streaming import cdc as stream_cdc


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    expiry.rocksdb_state(spark)
    yield
    spark.conf.set(key, before)


def fed(spark, tmp_path, schema, batches):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(stream, name, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None
    return q


#: Events begin after the epoch, where watermarks do.
START = 1_000_000.0


def test_expiring_store(spark, tmp_path, rocksdb):
    schema = "key string, at double, action string, value string"
    batches = [
        [("a", 0.0, "put", "x"), ("b", 1.0, "put", "y"), ("a", 10.0, "pop", None), ("a", 11.0, "pop", None), ("e", 2.0, "put", "old"), ("e", 12.0, "put", "new")],
        [("c", 20.0, "pop", None), ("d", 21.0, "put", "z")],
        [("e", 130.0, "pop", None), ("d", 145.0, "pop", None)],  # e's second value lives until 132, d's until 141
        [("t", 900.0, "pop", None)],
        [("t", 901.0, "pop", None)],
    ]
    batches = [[(k, START + at, *rest) for k, at, *rest in b] for b in batches]
    q = run(expiry.expiring_store(fed(spark, tmp_path, schema, batches)), "expiring", tmp_path)
    got = sorted((r.key, r.at - START, r.value, r.status) for r in spark.table("expiring").collect())
    assert got == [("a", 10.0, "x", "found"), ("a", 11.0, None, "missing"), ("b", 121.0, None, "expired"), ("c", 20.0, None, "missing"), ("d", 141.0, None, "expired"), ("d", 145.0, None, "missing"), ("e", 130.0, "new", "found"), ("t", 900.0, None, "missing"), ("t", 901.0, None, "missing")]
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0  # nothing stays


def test_in_flight(spark, tmp_path, rocksdb):
    schema = "agent string, key string, request string, action string, result string, at double"
    batches = [
        [("m", "k", "r1", "acquire", None, 0.0), ("m", "k", "r2", "acquire", None, 1.0), ("n", "k", "r3", "acquire", None, 1.0)],
        [("m", "k", "r4", "acquire", None, 5.0), ("m", "k", None, "complete", "done", 6.0), ("m", "k", "r5", "acquire", None, 7.0), ("m", "x", None, "complete", "late", 7.0)],
        [("z", "z", "r6", "acquire", None, 500.0), ("z", "z", None, "complete", "ok", 501.0)],
        [("z", "z", None, "complete", "ok", 502.0)],
    ]
    batches = [[(*rest, START + at) for *rest, at in b] for b in batches]
    q = run(expiry.in_flight(fed(spark, tmp_path, schema, batches)), "flight", tmp_path)
    got = {(r.request, r.status, r.at - START, r.result) for r in spark.table("flight").collect()}
    assert got == {
        ("r1", "leader", 0.0, None), ("r2", "follower", 1.0, None), ("r3", "leader", 1.0, None), ("r4", "follower", 5.0, None),
        ("r1", "completed", 6.0, "done"), ("r2", "completed", 6.0, "done"), ("r4", "completed", 6.0, "done"), ("r5", "leader", 7.0, None),
        ("r3", "abandoned", 121.0, None), ("r5", "abandoned", 127.0, None), ("r6", "leader", 500.0, None), ("r6", "completed", 501.0, "ok"),
    }
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0


def test_repeated_keys_within_the_watermark(spark, tmp_path):
    events = fed(spark, tmp_path, "agent string, key string, at double", [[("m", "k", 0.0), ("m", "k", 1.0), ("n", "k", 1.0)], [("m", "k", 5.0), ("m", "j", 5.0)]])
    run(stream_cdc.deduplicated(events.withColumn("ts", F.timestamp_seconds("at")), ["agent", "key"], "ts", "1 minute"), "once", tmp_path)
    assert spark.table("once").groupBy("agent", "key").count().where("count > 1").count() == 0 and spark.table("once").count() == 3


def test_ticker(spark, tmp_path):
    q = bus.ticker(fed(spark, tmp_path, "kind string", [[("a",), ("b",), ("a",)]]), ["kind"], "ticks_now", str(tmp_path / "cp"), "100 milliseconds")
    try:
        q.processAllAvailable()
        assert {(r.kind, r.n) for r in spark.table("ticks_now").collect()} == {("a", 2), ("b", 1)}
    finally:
        q.stop()


def test_lag_monitor(spark, tmp_path):
    at, times, said = {"source": "1/10", "applied": "1/0"}, iter(range(100)), [(3, 0, []), (10, 2, ["Y"]), (10, 2, ["Y", "M"]), (4, 2, [])]

    def applied():
        if at["applied"] is None:
            raise ConnectionError("gone")
        return at["applied"]

    m = lag.LagMonitor(spark, str(tmp_path), "u", lambda: at["source"], applied, lambda: said.pop(0), rate=4.0, clock=lambda: float(next(times)))
    first = m.tick()
    assert (first["lag_bytes"], first["lag_seconds"], first["events"]) == (16, 4.0, 3)
    at["applied"] = None
    second = m.tick()
    assert (second["lag_bytes"], second["applied_unreachable"], second["events"], second["quarantined"]) == (None, True, 7, 2)
    at["applied"], at["source"] = "2/0", None
    assert (m.tick()["lag_bytes"], m.tick()["events"]) == (None, 0)
    rows = lag.ticks(spark, str(tmp_path)).orderBy("tick").collect()
    assert [r.tick for r in rows] == [0.0, 1.0, 2.0, 3.0] and rows[3].unhandled == ["Y", "M"]
    assert json.loads((tmp_path / "ticks" / "u-000000001.json").read_text())["lag_seconds"] is None


def test_listener_of_a_real_stream_feeds_cutover(spark, tmp_path):
    confirmed = []
    m = lag.LagMonitor(spark, str(tmp_path / "lag"), "orders", lambda: "0/64", lambda: "0/64" if confirmed else "0/0")
    listener = lag.LagListener(m, "heard", confirmed.append)
    spark.streams.addListener(listener)
    try:
        stream = fed(spark, tmp_path, "k long", [[(1,)], [(2,)], [(3,)]])
        run(stream, "heard", tmp_path)
        until = time.time() + 20
        while m.n < 3 and time.time() < until:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    rows = lag.ticks(spark, str(tmp_path / "lag"))
    assert rows.count() >= 3 and {r.lag_bytes for r in rows.collect()} == {0, 100} and 1 <= len(confirmed) <= 3
    out = cdc.cutover(lag.cutover_ticks(rows), "unit", "tick", "lag", "up", "parity").collect()
    assert len(out) == rows.count() and {r.action for r in out} <= {"wait", "reset", "operator_sign"}


def test_deadline_keeps_exactly_what_is_finished(spark, tmp_path):
    root = str(tmp_path / "scan")

    def slow(batches):
        for b in batches:
            time.sleep(60)
            yield b

    df = spark.range(100)
    chunks = deadline.hashed_chunks(df, "id", 3)
    stuck = df.repartition(1).mapInArrow(slow, "id long")
    bad = df.select(F.raise_error("broken").cast("long").alias("id"))
    began = time.monotonic()
    out = deadline.run_until(spark, {**chunks, "stuck": stuck, "bad": bad}, root, seconds=15, parallel=2)
    assert time.monotonic() - began < 40
    assert out.finished == sorted(chunks) and out.unfinished == ["stuck"] and "bad" in out.failed
    got = deadline.results(spark, root)
    assert sorted(r.id for r in got.collect()) == list(range(100)) and {r.chunk for r in got.select("chunk").distinct().collect()} == set(chunks)
    again = deadline.run_until(spark, {**chunks, "stuck": df.limit(1)}, root, seconds=60)
    assert again.finished == sorted([*chunks, "stuck"]) and deadline.results(spark, root).count() == 101
    none = deadline.run_until(spark, chunks, str(tmp_path / "other"), seconds=0)
    assert none.finished == [] and deadline.results(spark, str(tmp_path / "other")) is None
