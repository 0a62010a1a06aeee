"""Replication messages as DataFrames, recorded segments and streams, against the sequential decoder."""

import json
import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from tessera.sources import replication as W
from tessera.sources.pgoutput import ParseError, State, decode

COLUMNS = [("id", 23, True), ("v", 25, False)]


def row(*values):
    return struct.pack(">H", len(values)) + b"".join(b"n" if v is None else b"u" if v is ... else b"t" + struct.pack(">I", len(str(v).encode())) + str(v).encode() for v in values)


def head(kind, oid):
    return kind + struct.pack(">I", oid)


def begin(lsn, xid):
    return b"B" + struct.pack(">QqI", lsn, lsn * 3, xid)


COMMIT = b"C" + b"\0" * 25


def messages(seed, transactions=12):
    r = random.Random(seed)
    out, wide = [W.relation_message(7, "s", "a", COLUMNS), W.relation_message(8, "s", "bé", COLUMNS)], False
    for x in range(transactions):
        out.append(begin((1 << 32) * x + 77, x + 1))
        for _ in range(r.randint(0, 9)):
            oid, extra = r.choice([7, 7, 7, 8]), ()
            extra = (r.choice([None, "w"]),) if wide and oid == 7 else ()
            new = row(r.randint(0, 99), r.choice([None, "x", "ü", ...]), *extra)
            out.append(r.choice([head(b"I", oid) + b"N" + new, head(b"U", oid) + b"K" + row(1, None, *extra) + b"N" + new, head(b"U", oid) + b"N" + new, head(b"D", oid) + b"O" + new, b"T" + struct.pack(">IBII", 2, 0, oid, 55), b"Y" + struct.pack(">I", 3) + b"x\0y\0"]))
        if x == transactions // 2:
            wide = True
            out.append(W.relation_message(7, "s", "a", [*COLUMNS, ("w", 25, False)]))
        if r.random() < 0.3:
            out += [head(b"I", 99) + b"N" + row(1), head(b"I", 7) + b"N" + row(1, "cut")[:-2], b""]
        out.append(COMMIT)
    return out


def sequential(slot, stream):
    """The changes as one decoder gives them, errors included."""
    state, out = State(), []
    for position, payload in stream:
        try:
            if not payload:
                raise ParseError("empty message")
            for e in decode(payload, state):
                out.append((slot, position, e["op"], e["table_name"], e["lsn"], e["xid"], e["seq"], e["before"], e["after"], False))
        except ParseError:
            out.append((slot, position, payload[:1].decode() or None, None, f"{state.lsn >> 32:X}/{state.lsn & 0xFFFFFFFF:X}", state.xid, state.seq, None, None, True))
            state.seq += 1
    return out


def as_tuples(rows):
    load = lambda x: None if x is None else json.loads(x)
    return sorted([(r.slot, r.position, r.op, r.table_name, r.lsn, r.xid, r.seq, load(r.before), load(r.after), r.error is not None) for r in rows], key=repr)


def test_decoded_side_by_side(spark):
    streams = {s: [(10 * i + 5, m) for i, m in enumerate(messages(k))] for k, s in enumerate(["a", "b"])}
    df = spark.createDataFrame([(s, p, m) for s, ms in streams.items() for p, m in ms], W.MESSAGES).repartition(5)
    want = sorted([e for s, ms in streams.items() for e in sequential(s, ms)], key=repr)
    assert as_tuples(W.decoded(df).collect()) == want and len(want) > 60
    assert W.decoded(df.limit(0)).count() == 0
    before_any = spark.createDataFrame([("z", 1, head(b"I", 7) + b"N" + row(1, "x"))], W.MESSAGES)
    assert [(r.error, r.xid, r.seq) for r in W.decoded(before_any).collect()] == [("unknown relation 7", 0, 0)]


def test_state_is_carried_between_batches(spark, tmp_path):
    ms = [(i, m) for i, m in enumerate(messages(5))]
    cuts = [0, 1, 9, 10, 37, len(ms)]
    src = str(tmp_path / "in")
    got = []
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        spark.createDataFrame([("s", p, m) for p, m in ms[a:b]], W.MESSAGES).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(W.MESSAGES).parquet(src)  # a run for each file: the state comes from the folder
        q = W.replay_messages(stream, str(tmp_path / "state"), str(tmp_path / "cp"), lambda d, e: got.append((e, d.collect())))
        q.awaitTermination()
        assert q.exception() is None and len(got) == k + 1
    assert [e for e, _ in got] == list(range(len(cuts) - 1))
    assert as_tuples([r for _, rows in got for r in rows]) == sorted(sequential("s", ms), key=repr)
    assert sorted(os.listdir(tmp_path / "state"))[-2:] == [f"epoch={len(cuts) - 3}", f"epoch={len(cuts) - 2}"]


def test_segments_restart_from_a_checkpoint(spark, tmp_path):
    folder, out, cp = (str(tmp_path / x) for x in ("wal", "out", "cp"))
    ms = [(100 * i, m) for i, m in enumerate(messages(9, 40)) if m[:1] not in (b"",)]
    want = [(p, op, x, q) for _, p, op, _, _, x, q, *_ in sequential("main", ms)]
    writer = W.SegmentWriter(folder, limit=600)
    W.register(spark)

    def run():
        q = W.change_stream(spark, "postgres", path=folder).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
        return spark.read.parquet(out)

    seen = []
    for a, b in ((0, 90), (90, 91), (91, len(ms))):
        for p, m in ms[a:b]:
            writer.append(p, m)
        if b == len(ms):
            writer.close()
        seen.append(run().count())
    assert 0 < seen[0] <= seen[1] < seen[2] == len(want)
    got = [(r.position, r.op, r.xid, r.seq) for r in spark.read.parquet(out).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)  # each change once
    names = sorted(n for n in os.listdir(folder) if n.endswith(".wal"))
    assert len(names) > 5 and not [n for n in os.listdir(folder) if n.startswith(".") and not n.endswith(".crc")]
    batch = spark.read.format("wal_segments").option("path", folder).load()
    assert batch.count() == len(want) and batch.rdd.getNumPartitions() == len(names)
    late = spark.readStream.format("wal_segments").option("path", folder).option("after", names[3][:16]).load()
    q = late.writeStream.format("memory").queryName("late_changes").option("checkpointLocation", cp + "2").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("late_changes").agg(F.min("position")).first()[0] >= int(names[4][:16], 16)
    with pytest.raises(ParseError):
        list(W.segment_messages(b"\0" * 13))


def test_source_registry(spark, tmp_path):
    assert set(W.SOURCES) == {"postgres", "oracle", "mysql"}
    with pytest.raises(ValueError, match="known: mysql, oracle, postgres"):
        W.change_stream(spark, "db2", path=str(tmp_path))
    for dialect in ("oracle", "mysql"):
        with pytest.raises(NotImplementedError):
            W.change_stream(spark, dialect, path=str(tmp_path))
    assert spark.read.format("wal_segments").option("path", str(tmp_path / "none")).load().count() == 0
