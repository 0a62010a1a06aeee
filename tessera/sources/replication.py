"""Change streams from logical replication messages: a DataFrame form of the decoder, a stream of recorded segments, and
a stream over messages from any Spark source.

What a message means depends on what came before it in its slot: the transaction it is in and the last description of its
table.  In ``decoded`` these are found by range-partitioned running values and an as-of join, so messages are
decoded side by side.  A recorded segment holds whole transactions and describes its tables itself, so
segments are decoded side by side too, and a position is all that a stream must remember.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.window import Window

from ..operators.cdc import lsn_text
from ..operators.ordered import greatest_before, positions
from .pgoutput import ParseError, State, decode

CHANGES = "slot string, position long, op string, schema_name string, table_name string, lsn string, xid long, seq long, commit_micros long, before string, after string, key_columns array<string>, error string"
MESSAGES = "slot string, position long, payload binary"
#: What must be known of earlier messages: the last description of each table and the last transaction, with its changes so far.
CARRIED = "slot string, position long, payload binary, n long"
_ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64()}.get(t, pa.list_(pa.string()))) for n, t in (f.split() for f in CHANGES.split(", "))])


def _number(payload: Column, start: int | Column, n: int) -> Column:
    """The unsigned big-endian number of ``n`` bytes from byte ``start`` (from 1) on; null where the message is shorter."""
    cut = F.substring(payload, start, n)
    return F.when(F.octet_length(cut) == n, F.conv(F.hex(cut), 16, 10).cast("decimal(20, 0)").cast("long"))


def _kind(payload: Column) -> Column:
    return F.substring(payload, 1, 1).cast("string")


def _heads(messages: DataFrame, known: DataFrame | None) -> DataFrame:
    """(slot, position, payload, n, kind, oid): a truncation is a row for each of its tables."""
    m = messages.select(F.col("slot").cast("string").alias("slot"), F.col("position").cast("long").alias("position"), "payload", F.lit(None).cast("long").alias("n"))
    if known is not None:
        m = m.union(known.select("slot", "position", "payload", "n"))
    p = F.col("payload")
    kind = F.when(F.octet_length(p) > 0, _kind(p)).otherwise("")
    m = m.withColumn("kind", kind).withColumn("many", F.when(F.col("kind") == "T", _number(p, 2, 4)))
    places = F.when(F.col("many") > 0, F.sequence(F.lit(0), F.least("many", F.floor((F.octet_length(p) - 6) / 4)).cast("int") - 1)).otherwise(F.array(F.lit(0)))
    m = m.withColumn("place", F.explode(places))
    oid = F.when(F.col("kind") == "T", _number(p, F.lit(7) + 4 * F.col("place"), 4)).when(F.col("kind").isin("R", "I", "U", "D"), _number(p, 2, 4))
    return m.select("slot", "position", "place", "payload", "n", "kind", oid.alias("oid"))


def decoded(messages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The changes (see ``CHANGES``) of messages (slot, position, payload), whose positions order a slot.

    ``known`` is what ``carried`` has of earlier messages.  A truncation gives a change for each table that is known.  A change of a
    table that no earlier message describes, a message that is cut short and an empty one have an ``error`` and no values;
    messages of other kinds give nothing.  ``before`` and ``after`` are JSON; an unchanged large value has no entry.
    """
    heads = _heads(messages, known)
    p = F.col("payload")
    begin = F.when(F.col("kind") == "B", F.struct(F.col("position").alias("at"), _number(p, 2, 8).alias("lsn"), _number(p, 10, 8).alias("micros"), _number(p, 18, 4).alias("xid"), F.coalesce("n", F.lit(0)).alias("base")))
    narrow = heads.select("slot", "position", "place", "kind", "oid", begin.alias("begin"))
    placed = greatest_before(narrow, ["slot"], ["position", "place"], F.col("begin"), "tx")
    placed = placed.where(F.col("kind").isin("I", "U", "D", "T", "")).withColumn("at", F.col("tx.at"))
    # versions of a table's description, each up to the next
    r = heads.where("kind = 'R'").select("slot", "oid", F.col("position").alias("since"), F.col("payload").alias("described"))
    r = r.withColumn("until", F.lead("since").over(Window.partitionBy("slot", "oid").orderBy("since")))
    r = r.select(F.col("slot").alias("r_slot"), F.col("oid").alias("r_oid"), "since", "until", "described")
    same = F.col("slot").eqNullSafe(F.col("r_slot")) & (F.col("oid") == F.col("r_oid")) & (F.col("since") < F.col("position")) & (F.col("until").isNull() | (F.col("position") < F.col("until")))
    events = placed.join(r, same, "left").where("kind <> 'T' or described is not null").select("slot", "position", "place", "kind", "oid", "tx", "at", "described")
    events = positions(events, ["slot", "at"], ["position", "place"], "seq").withColumn("seq", F.col("seq") + F.coalesce("tx.base", F.lit(0)))
    own = messages.select(F.col("slot").cast("string").alias("m_slot"), F.col("position").cast("long").alias("m_position"), "payload")
    events = events.join(own, F.col("slot").eqNullSafe(F.col("m_slot")) & (F.col("position") == F.col("m_position")))
    events = events.select("slot", "position", "seq", "kind", "oid", lsn_text(F.coalesce("tx.lsn", F.lit(0))).alias("lsn"), F.coalesce("tx.xid", F.lit(0)).alias("xid"), F.coalesce("tx.micros", F.lit(0)).alias("micros"), "described", "payload")
    return events.mapInArrow(_decode_rows, CHANGES)


def _decode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    states: dict[bytes, State] = {}
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            base = {"slot": row["slot"], "position": row["position"], "op": row["kind"] or None, "lsn": row["lsn"], "xid": row["xid"], "seq": row["seq"], "commit_micros": row["micros"]}
            try:
                out.append(base | _change(row, states))
            except ParseError as e:
                out.append(base | {"error": str(e)})
        yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in _ARROW.names} for r in out], _ARROW)


def _change(row: dict, states: dict[bytes, State]) -> dict:
    described = row["described"]
    if described is None:
        raise ParseError(f"unknown relation {row['oid']}" if row["kind"] else "empty message")
    if described not in states:
        states[described] = State()
        decode(described, states[described])
    rel = next(iter(states[described].relations.values()), None)
    if rel is None:
        raise ParseError("unreadable relation")
    if row["kind"] == "T":
        return shown({"schema_name": rel.schema, "table_name": rel.name, "before": None, "after": None, "key_columns": [c for c, _, k in rel.columns if k]})
    (e,) = decode(row["payload"], replace(states[described]))
    return shown({k: e[k] for k in ("schema_name", "table_name", "before", "after", "key_columns")})


def shown(event: dict) -> dict:
    """Images of rows as JSON."""
    return event | {k: None if event[k] is None else json.dumps(event[k]) for k in ("before", "after")}


def carried(messages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """What later messages need of these and of ``known``: a row for each table and one for each slot (see ``CARRIED``)."""
    heads = _heads(messages, known)
    tables = heads.where("kind = 'R'").groupBy("slot", "oid").agg(F.max_by(F.struct("position", "payload"), "position").alias("m")).select("slot", "m.position", "m.payload", F.lit(None).cast("long").alias("n"))
    last = heads.where("kind = 'B'").groupBy("slot").agg(F.max_by(F.struct("position", "payload", F.coalesce("n", F.lit(0)).alias("n")), "position").alias("m"))
    last = last.select(F.col("slot").alias("b_slot"), "m")
    # changes of the open transaction so far; truncated tables that are not described do not count
    known_tables = tables.select(F.col("slot").alias("k_slot"), _number(F.col("payload"), 2, 4).alias("k_oid")).distinct()
    counted = heads.where(F.col("kind").isin("I", "U", "D", "T", "")).join(last, F.col("slot").eqNullSafe(F.col("b_slot"))).where(F.col("position") > F.col("m.position"))
    counted = counted.join(known_tables, F.col("slot").eqNullSafe(F.col("k_slot")) & (F.col("oid") == F.col("k_oid")), "left").where("kind <> 'T' or k_oid is not null")
    n = counted.groupBy("slot").agg(F.count(F.lit(1)).alias("c")).withColumnRenamed("slot", "c_slot")
    open_ = last.join(n, F.col("b_slot").eqNullSafe(F.col("c_slot")), "left").select(F.col("b_slot").alias("slot"), "m.position", "m.payload", (F.col("m.n") + F.coalesce("c", F.lit(0))).alias("n"))
    return tables.union(open_)


def replay_messages(messages: DataFrame, root: str, checkpoint: str, publish: Callable[[DataFrame, int], None]):
    """Hands the changes of each micro-batch of a stream (slot, position, payload) to ``publish(changes, epoch)``.

    What a batch needs of earlier ones lies under ``root``, one small table for each epoch, so a batch that is retried
    finds what it found before.  The positions of a slot must grow from batch to batch.
    """

    def one(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        known = spark.read.schema(CARRIED).parquet(f"{root}/epoch={epoch - 1}") if epoch else None
        publish(decoded(batch, known), epoch)
        carried(batch, known).coalesce(1).write.mode("overwrite").parquet(f"{root}/epoch={epoch}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/epoch={epoch - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return messages.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# Recorded segments


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


class SegmentWriter:
    """Records messages in segments named by the position of their first message.

    A segment ends between transactions, once it has ``limit`` bytes, and begins with the descriptions of all tables known
    so far.  It gets its name when it is complete, so readers never see a part of one.  A message is a
    position (8 bytes), a length (4 bytes) and the payload.
    """

    def __init__(self, folder: str, limit: int = 1 << 26) -> None:
        self.files, self.folder = _open(folder)
        self.files.create_dir(self.folder)
        self.limit, self.described, self.held, self.size, self.first, self.busy = limit, {}, [], 0, None, False

    def append(self, position: int, payload: bytes) -> None:
        kind = payload[:1]
        if self.first is None:
            self.first = position
            for d in self.described.values():
                self._add(position, d)
        self._add(position, payload)
        if kind == b"R":
            self.described[payload[1:5]] = payload
        self.busy = kind == b"B" or self.busy and kind != b"C"
        if self.size >= self.limit and not self.busy:
            self.close()

    def _add(self, position: int, payload: bytes) -> None:
        self.held.append(struct.pack(">QI", position, len(payload)) + payload)
        self.size += len(self.held[-1])

    def close(self) -> None:
        """Completes the segment at hand.  An unfinished transaction stays with the recorder."""
        if self.first is None or self.busy:
            return
        part = f"{self.folder}/.{uuid.uuid4().hex}"
        with self.files.open_output_stream(part) as f:
            f.write(b"".join(self.held))
        self.files.move(part, f"{self.folder}/{self.first:016x}.wal")
        self.held, self.size, self.first = [], 0, None


def segment_messages(raw: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(raw):
        if at + 12 > len(raw):
            raise ParseError(f"segment ends within a message at byte {at}")
        position, n = struct.unpack_from(">QI", raw, at)
        if at + 12 + n > len(raw):
            raise ParseError(f"segment ends within a message at byte {at}")
        yield position, raw[at + 12 : at + 12 + n]
        at += 12 + n


@dataclass
class Segment(InputPartition):
    path: str


def _segments(folder: str, after: str, to: str | None = None) -> list[str]:
    files, path = _open(folder)
    found = files.get_file_info(fs.FileSelector(path, allow_not_found=True))
    names = sorted(f.base_name for f in found if f.base_name.endswith(".wal"))
    return [n for n in names if n > after and (to is None or n <= to)]


def _read_segment(folder: str, slot: str, name: str) -> Iterator[tuple]:
    """The changes of one segment, decoded where this runs."""
    files, path = _open(folder)
    with files.open_input_stream(f"{path}/{name}") as f:
        raw = f.read()
    state, first = State(), None
    for position, payload in segment_messages(raw):
        base = {"slot": slot, "position": position}
        try:
            if not payload:
                raise ParseError("empty message")
            for e in decode(payload, state):
                yield _row(base | shown(e) | {"commit_micros": state.micros, "error": None})
        except ParseError as e:
            head = {"op": payload[:1].decode("latin-1") or None, "lsn": f"{state.lsn >> 32:X}/{state.lsn & 0xFFFFFFFF:X}", "xid": state.xid, "seq": state.seq, "commit_micros": state.micros, "error": str(e)}
            state.seq += 1
            yield _row(base | head)


def _row(values: dict) -> tuple:
    return tuple(values.get(n) for n in _ARROW.names)


class _Reader(DataSourceReader):
    def __init__(self, folder: str, slot: str) -> None:
        self.folder, self.slot = folder, slot

    def partitions(self) -> Sequence[InputPartition]:
        return [Segment(n) for n in _segments(self.folder, "")] or [Segment("")]

    def read(self, partition: Segment) -> Iterator[tuple]:
        return _read_segment(self.folder, self.slot, partition.path) if partition.path else iter(())


class _StreamReader(DataSourceStreamReader):
    """Offsets are names of segments, that is, positions of their first messages: the driver lists names and reads nothing."""

    def __init__(self, folder: str, slot: str, start: str) -> None:
        self.folder, self.slot, self.start = folder, slot, start

    def initialOffset(self) -> dict:
        return {"segment": self.start}

    def latestOffset(self) -> dict:
        return {"segment": max([self.start, *_segments(self.folder, self.start)[-1:]])}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [Segment(n) for n in _segments(self.folder, start["segment"], end["segment"])]

    def read(self, partition: Segment) -> Iterator[tuple]:
        return _read_segment(self.folder, self.slot, partition.path)


class WalSegments(DataSource):
    """Format ``wal_segments``: changes (see ``CHANGES``) of the segments in a folder, as a table or as a stream.

    Options: ``path``, ``slot`` (default ``main``), for streams ``after``: a position in hexadecimal digits up to which segments
    are left out.  A task for each segment.
    """

    @classmethod
    def name(cls) -> str:
        return "wal_segments"

    def schema(self) -> str:
        return CHANGES

    def _options(self) -> tuple[str, str]:
        return self.options["path"], self.options.get("slot", "main")

    def reader(self, schema) -> DataSourceReader:
        return _Reader(*self._options())

    def streamReader(self, schema) -> DataSourceStreamReader:
        after = self.options.get("after", "")
        return _StreamReader(*self._options(), f"{after.zfill(16)}.wal" if after else "")


def unavailable(name: str, reason: str) -> type[DataSource]:
    """A format that is known and cannot be read."""

    class Unavailable(DataSource):
        def schema(self) -> str:
            raise NotImplementedError(f"{name}: {reason}")

    Unavailable.name = classmethod(lambda cls: name)
    return Unavailable


#: Change sources by dialect.
SOURCES = {"postgres": WalSegments, "oracle": unavailable("oracle_changes", "change capture of Oracle is not built"), "mysql": unavailable("mysql_changes", "change capture of MySQL is not built")}


def register(spark: SparkSession) -> None:
    for source in SOURCES.values():
        spark.dataSource.register(source)


def change_stream(spark: SparkSession, dialect: str, **options: str) -> DataFrame:
    """A stream of changes of a database, by its dialect."""
    if dialect not in SOURCES:
        raise ValueError(f"no change source for {dialect!r}; known: {', '.join(sorted(SOURCES))}")
    source = SOURCES[dialect]
    if source is not WalSegments:
        raise NotImplementedError(f"change capture of {dialect} is not built")
    spark.dataSource.register(source)
    return spark.readStream.format(source.name()).options(**options).load()


# Building messages with column expressions


def number(v: Column, n: int) -> Column:
    """``n`` bytes of a number, big-endian."""
    return F.unhex(F.lpad(F.hex(v.cast("long")), 2 * n, "0"))


def tuple_data(values: Sequence[Column]) -> Column:
    """A row of texts as the protocol has it: nulls marked, others with their length."""
    parts = [F.when(v.isNull(), F.unhex(F.lit("6E"))).otherwise(F.concat(F.unhex(F.lit("74")), number(F.octet_length(v.cast("string")), 4), v.cast("string").cast("binary"))) for v in values]
    return reduce(F.concat, parts, number(F.lit(len(parts)), 2))


def relation_message(oid: int, schema: str, table: str, columns: Sequence[tuple[str, int, bool]]) -> bytes:
    """The description of a table: (name, type number, part of the key) of its columns."""
    out = b"R" + struct.pack(">I", oid) + schema.encode() + b"\0" + table.encode() + b"\0d" + struct.pack(">H", len(columns))
    return out + b"".join(bytes([k]) + c.encode() + b"\0" + struct.pack(">Ii", o, -1) for c, o, k in columns)
