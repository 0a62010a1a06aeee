"""Writing batches to a target database from tasks, with row isolation and a ledger.

A batch is one transaction of one task.  It is first written as a whole; if the target refuses it, halves are tried
under savepoints, in row order, down to the rows at fault, so k bad rows among n cost about k log n statements.  Where
a refused row undoes only itself (``stepwise``), one pass does: k + 1 statements, and no row is sent twice.  In the
same transaction the batch enters a ledger with its counts, quarantined rows and receipt.  A task that is retried,
run twice or resumed finds the ledger's row and writes nothing; one that dies leaves nothing behind.

Any driver of Python's database interface (PEP 249) will do; ``connect`` is called on executors.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import operator
import re
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words by which a message tells that a row broke a constraint.
CONSTRAINT_WORDS = ("constraint", "duplicate", "unique", "violates")
ENTRY = "struct<row_offset: long, pk_hash: string, category: string, detail: string, retry_count: int>"
RESULT = f"batch_id string, n_rows long, n_written long, n_stored long, quarantine array<{ENTRY}>, receipt string, receipt_hash string, already boolean"


class TargetWriteError(RuntimeError):
    """The batch could not be written as a whole; nothing of it was."""


class TargetSchemaError(RuntimeError):
    """A name that is not safe to use, or a target without a column that is needed."""


def quoted(name: str, mark: str = '"') -> str:
    if not name or mark in name or "\0" in name:
        raise TargetSchemaError(f"unsafe identifier {name!r}")
    return f"{mark}{name}{mark}"


@dataclass(frozen=True)
class Target:
    """Where batches go.

    ``connect`` gives a connection that leaves transactions to its user; ``begin`` are statements at the start of
    each (``BEGIN IMMEDIATE``, ``SET CONSTRAINTS ALL DEFERRED``).  ``bulk`` writes many rows at once (see ``copy_rows``); where
    it fails, rows are inserted.  ``adapt`` turns a value into one that the driver takes.  ``stepwise`` says that ``executemany``
    draws rows from an iterator as it sends them, one by one, and that a refused row leaves those before it (SQLite does).
    ``turn`` is held for the time of a transaction, where a target takes one at a time and would let others poll.
    """

    connect: Callable[[], object]
    table: str
    batch_column: str = "_batch_id"
    ledger: str = "_batch_ledger"
    placeholder: str = "?"
    begin: tuple[str, ...] = ()
    release: bool = True
    bulk: Callable | None = None
    adapt: Callable | None = None
    retries: int = 3
    sleep: Callable[[float], None] = time.sleep
    mark: str = '"'
    stepwise: bool = False
    turn: Callable[[], contextlib.AbstractContextManager] = contextlib.nullcontext

    def marks(self, n: int) -> str:
        return ", ".join([self.placeholder] * n)

    def create_ledger(self) -> None:
        """The ledger's table, if it is not there."""
        con = self.connect()
        try:
            con.cursor().execute(f"CREATE TABLE IF NOT EXISTS {quoted(self.ledger, self.mark)} (batch_id VARCHAR(64) NOT NULL, target VARCHAR(200) NOT NULL, content VARCHAR(64) NOT NULL, result TEXT NOT NULL, PRIMARY KEY (batch_id, target))")
            con.commit()
        finally:
            con.close()

    def undo(self, batch_ids: Iterable[str]) -> None:
        """Takes batches out of the target and the ledger."""
        con = self.connect()
        try:
            cursor = con.cursor()
            for s in self.begin:
                cursor.execute(s)
            for b in batch_ids:
                cursor.execute(f"DELETE FROM {quoted(self.table, self.mark)} WHERE {quoted(self.batch_column, self.mark)} = {self.placeholder}", (b,))
                cursor.execute(f"DELETE FROM {quoted(self.ledger, self.mark)} WHERE batch_id = {self.placeholder} AND target = {self.placeholder}", (b, self.table))
            con.commit()
        finally:
            con.close()


def copy_value(v: object) -> str:
    """A value in COPY's CSV form: nulls as ``\\N``, truth values as t and f."""
    if v is None:
        return "\\N"
    if isinstance(v, bool):
        return "t" if v else "f"
    s = str(v)
    return '"' + s.replace('"', '""') + '"' if re.search('[",\\r\\n]', s) or s == "\\N" else s


def copy_rows(cursor, table: str, columns: Sequence[str], rows: Sequence[tuple]) -> None:
    """``bulk`` for PostgreSQL drivers that have ``copy_expert``."""
    import io

    names = ", ".join(map(quoted, columns))
    text = io.StringIO("".join(",".join(map(copy_value, r)) + "\n" for r in rows))
    cursor.copy_expert(f"COPY {quoted(table)} ({names}) FROM STDIN WITH (FORMAT csv, NULL '\\N')", text)


def is_constraint(e: BaseException) -> bool:
    return any(w in str(e).lower() for w in CONSTRAINT_WORDS)


class _Lost(Exception):
    """The connection does not answer any more."""


class BatchWriter:
    """Writes one batch after the other through one connection of a task."""

    def __init__(self, target: Target, columns: Sequence[str]) -> None:
        self.target, self.columns = target, (*columns, target.batch_column)
        names = ", ".join(quoted(c, target.mark) for c in self.columns)
        self.insert = f"INSERT INTO {quoted(target.table, target.mark)} ({names}) VALUES ({target.marks(len(self.columns))})"
        self.con = None

    def close(self) -> None:
        if self.con is not None:
            try:
                self.con.close()
            finally:
                self.con = None

    def write(self, batch_id: str, rows: list[tuple], keys: list[str]) -> dict:
        """The batch's entry in the ledger, which this makes unless it is there."""
        t = self.target
        adapt = t.adapt or (lambda v: v)
        rows = [(*map(adapt, r), batch_id) for r in rows]
        content = hashlib.sha256("\n".join(map(repr, rows)).encode()).hexdigest()
        for attempt in range(t.retries + 1):
            try:
                with t.turn():
                    return self._once(batch_id, rows, keys, content)
            except (TargetWriteError, TargetSchemaError):
                raise
            except Exception as e:  # a lost connection, or another task at the same batch: begin anew
                self.close()
                if attempt == t.retries:
                    raise TargetWriteError(f"batch {batch_id}: {e}") from e
                t.sleep(min(2 ** (attempt + 1), 5))
        raise AssertionError

    def _known(self, cursor, batch_id: str, content: str) -> dict | None:
        t = self.target
        cursor.execute(f"SELECT content, result FROM {quoted(t.ledger, t.mark)} WHERE batch_id = {t.placeholder} AND target = {t.placeholder}", (batch_id, t.table))
        found = cursor.fetchone()
        if found is None:
            return None
        if found[0] != content:
            raise TargetWriteError(f"batch {batch_id} was written with other rows")
        return json.loads(found[1]) | {"already": True}

    def _once(self, batch_id: str, rows: list[tuple], keys: list[str], content: str) -> dict:
        t = self.target
        if self.con is None:
            self.con = t.connect()
        cursor = self.con.cursor()
        try:
            for s in t.begin:
                cursor.execute(s)
            known = self._known(cursor, batch_id, content)
            if known is not None:
                self.con.rollback()
                return known
            entries = self._rows(cursor, rows, keys)
            cursor.execute(f"SELECT count(*) FROM {quoted(t.table, t.mark)} WHERE {quoted(t.batch_column, t.mark)} = {t.placeholder}", (batch_id,))
            stored = cursor.fetchone()[0]
            receipt = json.dumps({"batch_id": batch_id, "quarantine_offsets": [e["row_offset"] for e in entries], "rows_quarantined": len(entries), "rows_read": len(rows), "rows_written": len(rows) - len(entries), "table": t.table}, sort_keys=True, separators=(",", ":"))
            out = {"n_rows": len(rows), "n_written": len(rows) - len(entries), "n_stored": stored, "quarantine": entries, "receipt": receipt}
            cursor.execute(f"INSERT INTO {quoted(t.ledger, t.mark)} (batch_id, target, content, result) VALUES ({t.marks(4)})", (batch_id, t.table, content, json.dumps(out)))
            self.con.commit()
            return out | {"already": False}
        except BaseException:
            try:
                self.con.rollback()
            except Exception:
                self.close()
            raise

    def _rows(self, cursor, rows: list[tuple], keys: list[str]) -> list[dict]:
        """Inserts the rows and returns the entries of those that the target refuses."""
        t = self.target
        if rows and t.bulk is not None and self._try(cursor, lambda: t.bulk(cursor, t.table, self.columns, rows)) is None:
            return []
        if t.stepwise and (entries := self._pass(cursor, rows, keys)) is not None:
            return entries
        entries, pending = [], [(0, len(rows))]
        while pending:
            a, b = pending.pop()
            if a == b:
                continue
            error = self._try(cursor, lambda: cursor.executemany(self.insert, rows[a:b]))  # noqa: B023
            if error is None:
                continue
            if b - a > 1:
                mid = (a + b) // 2
                pending += [(mid, b), (a, mid)]  # the left half comes first, as rows may refer to rows before them
                continue
            tries = 0
            while error is not None and not is_constraint(error) and tries < t.retries:
                tries += 1
                t.sleep(min(2**tries, 5))
                error = self._try(cursor, lambda: cursor.execute(self.insert, rows[a]))  # noqa: B023
            if error is not None:
                entries.append(self._entry(a, keys, error, is_constraint(error), tries))
        return entries

    def _entry(self, at: int, keys: list[str], error: Exception, constraint: bool, tries: int = 0) -> dict:
        kind = "target_constraint_violation" if constraint else "target_connection_error"
        return {"row_offset": at, "pk_hash": hashlib.sha256(keys[at].encode()).hexdigest(), "category": kind, "detail": str(error), "retry_count": tries}

    def _pass(self, cursor, rows: list[tuple], keys: list[str]) -> list[dict] | None:
        """As ``_rows``, going on behind each row that breaks a constraint; None, with nothing written, at any other error."""
        entries, left = [], iter(rows)
        cursor.execute("SAVEPOINT pass")
        while True:
            before = operator.length_hint(left)
            try:
                cursor.executemany(self.insert, left)
            except Exception as e:
                if not getattr(self.con, "in_transaction", True):
                    raise _Lost(str(e)) from e
                after = operator.length_hint(left)
                if after == before or not is_constraint(e):
                    cursor.execute("ROLLBACK TO SAVEPOINT pass")
                    return None
                entries.append(self._entry(len(rows) - after - 1, keys, e, True))
            else:
                if self.target.release:
                    cursor.execute("RELEASE SAVEPOINT pass")
                return entries

    def _try(self, cursor, action: Callable) -> Exception | None:
        """What the action raises; its rows are undone then, and only they."""
        cursor.execute("SAVEPOINT part")
        try:
            action()
        except Exception as e:
            try:
                cursor.execute("ROLLBACK TO SAVEPOINT part")
            except Exception as lost:
                raise _Lost(str(e)) from lost
            return e
        if self.target.release:
            cursor.execute("RELEASE SAVEPOINT part")
        return None


def write_batches(rows: DataFrame, target: Target, batch: str, order: Sequence[str], keys: Sequence[str], columns: Sequence[str], writers: int | None = None) -> DataFrame:
    """Writes the ``columns`` of all rows and gives (batch_id, n_rows, n_written, n_stored, quarantine, receipt, receipt_hash, already).

    ``batch`` names the column of batch ids, whose batches are of bounded size; within one, rows are written in the
    order of ``order``.  ``keys`` name a row in the quarantine by a hash of their JSON.  ``n_stored`` counts the batch's rows in the target.
    ``already`` says that an earlier run had written the batch.  ``writers`` bounds the connections at once.  The write happens
    when the result is read; reading it again writes nothing.
    """
    target.create_ledger()
    names = list(columns)
    given = rows.select(F.col(batch).cast("string").alias("b"), F.to_json(F.struct(*keys)).alias("k"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    dealt = given.repartition(writers, "b") if writers else given.repartition("b")
    dealt = dealt.sortWithinPartitions("b", *[f"o{i}" for i in range(len(order))]).drop(*[f"o{i}" for i in range(len(order))])
    entry = pa.struct([("row_offset", pa.int64()), ("pk_hash", pa.string()), ("category", pa.string()), ("detail", pa.string()), ("retry_count", pa.int32())])
    schema = pa.schema([("batch_id", pa.string()), ("n_rows", pa.int64()), ("n_written", pa.int64()), ("n_stored", pa.int64()), ("quarantine", pa.list_(entry)), ("receipt", pa.string()), ("receipt_hash", pa.string()), ("already", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BatchWriter(target, names)
        held: list[tuple] = []
        held_keys: list[str] = []
        at = None

        def end() -> pa.RecordBatch:
            out = writer.write(at, held, held_keys)
            out["batch_id"], out["receipt_hash"] = at, hashlib.sha256(out["receipt"].encode()).hexdigest()
            return pa.RecordBatch.from_pylist([out], schema)

        try:
            for part in batches:
                values = [c.to_pylist() for c in part.columns]
                for b, k, *row in zip(*values, strict=True):
                    if b != at and at is not None:
                        yield end()
                        held, held_keys = [], []
                    at = b
                    held.append(tuple(row))
                    held_keys.append(k)
            if at is not None:
                yield end()
        finally:
            writer.close()

    return dealt.where("b is not null").mapInArrow(run, RESULT)
