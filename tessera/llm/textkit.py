"""Word splitting and hashing of many texts at once with numpy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D of the UTF-8
text, which is what ``[^\\x20\\x09-\\x0D]+`` matches on characters.  A word's
hash is a 64-bit polynomial over random byte values, finalised with its length;
sequences of words are hashed from the hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text handled in one numpy pass.
SLICE = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = 1 << max(19, int(n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 22:
            _powers[name] = have
    return have


def split(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a byte string."""
    a = np.frombuffer(joined, np.uint8)
    if not len(a):
        e = np.empty(0, np.int64)
        return e, e, np.empty(0, np.uint64)
    word = ~_SPACE[a]
    edge = np.diff(word.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.empty(len(a) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[a] * _power("p", _BASE, len(a))[: len(a)], out=total[1:])
    h = (total[ends] - total[starts]) * _power("i", _INV, len(a))[starts]
    return starts, ends, mix(h + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end at white space."""
    at, n = 0, len(text)
    while n - at > 4 * SLICE:
        cut = at + SLICE
        while cut < n and not _SPACE[text[cut]]:
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def word_hashes(texts: Iterable[str | None], lower: bool = False) -> Iterator[np.ndarray]:
    """For each text, the hashes of its words in order; none for a null text."""
    hold: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        joined = b" ".join(hold)
        if lower:
            joined = joined.translate(_LOWER)
        starts, _, h = split(joined)
        bounds = np.cumsum([0, *(len(t) + 1 for t in hold)])
        cuts = np.searchsorted(starts, bounds)
        for i in range(len(hold)):
            yield h[cuts[i] : cuts[i + 1]]

    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if len(raw) > 4 * SLICE:
            yield from flush()
            hold, size = [], 0
            parts = [split(p.translate(_LOWER) if lower else p)[2] for p in _pieces(raw)]
            yield np.concatenate(parts)
            continue
        hold.append(raw)
        size += len(raw)
        if size >= SLICE:
            yield from flush()
            hold, size = [], 0
    yield from flush()


def sequences(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive words."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out += h[k : k + m] * U(pow(_BASE, 2 * k + 3, 1 << 64))
        out ^= out >> U(29)
    return mix(out + U(n))


def shingle_set(h: np.ndarray, n: int) -> np.ndarray:
    """The sorted distinct ``n``-word shingles; a shorter text is one shingle as a whole."""
    if not len(h):
        return h
    return np.unique(sequences(h, min(n, len(h))))


def texts_of(batch: pa.RecordBatch, column: int) -> list[str | None]:
    return batch.column(column).to_pylist()


class CountSketch:
    """Counts of hashed items in a table of fixed size; an estimate is never below the true count.

    The size does not depend on the input, so that it may be sent to every task.
    """

    def __init__(self, bits: int = 19, rows: int = 2, table: np.ndarray | None = None) -> None:
        self.bits, self.rows = bits, rows
        self.table = np.zeros((rows, 1 << bits), np.uint32) if table is None else table

    def _slots(self, items: np.ndarray, row: int) -> np.ndarray:
        return (items * U(pow(_BASE, 5 + 2 * row, 1 << 64)) >> U(64 - self.bits)).astype(np.int64)

    def add(self, items: np.ndarray) -> None:
        for r in range(self.rows):
            more = np.bincount(self._slots(items, r), minlength=1 << self.bits)
            np.add(self.table[r], np.minimum(more, 0xFFFF_FFFF - self.table[r]), out=self.table[r], casting="unsafe")

    def row(self, items: np.ndarray, r: int) -> np.ndarray:
        """The estimates of one row alone; the errors of different rows are independent."""
        return self.table[r][self._slots(items, r)]

    def of(self, items: np.ndarray) -> np.ndarray:
        return np.min([self.table[r][self._slots(items, r)] for r in range(self.rows)], axis=0)


def _tables_added(tasks, rows: int, bits: int, spread: int, lanes: int) -> CountSketch:
    """Adds up the tables of all tasks in two rounds of at most the square root of their number."""
    from pyspark.sql import functions as F

    width = (rows << bits) // spread

    def add(key, pdf):
        import pandas as pd

        total = np.zeros(width, np.uint64)
        for raw in pdf["counts"]:
            total += np.frombuffer(raw, np.uint32)
        return pd.DataFrame({"part": [key[0]], "counts": [np.minimum(total, 0xFFFF_FFFF).astype(np.uint32).tobytes()]})

    some = tasks.groupBy("part", (F.col("task") % lanes).alias("lane")).applyInPandas(add, "part int, counts binary")
    rows_ = some.groupBy("part").applyInPandas(add, "part int, counts binary").collect()
    table = np.zeros(rows << bits, np.uint32)
    for part, raw in rows_:
        table[part * width : (part + 1) * width] = np.frombuffer(raw, np.uint32)
    return CountSketch(bits, rows, table.reshape(rows, 1 << bits))


def _sketch(df, items_of, bits: int, rows: int) -> CountSketch:
    """Counts the items of all rows; ``items_of(batch)`` gives arrays.  Each task adds up one table."""
    spread = 16
    width = (rows << bits) // spread

    def count(batches):
        from pyspark import TaskContext

        sketch, hold, size = CountSketch(bits, rows), [], 0
        for batch in batches:
            for more in items_of(batch):
                hold.append(more)
                size += len(more)
                if size > 1 << 20:
                    sketch.add(np.concatenate(hold))
                    hold, size = [], 0
        if hold:
            sketch.add(np.concatenate(hold))
        flat = sketch.table.reshape(-1)
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"task": pa.array([task] * spread, pa.int32()), "part": pa.array(range(spread), pa.int32()), "counts": pa.array([flat[i * width : (i + 1) * width].tobytes() for i in range(spread)], pa.binary())})

    tasks = df.mapInArrow(count, "task int, part int, counts binary")
    return _tables_added(tasks, rows, bits, spread, max(1, int(df.rdd.getNumPartitions() ** 0.5)))


def item_sketch(df, bits: int, rows: int) -> CountSketch:
    """Counts the items of a column of packed uint64 arrays."""
    return _sketch(df, lambda batch: (np.frombuffer(x, "<u8") for x in batch.column(0).to_pylist()), bits, rows)


def corpus_sketch(df, make_items, bits: int = 19, rows: int = 2) -> CountSketch:
    """Counts the items of all texts of a one-column DataFrame.

    ``make_items(word_hashes) -> uint64 array``.
    """
    return _sketch(df, lambda batch: map(make_items, word_hashes(texts_of(batch, 0), make_items.lower)), bits, rows)


class Membership:
    """A filter over 64-bit ids that may say yes wrongly, never no; at most 32 MB."""

    def __init__(self, bits: int, table: np.ndarray) -> None:
        self.bits, self.table = bits, table

    @staticmethod
    def slots(ids: np.ndarray, bits: int) -> np.ndarray:
        h = ids.astype(np.int64).view(np.uint64)
        return np.stack([mix(h + U(k * 0x632BE59BD9B4E019 & 0xFFFF_FFFF_FFFF_FFFF)) >> U(64 - bits) for k in range(1, 4)]).astype(np.int64)

    def has(self, ids: pa.Array) -> np.ndarray:
        at = self.slots(ids.to_numpy(zero_copy_only=False), self.bits)
        return (self.table[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=0)


def membership(df, n: int) -> Membership:
    """Of a one-column DataFrame of ``n`` long ids: 16 bits or more for each up to 2 ** 28 bits, fewer beyond.

    Tasks send the set bits, slices of the table are built apart, and only the table reaches the driver.
    """
    bits = min(28, max(16, int(16 * n).bit_length()))
    spread = 16
    width = bits - 4

    def set_bits(batches):
        for batch in batches:
            at = np.unique(Membership.slots(batch.column(0).to_numpy(zero_copy_only=False), bits))
            cuts = np.searchsorted(at >> width, np.arange(spread + 1))
            own = [(at[cuts[i] : cuts[i + 1]] & ((1 << width) - 1)).astype(np.uint32).tobytes() for i in range(spread)]
            yield pa.RecordBatch.from_arrays([pa.array(range(spread), pa.int32()), pa.array(own, pa.binary())], ["part", "at"])

    def build(table: pa.Table) -> pa.Table:
        flags = np.zeros(1 << width, np.uint8)
        for raw in table.column("at").to_pylist():
            flags[np.frombuffer(raw, np.uint32)] = 1
        return pa.table({"part": table.column("part")[:1], "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(1 << (bits - 3), np.uint8)
    for part, raw in df.mapInArrow(set_bits, "part int, at binary").groupBy("part").applyInArrow(build, "part int, bits binary").collect():
        out[part << (width - 3) : (part + 1) << (width - 3)] = np.frombuffer(raw, np.uint8)
    return Membership(bits, out)
