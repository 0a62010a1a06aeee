"""Removal of lines that many documents share, by hash ranges and a secondary sort.

A line becomes 128 bits of hash.  Rows of (hash, document, position) are range-partitioned and sorted by hash,
then by document, largest first, then by position; a hash of very many lines is spread over several ranges.
A task streams over its rows: the first document of a hash is the one that keeps the line, and once enough
documents are seen the lines of all others go.  Only the hashes at the two ends of a range can go on in another;
their rows are settled afterwards against a table of a few rows for each range.

The result has no text: for each document that loses lines, a compressed bitmap of those it keeps.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .textkit import texts_of

#: Bytes of text of a batch of restored documents.
BATCH = 1 << 22
_SPACES = "\t\n\x0b\x0c\r "
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of rows between the passes: lines that go, lines not settled yet, documents of a hash that goes on in another range.
GONE, OPEN, SEEN = 0, 1, 2
#: Stands for a null id, which counts as one document below all others.
_NULL_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    """The line without ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(_SPACES)), _UPPER, _LOWER)


def pack_bits(dropped: np.ndarray) -> bytes:
    """A compressed bitmap of lines that stay, up to the last one that goes and to a whole byte; all after it stay."""
    bits = np.ones(int(dropped.max()) // 8 * 8 + 8, np.uint8)
    bits[dropped] = 0
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def unpack_bits(packed: bytes, n: int) -> np.ndarray:
    """For each of ``n`` lines whether it stays."""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8))
    keep = np.ones(n, bool)
    keep[: len(bits)] = bits[:n]
    return keep


def _starts(t: np.ndarray, columns: int) -> np.ndarray:
    """The first row of each stretch of rows that agree in the first ``columns``."""
    new = np.ones(len(t), bool)
    new[1:] = (t[1:, :columns] != t[:-1, :columns]).any(axis=1)
    return np.flatnonzero(new)


def _stream(min_docs: int):
    """Over sorted batches (h1, h2, doc, print, pos): what is known of their lines, for ``mapInArrow``."""

    def rows(kind: int, parts: list[np.ndarray]):
        if parts:
            t = np.concatenate(parts)
            cols = [pa.array(np.full(len(t), kind, np.int32)), *(pa.array(np.ascontiguousarray(t[:, k])) for k in range(5))]
            yield pa.RecordBatch.from_arrays(cols, ["kind", "h1", "h2", "doc", "print", "pos"])

    def run(batches):
        key, docs, held, head = None, [], [], True  # the hash at hand, its largest documents, rows not settled; whether it is the range's first

        def seen():
            return [np.array([[*key, d, 0, 0] for d in docs], np.int64)] if docs else []

        for batch in batches:
            t = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(5)], axis=1)
            if not len(t):
                continue
            t = t[_starts(t, 5)]  # repeated rows of one document
            begins = _starts(t, 2)
            ends = np.append(begins[1:], len(t))
            worth = ends - begins >= min_docs
            worth[[0, -1]] = True
            gone, open_ = [], []
            for a, b in zip(begins[worth].tolist(), ends[worth].tolist(), strict=True):
                part = t[a:b]
                if (here := (int(part[0, 0]), int(part[0, 1]))) != key:
                    if head:
                        yield from rows(SEEN, seen())
                    head, key, docs, held = key is None, here, [], []
                if len(docs) < min_docs:
                    for d in part[_starts(part[:, 2:3], 1), 2].tolist():
                        if d not in docs and len(docs) < min_docs:
                            docs.append(d)
                if head:  # the hash may have begun in an earlier range
                    open_.append(part)
                    continue
                held.append(part[part[:, 2] != docs[0]])
                if len(docs) >= min_docs:
                    gone += held
                    held = []
            yield from rows(GONE, gone)
            yield from rows(OPEN, open_)
        yield from rows(OPEN, held)
        yield from rows(SEEN, seen())

    return run


def _as_doc(doc_id: Column) -> Column:
    return F.coalesce(doc_id, F.lit(_NULL_ID))


def line_bitmaps(own: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc, print, keep) of the documents of ``own`` (id, text) that lose lines: ``doc`` is the id (the least long if null),
    ``print`` the ``xxhash64`` of the text, ``keep`` a bitmap for ``unpack_bits``.

    A line goes if its key (``line_key``) has ``min_chars`` code points, is found in ``min_docs`` documents and
    not in this document last, by id.  Rows of one id are one document.
    """
    scratch = Scratch(own.sparkSession, "lines")
    lines = own.select(_as_doc(F.col("id")).alias("doc"), F.xxhash64("text").alias("print"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.select("doc", "print", F.col("pos").cast("long").alias("pos"), line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    lines = lines.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(min_chars), "key").alias("h2"), "doc", "print", "pos")
    order = ["h1", "h2", F.col("doc").desc(), "print", "pos"]
    known = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    known = scratch.put(known.mapInArrow(_stream(min_docs), "kind int, h1 long, h2 long, doc long, print long, pos long"), "known")
    # at most two hashes of a range, and min_docs documents of each
    ends = known.where(F.col("kind") == SEEN).groupBy("h1", "h2").agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("last")).where(F.col("n") >= min_docs)
    late = known.where(F.col("kind") == OPEN).join(F.broadcast(ends), ["h1", "h2"]).where("doc != last")
    gone = known.where(F.col("kind") == GONE).select("doc", "print", "pos").union(late.select("doc", "print", "pos"))

    def pack(batches):
        for batch in batches:
            bits = [pack_bits(np.array(p, np.int64)) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary())], ["doc", "print", "keep"])

    places = gone.groupBy("doc", "print").agg(F.collect_set("pos").alias("places"))
    return places.mapInArrow(pack, "doc long, print long, keep binary")


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Returns (id_col, n_lines, n_dropped, keep, kept_text), one row per input row.

    Texts are split at \\n, a null or empty one into one empty line.  A line whose key has at least ``min_chars``
    code points, found in at least ``min_docs`` documents, stays only in the one of the largest id, as often as
    it stands there.  ``keep`` is the bitmap of the lines that stay, null if all do; ``kept_text`` joins them by \\n.
    Rows of one id are one document, and rows of a null id one below all others; each row keeps its own lines and
    bitmap.  Texts are read whole, whatever their length; an empty table gives an empty result, and other
    columns are not read.  Keys are compared as 128 bits of hash.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    bitmaps = line_bitmaps(own, min_chars, min_docs)

    def restore(batches):
        for batch in batches:
            texts, keeps, at = texts_of(batch, 1), batch.column(2).to_pylist(), 0
            while at < len(texts):
                first, size, lines, dropped, kept = at, 0, [], [], []
                while at < len(texts) and size < BATCH:
                    text, bits = texts[at] or "", keeps[at]
                    n = text.count("\n") + 1
                    lines.append(n)
                    if bits is None:
                        dropped.append(0)
                        kept.append(text)
                    else:
                        stay = unpack_bits(bits, n)
                        dropped.append(n - int(stay.sum()))
                        kept.append("\n".join(x for x, k in zip(text.split("\n"), stay.tolist(), strict=True) if k))
                    size += len(text)
                    at += 1
                cols = [batch.column(0).slice(first, at - first), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), batch.column(2).slice(first, at - first), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["id", "n_lines", "n_dropped", "keep", "kept_text"])

    keyed = own.withColumns({"doc": _as_doc(F.col("id")), "print": F.xxhash64("text")})
    out = keyed.join(bitmaps, ["doc", "print"], "left").select("id", "text", "keep")
    return out.mapInArrow(restore, "id long, n_lines long, n_dropped long, keep binary, kept_text string").withColumnRenamed("id", id_col)
