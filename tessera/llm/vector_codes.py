"""Vectors as short codes: one codebook for each part of a vector, fitted and searched in integers with a VA-file.

A component becomes an integer, and a part of a vector gets the index of the codebook's nearest entry.  The
VA-file of a codebook cuts each coordinate into ``2 ** bits`` cells of about as many entries each and keeps an entry
as its cell numbers.  For a part that asks, a table for each coordinate and cell gives the least and the greatest squared
distance to what the cell holds; sums of them bound the distance to each entry from below and above.  Entries whose lower
bound is above the least upper bound are out; those left are compared by integer distance.  Bounds and distances
are exact integers, so the result is that of comparing all entries, ties to the lower index.

A round of fitting is one pass over the table: tasks send sums and counts of each entry, a table of fixed size.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Numbers of a lookup table for the parts that ask at once, and the distance below which sums of doubles are exact.
BLOCK, EXACT = 1 << 19, 1 << 53
#: Sums travel as digits to this base: one, unless components are huge.
LIMB = 10**30
LONG = (1 << 63) - 1


def finite(vec: Column) -> Column:
    """Not null, without null or non-finite components."""
    return F.coalesce(vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def to_integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, as 64-bit integers or, where they don't fit, as Python's."""
    with np.errstate(over="ignore"):
        y = np.floor(x * float(scale))
    if np.abs(y).max(initial=0) < 2.0**40:
        return y.astype(np.int64)
    return np.array([[int(v) * scale if v == np.floor(v) else int(np.floor(v * scale)) for v in row] for row in x.tolist()], object).reshape(x.shape)


class VaFile:
    """The entries of one codebook (rows of integers) by the cells of their coordinates."""

    def __init__(self, entries: np.ndarray, bits: int = 4) -> None:
        self.wide = int(np.abs(entries).max(initial=0))
        self.entries, self.cells = entries if self.wide >= EXACT else entries.astype(np.int64), 1 << bits
        n, d = entries.shape
        code = np.empty((n, d), np.int64)
        self.low, self.high = np.zeros((d, self.cells)), np.zeros((d, self.cells))
        if self.wide >= EXACT:
            return
        for j in range(d):
            order = np.sort(entries[:, j])
            edges = np.unique(order[(np.arange(1, self.cells) * n) // self.cells])
            code[:, j] = np.searchsorted(edges, entries[:, j], "right")
            for c in np.unique(code[:, j]):
                inside = entries[code[:, j] == c, j]
                self.low[j, c], self.high[j, c] = inside.min(), inside.max()
        # entry by (coordinate, cell): its bounds are sums over the cells it is in
        self.member = np.zeros((d * self.cells, n))
        self.member[(np.arange(d) * self.cells + code).ravel(), np.repeat(np.arange(n), d)] = 1

    def candidates(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``q``, entry) of all that the bounds leave, by row and entry."""
        x = q[:, :, None].astype(np.float64)
        under, over = self.low[None] - x, x - self.high[None]
        least, most = np.maximum(np.maximum(under, over), 0), np.maximum(-under, -over)
        flat = (len(q), -1)
        lower, upper = (least * least).reshape(flat) @ self.member, (most * most).reshape(flat) @ self.member
        return np.nonzero(lower <= upper.min(axis=1, keepdims=True))

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``q`` the index of the nearest entry and its squared distance (an array of Python integers if large)."""
        at = np.zeros(len(q), np.int64)
        far = int(np.abs(q).max(initial=0)) + self.wide
        if far * far * max(1, q.shape[1]) >= EXACT:
            return self._nearest_large(q)
        error = np.zeros(len(q), np.int64)
        block = max(64, BLOCK // (q.shape[1] * self.cells))
        for a in range(0, len(q), block):
            part = q[a : a + block].astype(np.int64)
            row, entry = self.candidates(part)
            gap = part[row] - self.entries[entry]
            dist = (gap * gap).sum(axis=1)
            first = np.flatnonzero(np.diff(row, prepend=-1))
            best = np.minimum.reduceat(dist, first)
            hit = np.flatnonzero(dist == best[row])
            hit = hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]
            at[a : a + block], error[a : a + block] = entry[hit], best
        return at, error

    def _nearest_large(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for components whose squares don't fit, in Python's integers."""
        at, error = np.zeros(len(q), np.int64), np.zeros(len(q), object)
        entries = self.entries.astype(object)
        for i, x in enumerate(q.astype(object)):
            dist = ((entries - x[None]) ** 2).sum(axis=1).tolist()
            error[i] = min(dist)
            at[i] = dist.index(error[i])
        return at, error


@dataclass
class Codebooks:
    """Entries of each part (rows of integers), for vectors of ``dim`` components."""

    parts: list[np.ndarray]
    dim: int
    scale: int

    def sha256(self) -> str:
        """Of the entries' decimal components by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(v) for p in self.parts for v in p.ravel().tolist()).encode()).hexdigest()

    def decode(self, code: str) -> list[float]:
        """The vector that a code stands for: the middle of its entries' cells of ``1 / scale``."""
        at = bytes.fromhex(code)
        return [(v + 0.5) / self.scale for p, i in zip(self.parts, at, strict=True) for v in p[i].tolist()]


def _rows_of(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _coded_by(books: Codebooks, bits: int):
    """A function from vectors to (integers by part, indexes by part, errors by part)."""
    files = [VaFile(p, bits) for p in books.parts]

    def coded(x: np.ndarray):
        parts = np.split(to_integers(x, books.scale), len(files), axis=1)
        return parts, *zip(*(f.nearest(p) for f, p in zip(files, parts, strict=True)), strict=True)

    return coded


def _kept(rows: DataFrame, id_col: str, vec_col: str, *more: str) -> DataFrame:
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    return rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), vec.alias("vec"), *[F.col(f"`{c}`").alias(f"m{i}") for i, c in enumerate(more)]).where(finite(F.col("vec")))


def fit_codebooks(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, bits: int = 4) -> Codebooks | None:
    """Codebooks of ``parts`` equal parts of the vectors, after ``rounds`` of assigning all vectors and averaging.

    They start from the ``entries`` vectors of the smallest ids (null ids last, equal ids by vector).  The vector of the
    smallest id whose length is a positive multiple of ``parts`` sets the length; others take no part.  An entry
    becomes the floor of its parts' mean; one without parts stays.  None without usable vectors.
    """
    if not 0 < entries <= 256:
        raise ValueError("an index has two hex digits, so there are 1 to 256 entries")
    kept = _kept(rows, id_col, vec_col)
    order = [F.col("id").asc_nulls_last(), "vec"]
    lead = kept.where((F.size("vec") > 0) & (F.size("vec") % parts == 0)).orderBy(*order).select(F.size("vec")).first()
    if lead is None:
        return None
    dim = lead[0]
    kept = kept.where(F.size("vec") == dim)
    first = np.array([r.vec for r in kept.orderBy(*order).limit(entries).select("vec").collect()], np.float64)
    books = Codebooks(np.split(to_integers(first, scale), parts, axis=1), dim, scale)
    for _ in range(rounds):
        _average(kept, books, bits)
    return books


def _average(kept: DataFrame, books: Codebooks, bits: int) -> None:
    """One round: each entry becomes the floor of the mean of the parts nearest to it."""
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def add(batches):
        coded, sums, counts = _coded_by(shared.value, bits), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            found, at, _ = coded(_rows_of(batch.column(0), shared.value.dim))
            if sums is None:
                sums = [np.zeros(p.shape, object) for p in shared.value.parts]
                counts = [np.zeros(len(p), np.int64) for p in shared.value.parts]
            for k, (x, i) in enumerate(zip(found, at, strict=True)):
                counts[k] += np.bincount(i, minlength=len(counts[k]))
                order = np.argsort(i, kind="stable")
                begins = np.flatnonzero(np.diff(i[order], prepend=-1))
                sums[k][i[order][begins]] += np.add.reduceat(x[order], begins, axis=0).astype(object)
        rows = []
        for k, (s, n) in enumerate(zip(sums or [], counts or [], strict=True)):
            for entry in np.flatnonzero(n).tolist():
                for place, v in enumerate(s[entry].tolist()):
                    limb, left = 0, abs(v)
                    while left or not limb:
                        left, digit = divmod(left, LIMB)
                        rows.append((k, entry, place, limb, int(n[entry]), digit if v >= 0 else -digit))
                        limb += 1
        if rows:
            kinds = [pa.int32()] * 4 + [pa.int64(), pa.decimal128(38, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "entry", "place", "limb", "n", "total"])

    sums = kept.select("vec").mapInArrow(add, "part int, entry int, place int, limb int, n long, total decimal(38, 0)")
    totals: dict[tuple[int, int, int], int] = {}
    counts: dict[tuple[int, int], int] = {}
    for r in sums.groupBy("part", "entry", "place", "limb").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        # as many rows as the codebooks have components
        at = (r.part, r.entry, r.place)
        totals[at] = totals.get(at, 0) + int(r.total) * LIMB**r.limb
        if r.limb == 0:
            counts[at[:2]] = r.n
    for (part, entry, place), total in totals.items():
        mean = total // counts[part, entry]
        if abs(mean) >= 1 << 62 and books.parts[part].dtype != object:
            books.parts[part] = books.parts[part].astype(object)
        books.parts[part][entry, place] = mean
    shared.destroy()


def encode(rows: DataFrame, books: Codebooks | None, id_col: str = "vec_id", vec_col: str = "embedding", keep: tuple[str, ...] = (), *, bits: int = 4) -> DataFrame:
    """Returns (id, code, error) and the columns ``keep`` as m0, m1 ..., one row for each vector that is not null and without
    null or non-finite components.

    ``code`` has two hex digits for each part, ``error`` the squared distances summed over the parts (the
    largest long if they are more).  A vector of another length than the codebooks' has neither.
    """
    kept = _kept(rows, id_col, vec_col, *keep)
    if books is None:
        return kept.select("id", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), *[f"m{i}" for i in range(len(keep))])
    shared = rows.sparkSession.sparkContext.broadcast(books)
    shape = kept.schema
    names = ["id", *[f"m{i}" for i in range(len(keep))]]

    def run(batches):
        coded = _coded_by(shared.value, bits)
        for batch in batches:
            vec = batch.column(len(names))
            fits = vec.value_lengths().to_numpy(zero_copy_only=False) == shared.value.dim
            code, error = [None] * batch.num_rows, [None] * batch.num_rows
            if fits.any():
                _, at, far = coded(_rows_of(vec.filter(pa.array(fits)), shared.value.dim))
                indexes = np.stack(at, axis=1).astype(np.uint8)
                for row, i, e in zip(np.flatnonzero(fits).tolist(), indexes, zip(*(f.tolist() for f in far), strict=True), strict=True):
                    code[row], error[row] = i.tobytes().hex(), min(LONG, sum(e))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(code, pa.string()), pa.array(error, pa.int64())], [*names, "code", "error"])

    fields = ", ".join(f"{n} {shape[n].dataType.simpleString()}" for n in names)
    return kept.select(*names, "vec").mapInArrow(run, f"{fields}, code string, error long")


def compress_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", *, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, bits: int = 4) -> DataFrame:
    """Returns (id_col, code, error, label_error, codebooks_sha256): the codes of all usable vectors by codebooks fitted on them.

    See ``fit_codebooks`` and ``encode``.  ``label_error`` sums the errors of the rows of an equal label, nulls
    together (the largest long if more; null if no row of it has an error).  Rows that are null or hold null or non-finite components are dropped; rows
    of equal ids each keep theirs; an empty table gives an empty result; other columns are not read.
    """
    scratch = Scratch(rows.sparkSession, "codes")
    books = fit_codebooks(rows, id_col, vec_col, parts=parts, entries=entries, rounds=rounds, scale=scale, bits=bits)
    coded = scratch.put(encode(rows, books, id_col, vec_col, (label_col,), bits=bits), "coded")
    total = F.sum(F.col("error").cast("decimal(20, 0)"))
    total = F.when(total <= LONG, total.cast("long")).when(total.isNotNull(), F.lit(LONG))
    by_label = coded.groupBy(F.col("m0").alias("label")).agg(total.alias("label_error"))
    out = coded.join(by_label, F.col("m0").eqNullSafe(F.col("label")), "left")
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))
