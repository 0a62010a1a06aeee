"""Column matching by embedding similarity and optimal assignment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import Steps


def cosine(a: Column, b: Column) -> Column:
    """Double precision; a zero vector counts as of length one."""

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    def norm(x):
        n = F.sqrt(dot(x, x))
        return F.when(n == 0, 1.0).otherwise(n)

    return dot(a, b) / (norm(a) * norm(b))


#: Legacy vectors of a unit, targets of a part, of a tile (compared at once), groups of a tile, vectors of a packed row, pairs whose similarity is computed in full at once.
UNIT, PART, TILE, GROUPS, CHUNK, PAIRS = 8192, 1 << 17, 1024, 64, 4, 1 << 16


def top_candidates(legacy: DataFrame, target: DataFrame, id_col: str, vec_col: str, k: int, digits: int | None = 6) -> DataFrame:
    """(legacy, rank, target, sim): the k most similar targets of each legacy vector, ties to the smaller id.

    All pairs, side by side: a task compares a unit of legacy vectors with a part of the targets, tile by tile.  Products
    in single precision, with a bound on their error, leave out what cannot be among the k; the rest is compared by
    ``Nearest`` in double precision.  Of equal targets the k of smallest id are compared, equal legacy vectors once.
    Similarities with a vector that is not finite are NaN and come first, with none or an empty one null and last.
    """
    kind = "float" if all(df.schema[vec_col].dataType.simpleString() == "array<float>" for df in (legacy, target)) else "double"
    steps = Steps(legacy)

    def side(df: DataFrame) -> DataFrame:
        v = F.col(vec_col).cast(f"array<{kind}>")
        odd = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
        state = F.when(v.isNull() | (F.size(v) == 0), 2).when(F.coalesce(odd, F.lit(False)), 1).otherwise(0)
        return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), state.alias("state"))

    def packed(df: DataFrame) -> tuple[DataFrame, int]:
        rows = steps.put(df.select("id", "v").mapInArrow(pack, "n int, ids binary, vs binary"))
        return rows, rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def dealt(rows: DataFrame, own: str, n: int, other: str, m: int, place: int) -> DataFrame:
        own_, other_ = F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other)
        return rows.select(own_, other_, F.lit(place).alias("side"), "ids", "vs").select("u", "p", "side", "ids", "vs")

    left, right = side(legacy), side(target)
    own = steps.put(left.where("state = 0").withColumn("row", F.monotonically_increasing_id()).withColumn("rep", F.min("row").over(Window.partitionBy("v"))))
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    (x, n), (y, m) = packed(own.where("row = rep").select(F.col("rep").alias("id"), "v")), packed(right.where("state = 0").withColumn("nth", nth).where(F.col("nth") <= k))
    units, parts = max(1, -(-n // UNIT)), max(1, -(-m // PART))
    pairs = dealt(x, "u", units, "p", parts, 0).union(dealt(y, "p", parts, "u", units, 1)).repartition("u", "p").sortWithinPartitions("u", "p", "side")
    hits = pairs.mapInArrow(nearest(k, np.float32 if kind == "float" else np.float64), "rep long, target long, sim double")
    hits = own.select(F.col("id").alias("legacy"), "rep").join(hits, "rep").select("legacy", "target", "sim")

    # pairs without a similarity: any target of the same state will do, so k of each are enough
    some = right.withColumn("nth", F.row_number().over(Window.partitionBy("state").orderBy("id"))).where(F.col("nth") <= k)
    none = left.select(F.col("id").alias("legacy"), F.col("state").alias("s")).crossJoin(F.broadcast(some.select(F.col("id").alias("target"), "state")))
    worst = F.greatest("s", "state")
    hits = hits.union(none.where(worst > 0).select("legacy", "target", F.when(worst == 1, float("nan")).alias("sim")))
    rank = F.row_number().over(Window.partitionBy("legacy").orderBy(F.desc("sim"), "target"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("legacy", "rank", "target", (F.round("sim", digits) if digits is not None else F.col("sim")).alias("sim"))


def pack(batches):
    """Rows (id, v) as rows of ``CHUNK`` vectors in binary, so that they travel and are read as such."""
    for batch in batches:
        ids, vs = batch.column(0).to_numpy(), batch.column(1)
        if not len(ids):
            continue
        flat, lengths = vs.flatten(), vs.value_lengths()
        if flat.null_count or pc.min_max(lengths)["min"] != pc.min_max(lengths)["max"]:
            raise ValueError("vectors of other lengths, or with null components")
        rows = flat.to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        out = [(len(ids[a : a + CHUNK]), ids[a : a + CHUNK].tobytes(), rows[a : a + CHUNK].tobytes()) for a in range(0, len(ids), CHUNK)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["n", "ids", "vs"])


def nearest(k: int, kind: type):
    """A function of batches of packed rows (u, p, side, ids, vs), sorted, that gives each unit's hits in each part."""

    def vectors(held: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(b"".join(i for i, _ in held), np.int64)
        return ids, np.vstack([np.frombuffer(v, kind).reshape(len(i) // 8, -1) for i, v in held]).astype(np.float64)

    def run(batches):
        key, unit_, held, size = None, None, [], 0

        def end():
            if unit_ is not None:
                if held:
                    unit_.add(*vectors(held))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in unit_.hits()], ["rep", "target", "sim"])

        for batch in batches:
            for u, p, side, ids, vs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (u, p) != key:
                    yield from end()
                    key, unit_, held, size = (u, p), None, [], 0
                if side and unit_ is None:
                    if not held:  # no legacy vector has come
                        continue
                    unit_, held, size = Nearest(*vectors(held), k), [], 0
                held.append((ids, vs))
                size += len(ids) // 8
                if unit_ is not None and size >= TILE:
                    unit_.add(*vectors(held))
                    held, size = [], 0
        yield from end()

    return run


class Nearest:
    """The k most similar of the targets seen so far, for each of some legacy vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int) -> None:
        self.ids, self.x, self.k = ids, x, k
        self.square = summed(x * x)
        self.turned = np.ascontiguousarray(unit(x).astype(np.float32).T)
        #: more than a product of unit vectors in single precision can be off
        self.error = (x.shape[1] + 8) * 2.0**-23
        self.near = None
        self.sims, self.targets = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, y: np.ndarray) -> None:
        m, groups = len(self.ids), max(GROUPS, 2 * self.k)
        each = -(-len(ids) // groups)
        if self.near is None or len(self.near) != groups * each:
            self.near = np.empty((groups * each, m), np.float32)
        np.matmul(unit(y).astype(np.float32), self.turned, out=self.near[: len(ids)])
        self.near[len(ids) :] = -np.inf
        near = self.near.reshape(groups, each, m)
        top = near.max(axis=1)
        floor = self.sims[:, -1] - self.error
        if np.isinf(floor).any():
            # k groups reach the k-th of their maxima, so k targets do
            floor = np.maximum(floor, np.partition(top, groups - self.k, axis=0)[groups - self.k] - 2 * self.error)
        floor = floor.astype(np.float32)
        g, i = np.nonzero(top >= floor)
        square = summed(y * y)
        for a in range(0, len(g), max(1, PAIRS // each)):
            g_, i_ = g[a : a + max(1, PAIRS // each)], i[a : a + max(1, PAIRS // each)]
            at, j = np.nonzero(near[g_, :, i_] >= floor[i_, None])
            i_, j = i_[at], g_[at] * each + j
            real = j < len(ids)
            self._merge(i_[real], j[real], ids, y, square)

    def _merge(self, i: np.ndarray, j: np.ndarray, ids: np.ndarray, y: np.ndarray, square: np.ndarray) -> None:
        if not len(i):
            return
        length = np.sqrt(self.square[i] * square[j])
        sim = np.clip(summed(self.x[i] * y[j]) / np.where(length == 0, 1.0, length), -1.0, 1.0)
        seen = np.unique(i)
        row = np.concatenate([np.repeat(seen, self.k), i])
        sims, targets = np.concatenate([self.sims[seen].ravel(), sim]), np.concatenate([self.targets[seen].ravel(), ids[j]])
        order = np.lexsort((targets, -sims, row))
        first = np.searchsorted(row[order], seen)
        best = order[(first[:, None] + np.arange(self.k))]
        self.sims[seen], self.targets[seen] = sims[best], targets[best]

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = self.sims > -np.inf
        return np.repeat(self.ids, self.k)[found.ravel()], self.targets[found], self.sims[found]


def summed(products: np.ndarray) -> np.ndarray:
    """Sums of the rows from left to right, as SQL adds them, so that equal pairs tie wherever they are computed."""
    return np.cumsum(products, axis=1)[:, -1]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay."""
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n == 0, 1.0, n)


def assignments(columns: DataFrame, pair: str, id_col: str, vec_col: str, legacy: str) -> DataFrame:
    """(legacy, target): within each pair of tables, the one-to-one mapping of largest total similarity; a table's columns fit one task."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("legacy").to_pylist(), table.column("id").to_pylist(), table.column("v").to_pylist(), strict=True), key=lambda r: r[1])
        a, b = ([r for r in rows if r[0] == side] for side in (True, False))
        out = []
        if a and b:
            found = assign(unit(np.array([r[2] for r in a], float)) @ unit(np.array([r[2] for r in b], float)).T)
            out = [(a[i][1], b[j][1]) for i, j in enumerate(found) if j is not None]
        return pa.table({"legacy": pa.array([x for x, _ in out], pa.int64()), "target": pa.array([y for _, y in out], pa.int64())})

    rows = columns.select(F.col(pair).alias("pair"), F.col(id_col).cast("long").alias("id"), F.transform(F.col(vec_col), lambda x: x.cast("double")).alias("v"), F.col(legacy).alias("legacy"))
    return rows.groupBy("pair").applyInArrow(run, "legacy long, target long")


def status(best: Column, second: Column) -> Column:
    return F.when(best < 0.6, "no_match").when(best - second < 0.05, "ambiguous").when(best >= 0.85, "ok").otherwise("low_confidence")


def assign(similarity: np.ndarray) -> list[int | None]:
    """For each row the column of the assignment of largest sum (shortest augmenting paths); None beyond the columns."""
    n, m = similarity.shape
    size = max(n, m)
    cost = np.full((size, size), 1e3)
    cost[:n, :m] = -similarity
    u, v = np.zeros(size + 1), np.zeros(size + 1)
    match = np.zeros(size + 1, int)
    for i in range(1, size + 1):
        match[0], j = i, 0
        low, way, used = np.full(size + 1, np.inf), np.zeros(size + 1, int), np.zeros(size + 1, bool)
        while True:
            used[j] = True
            row = match[j]
            slack = cost[row - 1] - u[row] - v[1:]
            better = ~used[1:] & (slack < low[1:])
            low[1:][better], way[1:][better] = slack[better], j
            nxt = int(np.argmin(np.where(used[1:], np.inf, low[1:]))) + 1
            d = low[nxt]
            u[match[used]] += d
            v[used] -= d
            low[~used] -= d
            j = nxt
            if not match[j]:
                break
        while j:
            match[j], j = match[way[j]], way[j]
    out: list[int | None] = [None] * n
    for j in range(1, size + 1):
        if match[j] <= n and j <= m:
            out[match[j] - 1] = j - 1
    return out
