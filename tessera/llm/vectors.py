"""Near-duplicate groups and nearest neighbours of embeddings.

``embedding_dedup``: spherical k-means gives cells.  A vector lives in the cell of its nearest
centroid and also visits the cells whose centroid is nearly as near.  How nearly is measured:
pairs of exactly the threshold's cosine are drawn around sampled vectors, and the margin is set so
that a share ``recall`` of them meet in a cell; pairs of larger cosine meet more often.  Cells are
packed in blocks, and products are computed for pairs of blocks.

``vp_search``: vantage-point trees for each shard, searched for blocks of queries.  Shards hold
vectors of like length.  In a shard, largest inner product is nearest distance after scaling and
one more coordinate that makes all rows equally long.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import connected_components
from .langid import spherical_kmeans
from .scratch import Scratch

#: Vectors used to fit centroids, vectors of a cell on average, of a block, of a shard, queries of a block,
#: vectors whose products give each query a first bound, and cells at most (more vectors make larger cells).
SAMPLE, CELL, BLOCK, SHARD, QUERIES, FIRST, CELLS = 8192, 2048, 2048, 8192, 4096, 2048, 4096


def usable(vec: Column) -> Column:
    """Not null, no null or non-finite component, and not zero."""
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec.isNotNull() & good & F.exists(vec, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, for components of any size."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column, kind=np.float64) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(n, -1) if n else np.zeros((0, 0), kind)


def _typed(rows: DataFrame, vec_col: str) -> tuple[Column, type]:
    """The vectors as floats if they are, else as doubles; -0.0 and 0.0 are one value."""
    kind = "float" if rows.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    vec = F.transform(F.col(vec_col).cast(f"array<{kind}>"), lambda x: x + F.lit(0.0).cast(kind))
    return vec, np.float32 if kind == "float" else np.float64


def margin_of(x: np.ndarray, centroids: np.ndarray, threshold: float, recall: float, seed: int = 11) -> float:
    """The lead of the own cell up to which another is visited, so that a share ``recall`` of pairs at the threshold meet.

    ``x``: unit rows.  A pair meets if one of it visits the other's cell.
    """
    rng = np.random.default_rng(seed)
    z = rng.normal(size=x.shape)
    z = unit(z - (z * x).sum(axis=1, keepdims=True) * x + 1e-300)
    y = threshold * x + math.sqrt(max(0.0, 1 - threshold * threshold)) * z
    a, b, at = x @ centroids.T, y @ centroids.T, np.arange(len(x))
    lead = np.minimum(a.max(axis=1) - a[at, b.argmax(axis=1)], b.max(axis=1) - b[at, a.argmax(axis=1)])
    return float(np.quantile(lead, recall)) + 1e-9


def _fit_cells(distinct: DataFrame, threshold: float, recall: float, kind: type) -> dict[int, tuple[np.ndarray, float]]:
    """Centroids and margin for each vector length that has more than one cell's worth of vectors."""
    fitted = {}
    for r in distinct.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).where(f"n > {CELL}").collect():
        k = min(CELLS, -(-r.n // CELL))
        some = distinct.where(F.col("dim") == r.dim).orderBy(F.xxhash64("k1"), "id").select("vec").limit(max(SAMPLE, 4 * k)).collect()
        x = unit(np.array([s.vec for s in some], np.float64))
        c = spherical_kmeans(x, k)
        fitted[r.dim] = (c, margin_of(x, c, threshold, recall))
    return fitted


def _cells_of(x: np.ndarray, fit) -> tuple[np.ndarray, np.ndarray]:
    """The own cell of unit rows, and for each row and cell whether the row lives in it or visits it."""
    if fit is None:
        return np.zeros(len(x), np.int64), np.ones((len(x), 1), bool)
    dots = x @ fit[0].T
    home = dots.argmax(axis=1)
    return home, dots[np.arange(len(x)), home][:, None] - dots <= fit[1]


def embedding_dedup(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, threshold: float = 0.9, recall: float = 0.995) -> DataFrame:
    """Returns (id_col, n_links, component_id, kept), one row per input row.

    ``n_links`` counts the other rows found of cosine at least ``threshold``, repeated rows included;
    no pair below it links.  Pairs of equal vectors are never missed; of others a share ``recall`` or more
    is expected to be found.  Unusable vectors (see ``usable``) link with nothing, nor do vectors of
    different lengths.  Rows that repeat an id each keep their row and count for each other.  An empty table
    gives an empty result; other columns are not read.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "vectors")
    vec, kind = _typed(rows, vec_col)
    own = rows.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
    good = own.where(usable(F.col("vec"))).select("id", "vec", F.xxhash64("vec").alias("k1"), F.hash("vec").alias("k2"))
    distinct = scratch.put(good.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec")).select("id", "copies", "vec", F.size("vec").alias("dim"), "k1", "k2"), "distinct")
    fitted = _fit_cells(distinct, threshold, recall, kind)
    shared = spark.sparkContext.broadcast(fitted)

    def assign(batches):
        for batch in batches:
            dim = np.array(batch.column(3).to_pylist())
            for d in np.unique(dim):
                part = batch.filter(pa.array(dim == d))
                raw = _matrix(part.column(2), kind)
                home, near = _cells_of(unit(raw.astype(np.float64)), shared.value.get(int(d)))
                at, cell = np.nonzero(near)
                take = pa.array(at)
                cols = [pa.array(np.full(len(at), d, np.int32)), pa.array(cell.astype(np.int32)), pa.array(home[at] == cell)]
                cols += [part.column(i).take(take) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([raw[i].tobytes() for i in at], pa.binary())], ["dim", "cell", "home", "id", "copies", "raw"])

    members = distinct.select("id", "copies", "vec", "dim").mapInArrow(assign, "dim int, cell int, home boolean, id long, copies long, raw binary")
    members = scratch.put(members, "members")
    sizes = members.groupBy("dim", "cell", "home").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    # two rows for each cell, whose number is bounded
    members = members.join(F.broadcast(sizes), ["dim", "cell", "home"]).withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        one = {c: [table.column(c)[0].as_py()] for c in ("dim", "cell", "home", "b")}
        data = pickle.dumps((table.column("id").to_numpy(), table.column("copies").to_numpy(), b"".join(table.column("raw").to_pylist())))
        return pa.table([pa.array(one["dim"], pa.int32()), pa.array(one["cell"], pa.int32()), pa.array(one["home"]), pa.array(one["b"], pa.int32()), pa.array([data], pa.binary())], ["dim", "cell", "home", "b", "data"])

    blocks = scratch.put(members.groupBy("dim", "cell", "home", "b").applyInArrow(pack, "dim int, cell int, home boolean, b int, data binary"), "blocks")
    homes = F.broadcast(sizes.where("home").select("dim", "cell", F.col("blocks").alias("homes")))
    other = F.broadcast(sizes.where("not home").select("dim", "cell", F.col("blocks").alias("visits")))
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    # a block of the cell's own vectors meets the later ones and those of the visitors; dealt by pair
    left = blocks.where("home").join(homes, ["dim", "cell"]).join(other, ["dim", "cell"], "left").withColumn("visits", F.coalesce("visits", F.lit(0)))
    later = left.select("dim", "cell", F.col("b").alias("i"), F.explode(F.sequence(F.col("b"), F.col("homes") - 1)).alias("j"), F.lit(True).alias("home"), F.col("data").alias("x"))
    guests = left.where("visits > 0").select("dim", "cell", F.col("b").alias("i"), spread(F.col("visits")).alias("j"), F.lit(False).alias("home"), F.col("data").alias("x"))
    right = blocks.join(homes, ["dim", "cell"]).select("dim", "cell", F.explode(F.when(F.col("home"), F.sequence(F.lit(0), F.col("b"))).otherwise(F.sequence(F.lit(0), F.col("homes") - 1))).alias("i"), F.col("b").alias("j"), "home", F.col("data").alias("y"))
    units = later.unionByName(guests).join(right, ["dim", "cell", "i", "j", "home"]).select("dim", "cell", (F.col("home") & (F.col("i") == F.col("j"))).alias("same"), "home", "x", "y")

    def read(raw):
        ids, copies, data = pickle.loads(raw)
        return ids, copies, unit(np.frombuffer(data, kind).reshape(len(ids), -1).astype(np.float64))

    def products(batches):
        for batch in batches:
            for dim, cell, same, home, x_, y_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                (a, na, x), (b, nb, y) = read(x_), read(y_)
                near = x @ y.T >= threshold
                if same:
                    np.fill_diagonal(near, False)
                elif not home and near.any():
                    # a pair that also meets in the visitor's own cell counts where the number is smaller
                    fit = shared.value.get(dim)
                    theirs = _cells_of(y, fit)[0]
                    i, j = np.nonzero(near)
                    dots = x @ fit[0].T
                    both = dots[i].max(axis=1) - dots[i, theirs[j]] <= fit[1]
                    near[i, j] = ~both | (cell < theirs[j])
                if not near.any():
                    continue
                la, lb = a.copy(), b.copy()
                while True:  # the smallest id reachable within this pair of blocks
                    ma = np.minimum(la, np.where(near, lb[None, :], np.iinfo(np.int64).max).min(axis=1))
                    mb = np.minimum(lb, np.where(near, ma[:, None], np.iinfo(np.int64).max).min(axis=0))
                    if (ma == la).all() and (mb == lb).all():
                        break
                    la, lb = ma, mb
                ids, n, v = np.concatenate([a, b]), np.concatenate([near @ nb, (na @ near) * (not same)]), np.concatenate([la, lb])
                keep = (n > 0) | (ids != v)
                yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(n[keep].astype(np.int64)), pa.array(v[keep])], ["id", "n", "v"])

    found = scratch.put(units.mapInArrow(products, "id long, n long, v long"), "found")
    comps = connected_components(found.select(F.col("id").alias("u"), "v"), scratch, "cc")
    count = found.groupBy("id").agg(F.sum("n").alias("n"))
    each = distinct.select("id", "copies", "k1", "k2").join(count, "id", "left").join(comps.withColumnRenamed("node", "id"), "id", "left")
    each = each.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = good.select("id", "k1", "k2").join(each, ["k1", "k2"]).select("id", "n_links", "component_id")
    alone = own.where(~usable(F.col("vec"))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


class VpTree:
    """A vantage-point tree of the rows of a matrix; leaves hold up to ``leaf`` rows, more only if they are equally far."""

    def __init__(self, x: np.ndarray, leaf: int = 128, seed: int = 3) -> None:
        self.x, self.nodes = x, []
        rng = np.random.default_rng(seed)
        todo = [(np.arange(len(x)), None, None)]
        while todo:
            rows, parent, side = todo.pop()
            at = len(self.nodes)
            if parent is not None:
                self.nodes[parent][side] = at
            if len(rows) <= leaf:
                self.nodes.append([rows, None, None, None])
                continue
            v = int(rows[rng.integers(len(rows))])
            d = np.sqrt(((x[rows] - x[v]) ** 2).sum(axis=1))
            mu = float(np.median(d))
            inner = d <= mu
            if inner.all():  # more than half of the rows are equally far
                self.nodes.append([rows, None, None, None])
                continue
            self.nodes.append([v, mu, None, None])
            todo += [(rows[inner], at, 2), (rows[~inner], at, 3)]

    def search(self, q: np.ndarray, found, factor: float = 1.0) -> None:
        """Shows ``found`` the leaves that may matter: ``found.add(which, rows)`` for the queries ``which``.

        A side is skipped if the triangle inequality puts it beyond ``found.radius(which)`` divided by
        ``factor``; 1 is exact.
        """
        stack = [(0, np.arange(len(q)), None)]
        while stack:
            at, which, gap = stack.pop()
            if gap is not None:  # the other side: who still may find something there
                which = which[gap <= found.radius(which) / factor]
            if not len(which):
                continue
            node = self.nodes[at]
            if node[1] is None:
                found.add(which, node[0])
                continue
            d = np.sqrt(((q[which] - self.x[node[0]]) ** 2).sum(axis=1))
            gap = np.abs(d - node[1])
            inner = d <= node[1]
            # last in, first out: near sides before far sides
            stack += [(node[3], which[inner], gap[inner]), (node[2], which[~inner], gap[~inner]), (node[3], which[~inner], None), (node[2], which[inner], None)]


class TopProducts:
    """The k rows of largest inner product of each query, ties to the smaller id.

    ``x`` and ``q`` are the vectors, ``low`` a bound below which a query's products do not matter.  For
    the tree, rows are scaled by the largest length, queries to length one.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, qid: np.ndarray, q: np.ndarray, k: int, low: np.ndarray) -> None:
        self.ids, self.x, self.qid, self.q, self.k = ids, x, qid, q, k
        most = np.abs(x).max()
        self.top = float(np.sqrt(((x / most) ** 2).sum(axis=1)).max() * most)
        self.rows, self.ask = x / self.top, unit(q)
        length = np.abs(q).max(axis=1)
        length = length * np.sqrt(((q / length[:, None]) ** 2).sum(axis=1))
        with np.errstate(over="ignore", invalid="ignore"):
            self.low = np.nan_to_num(low / length / self.top, nan=-np.inf, neginf=-np.inf)
        self.kth = self.low.copy()
        self.score, self.vec = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        self.cosine = np.full((len(q), k), -np.inf)

    def tree_rows(self) -> np.ndarray:
        return np.column_stack([self.rows, np.sqrt(np.maximum(0, 1 - (self.rows**2).sum(axis=1)))])

    def tree_queries(self) -> np.ndarray:
        return np.column_stack([self.ask, np.zeros(len(self.ask))])

    def radius(self, which: np.ndarray) -> np.ndarray:
        """Distance of the k-th row so far; the slack is that of a root of a difference of doubles."""
        return np.sqrt(np.maximum(0, 2 - 2 * np.maximum(self.kth[which], -1.0))) + 1e-7

    def add(self, which: np.ndarray, own: np.ndarray) -> None:
        near = self.ask[which] @ self.rows[own].T
        i, j = np.nonzero(near >= (self.kth[which] - 1e-9)[:, None])
        at, row = which[i], own[j]
        other = self.qid[at] != self.ids[row]
        at, row, near = at[other], row[other], near[i, j][other]
        for a in range(0, len(at), 1 << 18):  # in parts: ties may be many
            self._merge(at[a : a + (1 << 18)], row[a : a + (1 << 18)], near[a : a + (1 << 18)])

    def _merge(self, at, row, near) -> None:
        if not len(at):
            return
        with np.errstate(over="ignore", invalid="ignore"):
            score = (self.q[at] * self.x[row]).sum(axis=1)
        some = np.unique(at)
        who = np.concatenate([np.repeat(some, self.k), at])
        score = np.concatenate([self.score[some].ravel(), score])
        vec = np.concatenate([self.vec[some].ravel(), self.ids[row]])
        cosine = np.concatenate([self.cosine[some].ravel(), near])
        by = np.lexsort((vec, -score, who))
        first = np.searchsorted(who[by], some)
        take = by[first[:, None] + np.arange(self.k)]
        self.score[some], self.vec[some], self.cosine[some] = score[take], vec[take], cosine[take]
        self.kth[some] = np.maximum(self.low[some], self.cosine[some].min(axis=1))


def vp_search(rows: DataFrame, is_query: Column, *, k: int = 20, factor: float = 1.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Returns (query_id, rank, vec_id, score): the k rows of largest inner product with each query row.

    ``is_query`` selects the queries; a query is no candidate of its own.  Ties go to the smaller
    id.  Unusable vectors take no part; vectors of different lengths are not compared.  Of equal
    vectors only the k + 1 smallest ids can be among the nearest, so only they are kept.  A row that
    repeats (id and vector) counts once.  ``factor`` above 1 skips more; 1 is exact.  Products that overflow
    a double are infinite and tie.  An empty table gives an empty result; other columns are not read.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "vptree")
    vec, kind = _typed(rows, vec_col)
    own = rows.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"), F.coalesce(is_query, F.lit(False)).alias("q")).where(usable(F.col("vec")) & F.col("id").isNotNull())
    most = F.array_max(F.transform("vec", lambda x: F.abs(x).cast("double")))
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + (x / most) * (x / most)))
    band = F.floor(F.log2(length) + F.log2(most)).cast("int")
    own = own.select("id", "vec", "q", F.size("vec").alias("dim"), band.alias("band"), F.xxhash64("vec").alias("k1"), F.hash("vec").alias("k2"))
    order = Window.partitionBy("k1", "k2").orderBy("id")
    index = own.select("id", "vec", "dim", "band", "k1", "k2").withColumn("r", F.dense_rank().over(order)).where(F.col("r") <= k + 1).dropDuplicates(["id", "k1", "k2"]).select("id", "vec", "dim", "band")
    index = scratch.put(index, "index")
    # a row for each vector length and each power of two of a norm
    shards = index.groupBy("dim", "band").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("shards"))
    queries = own.where("q").dropDuplicates(["id", "k1", "k2"]).select("id", "vec", "dim")
    blocks = queries.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("blocks"))
    # a bounded sample of the longest vectors, of each length; it only gives first bounds
    first = {}
    for d, b in {r.dim: r.band for r in shards.groupBy("dim").agg(F.max("band").alias("band")).collect()}.items():
        some = index.where((F.col("dim") == d) & (F.col("band") == b)).orderBy(F.xxhash64("id"), "id").select("id", "vec").limit(FIRST).collect()
        first[d] = (np.array([s.id for s in some], np.int64), np.array([s.vec for s in some], np.float64))
    sample = spark.sparkContext.broadcast(first)

    index = index.join(F.broadcast(shards), ["dim", "band"]).withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        ids, x = table.column("id").to_numpy(), _matrix(table.column("vec"))
        one = np.ones((1, x.shape[1]))
        tree = VpTree(TopProducts(ids, x, ids[:1], one, 1, np.zeros(1)).tree_rows())
        data = pickle.dumps((tree.nodes, ids, x.astype(kind)))
        return pa.table([pa.array([table.column(c)[0].as_py()], pa.int32()) for c in ("dim", "band", "shard")] + [pa.array([data], pa.binary())], ["dim", "band", "shard", "tree"])

    trees = scratch.put(index.select("dim", "band", "shard", "id", "vec").groupBy("dim", "band", "shard").applyInArrow(build, "dim int, band int, shard int, tree binary"), "trees")
    queries = queries.join(F.broadcast(blocks), "dim").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    def gather(table: pa.Table) -> pa.Table:
        dim, ids, q = table.column("dim")[0].as_py(), table.column("id").to_numpy(), _matrix(table.column("vec"))
        some, x = sample.value[dim]
        low = np.full(len(ids), -np.inf)
        if len(some) > k:
            got = TopProducts(some, x, ids, q, k, low)
            for a in range(0, len(some), 256):
                got.add(np.arange(len(ids)), np.arange(a, min(len(some), a + 256)))
            low = got.score[:, -1]
        with np.errstate(over="ignore", invalid="ignore"):
            least = float(np.nan_to_num(low / np.abs(q).max(axis=1) / q.shape[1] ** 0.5, nan=-np.inf).min())
        return pa.table([pa.array([dim], pa.int32()), pa.array([least]), pa.array([pickle.dumps((ids, q.astype(kind), low))], pa.binary())], ["dim", "least", "queries"])

    blocks_ = scratch.put(queries.select("dim", "block", "id", "vec").groupBy("dim", "block").applyInArrow(gather, "dim int, least double, queries binary"), "queries")
    # a block goes to the bands whose longest vectors could reach its bounds
    asked = blocks_.join(F.broadcast(shards), "dim").where(F.col("least") <= F.pow(F.lit(2.0), F.col("band") + 2))
    units = asked.select("dim", "band", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "queries").join(trees, ["dim", "band", "shard"])

    def search(batches):
        for batch in batches:
            for tree_, data in zip(batch.column(0), batch.column(1), strict=True):
                nodes, ids, x = pickle.loads(tree_.as_py())
                qid, q, low = pickle.loads(data.as_py())
                got = TopProducts(ids, x.astype(np.float64), qid, q.astype(np.float64), k, low)
                # no product of this shard reaches the bound of these queries
                some = np.flatnonzero(got.low <= 1 + 1e-9)
                if not len(some):
                    continue
                got = TopProducts(ids, got.x, qid[some], got.q[some], k, low[some])
                tree = VpTree.__new__(VpTree)
                tree.x, tree.nodes = got.tree_rows(), nodes
                tree.search(got.tree_queries(), got, factor)
                at, r = np.nonzero((got.vec < np.iinfo(np.int64).max) & (got.score >= low[some][:, None]))
                yield pa.RecordBatch.from_arrays([pa.array(got.qid[at]), pa.array(got.vec[at, r]), pa.array(got.score[at, r])], ["query_id", "vec_id", "score"])

    hits = units.select("tree", "queries").mapInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
