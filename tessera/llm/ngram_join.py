"""N-gram Jaccard self-join by prefix filtering under several global orders.

Two texts link when their sets of ``n``-word shingles satisfy
``100 * |A & B| >= percent * |A | B|``.  The result is one row per text with the
component of the link graph it belongs to; no pair of different texts that link
is lost, and pairs are never all written out.

* Texts with equal sets are one *node* (a 64-bit fingerprint of the set), so exact
  copies cost one row each.
* A first order, by hash, serves as a filter of nodes.  A set of ``m`` shingles may miss
  ``t = m - ceil(percent * m / 100)`` of them in a partner.  The first ``t + k`` shingles of
  two sets that link have at least ``k`` in common, so a node of whose first ``2 t`` shingles fewer
  than the ``k`` of its smallest partner are in the prefix of any other node links with nothing.
  All prefixes are counted, packed by hash ranges; most nodes end here.
* The nodes left are ordered by three further orders: rare shingles first by an estimate of
  their count among these nodes, each order by its own row of a count sketch of fixed size.  Two sets
  that link share a shingle of their first ``t + 1`` under every order.  The first order proposes
  pairs; a pair that shares no prefix shingle under one of the others is dropped before its sets are
  compared, and so is one whose sets surely differ too much: each set has a bitmap of the parity of its
  shingles by hash, and two sets differ in as many shingles as their bitmaps do in bits, or in more.
* The nodes that share a prefix shingle are a list.  Equal lists are one.  All pairs of a tiny
  list are compared at once.  The nodes of others are first compared with a few pivots (the
  nodes of lowest priority); linked nodes merge.  A list whose nodes are all in
  one component is finished.  What is left is compared exactly: all pairs across
  components for short lists.  Long lists get more pivots first; then the nodes outside a long list's largest
  component are compared with that whole component and with each other once, in blocks, and not
  list by list; pairs pass the filters of size and of all orders there too.
"""

from __future__ import annotations

import uuid
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch
from .textkit import U, item_sketch, membership, mix, sequences, shingle_set, texts_of, word_hashes

#: Pivots of a list in each round; later rounds only concern nodes that are not yet linked.
PIVOTS = (4, 24)
#: Lists of up to this many nodes are finished pair by pair: at once, and after one round of pivots.
TINY, SHORT = 8, 24
#: Nodes of a block in the exhaustive comparison, and of a list that one row holds.
BLOCK, LANE = 512, 1024
#: Prefix shingles, and nodes, that a task packs at once.
PACK, NODES = 1 << 20, 60_000
ORDERS = 3


def node_of(shingles: np.ndarray) -> int:
    """A fingerprint of a set, as a signed 64-bit integer."""
    return int((np.add.reduce(mix(shingles ^ U(0x5851F42D4C957F2D))) ^ U(len(shingles))).astype(np.int64))


def missing(m: int, percent: int) -> int:
    """How many of ``m`` shingles a partner may lack."""
    return m + -percent * m // 100


def needed(m: int, percent: int) -> int:
    """How many shingles of the filter's prefix a node shares with any partner: the extra length of its smallest one."""
    return max(1, missing(-(-percent * m // 100), percent))


def filter_prefix(shingles: np.ndarray, percent: int) -> np.ndarray:
    """The shingles that the filter of nodes counts: the first by a hash."""
    m = len(shingles)
    t = missing(m, percent)
    length = t + max(1, t)
    if length >= m:
        return shingles
    return shingles[np.argpartition(mix(shingles ^ U(0xE7037ED1A0B428DB)), length - 1)[:length]]


def prefix(shingles: np.ndarray, sketch, order: int, percent: int) -> np.ndarray:
    """The first shingles of a set under one global order: by the estimate of the order's sketch row, then by a hash."""
    m = len(shingles)
    length = missing(m, percent) + 1
    if length >= m:
        return shingles
    hashed = mix(shingles ^ U(0xA0761D6478BD642F * (order + 1) & 0xFFFF_FFFF_FFFF_FFFF))
    rank = (np.minimum(sketch.row(shingles, order), (1 << 26) - 1).astype(np.uint64) << U(38)) | (hashed >> U(26))
    return shingles[np.argpartition(rank, length - 1)[:length]]


def jaccard_links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Of two sorted sets."""
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
    return 100 * both >= percent * (len(a) + len(b) - both)


def parity(shingles: np.ndarray) -> bytes:
    """A bit for each of 2 ** k hash values, at least as many as shingles: whether an odd number of them has it."""
    width = 1 << max(6, (len(shingles) - 1).bit_length())
    odd = np.bincount((mix(shingles ^ U(0x1D8E4E27C47D124F)) & U(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_link(x: bytes, m: int, y: bytes, n: int, percent: int) -> bool:
    """False only where sets of ``m`` and ``n`` shingles with these parities surely do not link."""
    a, b, width = int.from_bytes(x, "little"), int.from_bytes(y, "little"), 8 * min(len(x), len(y))
    while a >> width:
        a = a >> width ^ a & (1 << width) - 1
    while b >> width:
        b = b >> width ^ b & (1 << width) - 1
    differ = (a ^ b).bit_count()
    return 100 * (m + n - differ) >= percent * (m + n + differ)


def _meet(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted arrays, not empty, have an element in common."""
    return bool((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).any())


LISTS = "token long, cut long, lane int, many int, nodes binary, sizes binary"


def _packed(most: int):
    """Of rows (token, node, m) sorted by token and node: the lists of two nodes or more, packed.  A list of more than
    ``most`` nodes is cut into several rows, numbered by lane, that have the token as ``cut``."""
    fields = [f.split() for f in LISTS.split(", ")]

    def run(batches):
        held, lane = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)], 0

        def row(a: int, b: int, cut: bool) -> tuple:
            t = int(held[0][a])
            return t, t if cut else None, lane, b - a, held[1][a:b].astype("<i8").tobytes(), held[2][a:b].astype("<i4").tobytes()

        for batch in chain(batches, [None]):
            if batch is not None:
                more = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                held = [np.concatenate([old, x]) for old, x in zip(held, more, strict=True)]
            t, out, a = held[0], [], 0
            if not len(t):
                continue
            edges = np.append(np.flatnonzero(np.append(True, t[1:] != t[:-1])), len(t)).tolist()
            for a, b in pairwise(edges):
                while b - a > most:
                    out.append(row(a, a + most, True))
                    lane, a = lane + 1, a + most
                if b == len(t) and batch is not None:  # the last list may go on in the next batch
                    break
                if b - a > 1 or lane:
                    out.append(row(a, b, lane > 0))
                lane, a = 0, b
            held = [x[a:] for x in held]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(zip(*out, strict=True), fields, strict=True)], [f for f, _ in fields])

    return run


def _unpacked(batches):
    """The rows (token, lane, cut, many, node, m) of packed lists."""
    for batch in batches:
        token, cut, lane, many = (batch.column(i) for i in range(4))
        at = pa.array(np.repeat(np.arange(batch.num_rows), many.to_numpy()))
        node, m = (np.frombuffer(b"".join(batch.column(i).to_pylist()), k) for i, k in ((4, "<i8"), (5, "<i4")))
        yield pa.RecordBatch.from_arrays([token.take(at), lane.take(at), cut.take(at), many.take(at), pa.array(node), pa.array(m)], ["token", "lane", "cut", "many", "node", "m"])


def _all_pairs(percent: int):
    """All pairs of the nodes of each packed list whose sizes fit."""

    def run(batches):
        ends: dict[int, tuple] = {}
        for batch in batches:
            us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for k, nodes, sizes in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True):
                i, j = ends.get(k) or ends.setdefault(k, np.triu_indices(k, 1))
                node, m = np.frombuffer(nodes, "<i8"), np.frombuffer(sizes, "<i4").astype(np.int64)
                ok = (100 * np.minimum(m[i], m[j]) >= percent * np.maximum(m[i], m[j])) & (node[i] != node[j])
                us.append(node[i][ok])
                vs.append(node[j][ok])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return run


def _own(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def _tags(nodes: np.ndarray) -> bytes:
    """40 bits of each node's fingerprint."""
    v = nodes.view(np.uint64)
    return (v & U(0xFFFFFFFF)).astype("<u4").tobytes() + (v >> U(32)).astype(np.uint8).tobytes()


def _read_tags(raw: bytes) -> np.ndarray:
    n = len(raw) // 5
    return np.frombuffer(raw, "<u4", n).astype(np.int64) | np.frombuffer(raw, np.uint8, n, 4 * n).astype(np.int64) << 32


FIRST = "id long, n_shingles long, node long, batch long, place int, need int, part int, tokens binary, owners binary, tags binary"


def _first_pass(n: int, percent: int, lower: bool, parts: int):
    """Of texts: a row for each (id to need), and the filter's prefixes packed by hash range (batch and part to tags)."""
    base = ["id", "n_shingles", "node", "batch", "place", "need"]

    def pack(batch: int, held: list[np.ndarray], nodes: list[int]):
        tokens = np.concatenate(held)
        owner = np.repeat(np.arange(len(held), dtype=np.uint16), [len(p) for p in held])
        part = ((tokens >> U(32)) % U(parts)).astype(np.int32)
        by = np.argsort(part, kind="stable")
        tokens, owner, own = tokens[by].astype("<u4"), owner[by], np.array(nodes, np.int64)
        cuts = np.searchsorted(part[by], np.arange(parts + 1))
        used = np.flatnonzero(cuts[1:] > cuts[:-1])
        spans = [slice(int(cuts[p]), int(cuts[p + 1])) for p in used]
        cols = [pa.array(np.full(len(used), batch)), pa.array(used.astype(np.int32))]
        cols += [pa.array([tokens[s].tobytes() for s in spans], pa.binary()), pa.array([owner[s].tobytes() for s in spans], pa.binary())]
        cols.append(pa.array([_tags(own[np.unique(owner[s])]) for s in spans], pa.binary()))
        return _full(cols, ["batch", "part", "tokens", "owners", "tags"])

    def run(batches):
        seen: set[int] = set()
        batch, held, nodes, size = uuid.uuid4().int >> 65, [], [], 0
        for rows in batches:
            out = []
            for i, h in zip(rows.column(0).to_pylist(), word_hashes(texts_of(rows, 1), lower), strict=True):
                s = shingle_set(h, n)
                if not len(s):
                    out.append((i, 0, None, None, None, None))
                    continue
                node = node_of(s)
                if node in seen:
                    out.append((i, len(s), node, None, None, None))
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(node)
                out.append((i, len(s), node, batch, len(held), needed(len(s), percent)))
                held.append(mix(filter_prefix(s, percent)))
                nodes.append(node)
                size += len(held[-1])
                if size >= PACK or len(held) >= NODES:
                    yield pack(batch, held, nodes)
                    batch, held, nodes, size = uuid.uuid4().int >> 65, [], [], 0
            if out:
                kinds = [pa.int64()] * 4 + [pa.int32()] * 2
                yield _full([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], base)
        if held:
            yield pack(batch, held, nodes)

    return run


_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _full(columns: list, names: list[str]) -> pa.RecordBatch:
    """A batch of the first pass, with nulls in the columns of the other kind of row."""
    have, n = dict(zip(names, columns, strict=True)), len(columns[0])
    fields = [f.split() for f in FIRST.split(", ")]
    return pa.RecordBatch.from_arrays([have.get(c, pa.nulls(n, _KINDS[k])) for c, k in fields], [c for c, _ in fields])


def _shared_in_part(table: pa.Table) -> pa.Table:
    """Of the packed prefixes of one hash range: for each batch, how many shingles of each node another node has too."""
    batch = table.column("batch").to_pylist()
    tokens = [np.frombuffer(x, "<u4") for x in table.column("tokens").to_pylist()]
    owners = [np.frombuffer(x, np.uint16) for x in table.column("owners").to_pylist()]
    tags = []
    for own, raw in zip(owners, table.column("tags").to_pylist(), strict=True):
        tags.append(_read_tags(raw)[np.cumsum(np.diff(own.astype(np.int64), prepend=int(own[0])) != 0)])
    t, g = np.concatenate(tokens), np.concatenate(tags)
    order = np.argsort(t, kind="stable")
    t, g = t[order], g[order]
    first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
    several = np.minimum.reduceat(g, first) != np.maximum.reduceat(g, first)
    shared = np.empty(len(t), bool)
    shared[order] = np.repeat(several, np.diff(np.append(first, len(t))))
    out, at = [], 0
    for b, own in zip(batch, owners, strict=True):
        places, counts = np.unique(own[shared[at : at + len(own)]], return_counts=True)
        at += len(own)
        if len(places):
            out.append((b, places.astype("<u2").tobytes(), counts.astype("<u4").tobytes()))
    cols = list(zip(*out, strict=True)) or [(), (), ()]
    return pa.table({"batch": pa.array(cols[0], pa.int64()), "places": pa.array(cols[1], pa.binary()), "counts": pa.array(cols[2], pa.binary())})


def _sum_of_batch(table: pa.Table) -> pa.Table:
    places = np.frombuffer(b"".join(table.column("places").to_pylist()), "<u2").astype(np.int64)
    counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), "<u4")
    total = np.bincount(places, weights=counts).astype(np.int64)
    some = np.flatnonzero(total)
    return pa.table({"batch": pa.array(np.full(len(some), table.column("batch")[0].as_py())), "place": pa.array(some.astype(np.int32)), "shared": pa.array(total[some])})


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n: int = 4, percent: int = 85, lower: bool = True, sketch_bits: int = 20) -> DataFrame:
    """Returns (id_col, n_shingles, component_id), one row per input row.

    A null or blank text has an empty set and links with nothing.  A text of fewer
    than ``n`` words is one shingle.  Texts are read whole, whatever their length; an empty
    table gives an empty result.  Rows that repeat an id each keep their row; such an
    id has one component, the smallest that one of its texts reaches.  A null id gets
    a null component.  Other columns of the input, whatever their names, are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram")
    own = _own(docs, id_col, text_col)
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    # the filter of nodes
    first = scratch.put(own.mapInArrow(_first_pass(n, percent, lower, parts), FIRST), "first")
    base = first.where("part is null").select("id", "n_shingles", "node", "batch", "place", "need")
    packs = first.where("part is not null").select("batch", "part", "tokens", "owners", "tags")
    shared = packs.groupBy("part").applyInArrow(_shared_in_part, "batch long, places binary, counts binary")
    shared = shared.groupBy("batch").applyInArrow(_sum_of_batch, "batch long, place int, shared long")
    alive = base.where("batch is not null").join(shared, ["batch", "place"]).where("shared >= need").select("node").distinct()
    # from here on a node goes by the smallest id that has its text
    rep = base.where("node is not null and id is not null").groupBy("node").agg(F.min("id").alias("id"))
    wanted = scratch.put(rep.join(alive, "node"), "wanted")
    del packs, shared, alive

    # the sets of the nodes left; the filter on ids only spares reading most texts into sets, the join decides
    ids = membership(wanted.select("id"), wanted.count())
    held = spark.sparkContext.broadcast(ids)

    def sets(batches):
        for batch in batches:
            batch = batch.filter(pa.array(held.value.has(batch.column(0))))
            if not batch.num_rows:
                continue
            out = [shingle_set(h, n) for h in word_hashes(texts_of(batch, 1), lower)]
            nodes = [node_of(s) if len(s) else None for s in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array([s.astype("<u8").tobytes() for s in out], pa.binary())], ["id", "node", "items"])

    # met by id alone, so that sets move once
    found_sets = own.where("id is not null").mapInArrow(sets, "id long, node long, items binary")
    found_sets = found_sets.join(wanted.withColumnRenamed("node", "own"), "id").where("node >= own and node <= own").dropDuplicates(["id", "node"])
    plain = scratch.put(found_sets.select(F.col("id").alias("node"), "items"), "plain")
    held.unpersist()
    sketch = item_sketch(plain.select("items"), sketch_bits, ORDERS)
    ranks = spark.sparkContext.broadcast(sketch)
    names = [f"prefix{o}" for o in range(ORDERS)]

    def ordered_prefixes(batches):
        for batch in batches:
            s = [np.frombuffer(raw, "<u8") for raw in batch.column(1).to_pylist()]
            lists_ = pa.array([np.sort(prefix(x, ranks.value, 0, percent)).view(np.int64) for x in s], pa.list_(pa.int64()))
            # of the other orders 32 bits will do: they only filter
            cols = [pa.array([np.unique(prefix(x, ranks.value, o, percent).astype("<u4")).tobytes() for x in s], pa.binary()) for o in range(1, ORDERS)]
            cols = [batch.column(0), pa.array([len(x) for x in s], pa.int32()), batch.column(1), pa.array([parity(x) for x in s], pa.binary()), lists_, *cols]
            yield pa.RecordBatch.from_arrays(cols, ["node", "m", "items", "parity", *names])

    # bucketed by node, so that later joins do not move the sets
    name = f"tessera_sets_{scratch.root.rpartition('-')[2]}"
    schema = "node long, m int, items binary, parity binary, prefix0 array<long>, " + ", ".join(f"{c} binary" for c in names[1:])
    plain.mapInArrow(ordered_prefixes, schema).write.option("path", f"{scratch.root}/sets").bucketBy(parts, "node").sortBy("node").saveAsTable(name)
    nodes = spark.table(name)
    marks = ["m", "parity", *names[1:]]
    items, filters = nodes.select("node", "items"), nodes.select("node", *marks)
    scratch.drop("plain")
    listed = nodes.select(F.explode("prefix0").alias("token"), "node", "m").repartition("token").sortWithinPartitions("token", "node")
    # equal lists are one, by the smallest of their tokens
    lists = listed.mapInArrow(_packed(LANE), LISTS).groupBy("cut", "lane", "many", "nodes", "sizes").agg(F.min("token").alias("token"))
    lists = scratch.put(lists.select(*(f.split()[0] for f in LISTS.split(", "))), "lists")
    ranks.unpersist()
    tiny = F.expr(f"cut is null and many <= {min(TINY, SHORT)}")
    open_ = lists.where(~tiny).mapInArrow(_unpacked, "token long, lane int, cut long, many int, node long, m int")
    open_ = open_.select("token", "lane", "cut", F.expr(f"cut is not null or many > {SHORT}").alias("long"), "node", "m")
    # a list longer than LANE is dealt over several tasks
    lanes = lists.where("cut is not null").groupBy("cut").agg((F.max("lane") + 1).alias("lanes"))
    open_ = open_.withColumn("lanes", F.lit(1)) if lanes.isEmpty() else open_.join(lanes, "cut", "left").withColumn("lanes", F.coalesce("lanes", F.lit(1)))
    open_ = open_.drop("cut")

    def everywhere(df: DataFrame) -> DataFrame:
        return df.withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1))).drop("lanes")

    def alike(batches):
        for batch in batches:
            c = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            ok = [may_link(*x, percent) for x in zip(c["a_parity"], c["a_m"], c["b_parity"], c["b_m"], strict=True)]
            for o in names[1:]:
                ok = [k and _meet(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")) for k, x, y in zip(ok, c[f"a_{o}"], c[f"b_{o}"], strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    def verify(batches):
        for batch in batches:
            pairs = zip(batch.column(2), batch.column(3), strict=True)
            ok = [jaccard_links(np.frombuffer(p.as_buffer(), "<u8"), np.frombuffer(q.as_buffer(), "<u8"), percent) for p, q in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    def links(pairs: DataFrame) -> DataFrame:
        """Pairs (u, v) that pass the filters of differences and of the other orders and then the exact comparison."""
        a = filters.select(F.col("node").alias("u"), *(F.col(c).alias(f"a_{c}") for c in marks))
        b = filters.select(F.col("node").alias("v"), *(F.col(c).alias(f"b_{c}") for c in marks))
        p = scratch.put(pairs.distinct().join(a, "u").join(b, "v").mapInArrow(alike, "u long, v long").distinct(), f"pairs{r}")
        p = p.join(items.withColumnRenamed("node", "u").withColumnRenamed("items", "x"), "u")
        p = p.join(items.withColumnRenamed("node", "v").withColumnRenamed("items", "y"), "v")
        return p.select("u", "v", "x", "y").mapInArrow(verify, "u long, v long")

    fits = F.expr(f"100 * least(m, n) >= {percent} * greatest(m, n)")
    ends = [F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")]

    def with_pivots(held: DataFrame) -> DataFrame:
        prio = F.xxhash64(F.lit(r), "node")
        pick = held.groupBy("token", F.pmod(prio, F.lit(PIVOTS[r])).alias("k")).agg(F.min(F.struct(prio.alias("p"), "node", "m", "component")).alias("q"), F.max("lanes").alias("lanes"))
        pick = everywhere(pick.select("token", "lanes", F.col("q.node").alias("other"), F.col("q.m").alias("n"), F.col("q.component").alias("c")))
        return held.join(pick, ["token", "lane"]).where("component != c").where(fits).select(*ends)

    # nodes without a row are components of their own
    component = spark.createDataFrame([], "node long, component long")
    for r in range(len(PIVOTS) + 1):
        if r == 0:
            found = links(lists.where(tiny).mapInArrow(_all_pairs(percent), "u long, v long").union(with_pivots(open_.withColumn("component", F.col("node")))))
        else:
            held = open_ if r == 1 else open_.where("long")
            held = held.drop("component").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
            held = scratch.put(held, f"held{r}")
            live = held.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("lanes").alias("lanes")).where("lo != hi")
            open_ = scratch.put(held.join(everywhere(live), ["token", "lane"], "left_semi"), f"open{r}")
            scratch.drop(f"held{r}")
            if open_.isEmpty():
                break
        if r == 1:
            loose = open_.where("not long").select("token", "node", "m", "component")
            other = loose.select("token", F.col("node").alias("other"), F.col("m").alias("n"), F.col("component").alias("c"))
            pairs = loose.join(other, "token").where("node < other and component != c").where(fits).select(*ends)
            found = links(pairs.union(with_pivots(open_.where("long"))))
        elif r > 1:
            size = open_.groupBy("token", "component").agg(F.count(F.lit(1)).alias("c"), F.max("lanes").alias("lanes"))
            main = size.groupBy("token").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.max("lanes").alias("lanes"))
            strays = open_.drop("lanes").join(everywhere(main), ["token", "lane"]).where("component != main").select("node", "component", "main").distinct()
            strays = scratch.put(strays, "strays")
            members = component.union(strays.select("main", "main")).distinct()
            found = _in_blocks(strays, members, nodes, names, percent)
        found = scratch.put(found, f"found{r}")
        if found.isEmpty():
            continue
        edges = component.toDF("u", "v").union(found)
        component = scratch.put(connected_components(edges, scratch, f"cc{r}"), f"component{r}")

    spark.sql(f"DROP TABLE IF EXISTS {name}")
    scratch.drop("sets")

    # back to rows; an id that repeats joins its texts
    own_rep = rep.select("node", F.col("id").alias("rep"))
    held = base.select("id", "n_shingles", "node").join(own_rep, "node", "left").join(component.withColumnRenamed("node", "rep"), "rep", "left")
    out = held.select("id", "n_shingles", F.coalesce("component", "rep", "id").alias("c"))
    repeated = out.groupBy("id").agg(F.min("c").alias("component_id"))
    return out.join(repeated, "id", "left").select(F.col("id").alias(id_col), "n_shingles", F.col("component_id"))


def _in_blocks(strays: DataFrame, component: DataFrame, nodes: DataFrame, names: list[str], percent: int) -> DataFrame:
    """Links of the strays (node, component, main) with the component ``main`` and with its other strays, compared in
    blocks under the same filters; for a node and a block, one for each component that it reaches."""
    few = strays.groupBy("main").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    fields = F.collect_list(F.struct("node", "component", "items", *names)).alias("rows")
    member = component.join(few.select(F.col("main").alias("component")), "component", "left_semi").select("node", "component", F.col("component").alias("main")).union(strays)
    size = member.groupBy("main").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    whole = member.join(size, "main").withColumn("block", block).join(nodes, "node").groupBy("main", "block").agg(fields)
    lone = strays.join(few, "main").withColumn("chunk", block).join(nodes, "node").groupBy("main", "chunk").agg(fields)
    # dealt by component and block, not by component
    lone = lone.join(size, "main").select("main", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("rows").alias("strays"))
    units = lone.join(whole, ["main", "block"]).select("strays", "rows")

    def index(sets: list[np.ndarray]):
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(tokens, kind="stable")
        return tokens[order], owner[order]

    def hits(of, s: np.ndarray, count: int) -> np.ndarray:
        """How many of ``s`` each indexed set has."""
        lo, hi = np.searchsorted(of[0], s), np.searchsorted(of[0], s, "right")
        got = [of[1][a:b] for a, b in zip(lo, hi, strict=True) if b > a]
        return np.bincount(np.concatenate(got), minlength=count) if got else np.zeros(count, np.int64)

    def part(row: dict, c: str) -> np.ndarray:
        return np.asarray(row[c]) if c == names[0] else np.frombuffer(row[c], "<u4")

    def compare(frames):
        for pdf in frames:
            out = []
            for strays_, rows in zip(pdf["strays"], pdf["rows"], strict=True):
                sets = [np.frombuffer(r["items"], "<u8") for r in rows]
                size, comp = np.array([len(s) for s in sets]), np.array([r["component"] for r in rows])
                whole, orders = index(sets), [index([part(r, c) for r in rows]) for c in names]
                for x in strays_:
                    s = np.frombuffer(x["items"], "<u8")
                    open_ = (comp != x["component"]) & (100 * np.minimum(size, len(s)) >= percent * np.maximum(size, len(s)))
                    for c, of in zip(names, orders, strict=True):
                        if open_.any():
                            open_ &= hits(of, part(x, c), len(rows)) > 0
                    if open_.any():
                        both = hits(whole, s, len(rows))
                        ok = np.flatnonzero(open_ & (100 * both >= percent * (size + len(s) - both)))
                        out += [(x["node"], rows[int(ok[i])]["node"]) for i in np.unique(comp[ok], return_index=True)[1]]
            yield pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    return units.mapInPandas(compare, "u long, v long")
