"""Longest and shortest paths of deep graphs in rounds that grow with the logarithm of the depth.

The layer of a node is a function of the layers of what it needs: of one need it is ``max(b, x + d)``, with x the need's layer.
Such functions compose to one of the same kind, so nodes with one open need are contracted: in each round a node's need
becomes its need's need (pointer jumping), until it is a node that has several or none.  The edges of
nodes with several needs are then led through the contracted ones, which merges edges and leaves more nodes with one.
Contracted nodes get their layer at the end, from the node they were contracted to.  Chains, trees and series of
diamonds take a logarithmic number of rounds; a graph that is wide and tangled is peeled, a layer in a round at worst.

Distances from entries work alike with minima and single predecessors.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Steps, strong_components
from .ordered import positions

#: The layer of a node that reaches a cycle; sums of layers stay far below.
_NEVER = 1 << 60


def _jump(ptr: DataFrame, steps: Steps, best, rounds: list) -> DataFrame:
    """``ptr`` (id, to, d, b): f(x) = best(b, x + d) of node ``to``.  Leads every node to one that has no entry.

    After k rounds the nodes still moving are those more than 2^k steps away from such a one.  Any such node has one at
    every smaller distance on its way, so once their number stays, they all run in circles, and keep a ``to`` that has an entry.
    """
    before = None
    while True:
        up = ptr.select(F.col("id").alias("to"), F.col("to").alias("up"), F.col("d").alias("ud"), F.col("b").alias("ub"))
        new = ptr.join(up, "to", "left").select("id", F.coalesce("up", "to").alias("to"), (F.col("d") + F.coalesce("ud", F.lit(0))).alias("d"), best("b", F.col("ub") + F.col("d")).alias("b"), F.col("up").isNotNull().alias("moved"))
        new = steps.put(new)
        rounds.append("jump")
        ptr, moving = new.select("id", "to", "d", "b"), new.where("moved").count()
        if moving in (0, before):
            return ptr
        before = moving


def layers(edges: DataFrame, nodes: DataFrame, depends: bool = True, rounds: list | None = None) -> DataFrame:
    """(id, layer): the longest path of needs below each node; null for nodes that need themselves or an unknown node, however far off.

    ``depends``: source needs target, so targets come first.  ``rounds`` collects a mark for each round.
    """
    a, b = ("source_id", "target_id") if depends else ("target_id", "source_id")
    ids = nodes.select("id").distinct()
    e = edges.select(F.col(a).alias("id"), F.col(b).alias("need"), F.lit(1).cast("long").alias("d")).where("id <> need").distinct()
    layer = F.when(F.col("layer") < _NEVER, F.col("layer").cast("int"))
    return ids.join(_heaviest(e, ids, [] if rounds is None else rounds).select("id", layer.alias("layer")), "id", "left")


def _heaviest(edges: DataFrame, ids: DataFrame, rounds: list) -> DataFrame:
    """(id, layer): the greatest sum of ``d`` along needs (id, need, d) below each of ``ids``; ``_NEVER`` or no row where there is a cycle."""
    steps = Steps(edges)
    e = edges.join(ids, "id", "left_semi")
    e = e.join(ids.select(F.col("id").alias("need"), F.lit(True).alias("known")), "need", "left")
    open_ = ids.join(e.where("known is null").select("id").distinct().withColumn("lost", F.lit(True)), "id", "left")
    open_ = steps.put(open_.select("id", F.when(F.col("lost"), _NEVER).otherwise(0).cast("long").alias("b")))
    e = steps.put(e.where("known").select("id", "need", "d"))
    done: list[DataFrame] = []
    later: list[DataFrame] = []
    while not open_.isEmpty():
        rounds.append("peel")
        # nodes without open needs have their layer; it settles the edges to them
        ready = steps.put(open_.join(e.select("id").distinct(), "id", "left_anti"))
        found = not ready.isEmpty()
        if found:
            done.append(ready.select("id", F.col("b").alias("layer")))
            settled = e.join(ready.select(F.col("id").alias("need"), F.col("b").alias("x")), "need")
            gain = settled.groupBy("id").agg(F.max(F.col("x") + F.col("d")).alias("g"))
            rest = open_.join(ready.select("id"), "id", "left_anti")
            open_ = steps.put(rest.join(gain, "id", "left").select("id", F.least(F.greatest("b", "g"), F.lit(_NEVER)).alias("b")))
            e = steps.put(e.join(ready.select(F.col("id").alias("need")), "need", "left_anti").select("id", "need", "d"))
        one = e.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("to"), F.min("d").alias("d")).where("n = 1")
        ptr = steps.put(one.join(open_, "id").select("id", "to", "d", "b"))
        if ptr.isEmpty():
            if not found:
                break  # every node left has needs left: all of them reach a cycle
            continue
        ptr = _jump(ptr, steps, F.greatest, rounds)
        # what still leads to a contracted node runs in a circle
        inner = ptr.select(F.col("id").alias("to"), F.lit(True).alias("inner"))
        ptr = steps.put(ptr.join(inner, "to", "left").select("id", F.when(F.col("inner").isNull(), F.col("to")).alias("to"), "d", F.when(F.col("inner"), _NEVER).otherwise(F.least("b", F.lit(_NEVER))).alias("b")))
        later.append(ptr)
        by = ptr.select(F.col("id").alias("need"), F.lit(True).alias("via"), "to", F.col("d").alias("pd"), F.col("b").alias("pb"))
        led = e.join(ptr.select("id"), "id", "left_anti").join(by, "need", "left")
        led = led.select("id", F.when(F.col("via"), F.col("to")).otherwise(F.col("need")).alias("need"), (F.col("d") + F.coalesce("pd", F.lit(0))).alias("d"), (F.col("d") + F.col("pb")).alias("g"))
        led = steps.put(led.select("id", "need", "d", F.when(F.col("need") == F.col("id"), _NEVER).otherwise(F.col("g")).alias("g")))
        gain = led.groupBy("id").agg(F.max("g").alias("g"))
        open_ = steps.put(open_.join(ptr.select("id"), "id", "left_anti").join(gain, "id", "left").select("id", F.least(F.greatest("b", "g"), F.lit(_NEVER)).alias("b")))
        e = steps.put(led.where("need is not null and need <> id").groupBy("id", "need").agg(F.max("d").alias("d")))
    found = reduce(DataFrame.union, done, ids.limit(0).withColumn("layer", F.lit(0).cast("long")))
    for ptr in reversed(later):
        below = found.select(F.col("id").alias("to"), "layer")
        got = ptr.join(below, "to", "left").select("id", F.greatest("b", F.coalesce("layer", F.lit(_NEVER)) + F.col("d")).alias("layer"))
        found = steps.put(found.union(got))
    return found


def condensation(edges: DataFrame, nodes: DataFrame, rounds: list | None = None) -> DataFrame:
    """(id, scc, layer, position): the order in which to take nodes so that targets come before sources.

    ``scc`` is the smallest id of a node's strongly connected component, ``layer`` the longest path of components below it,
    ``position`` the place of the component among all, by layer and then by name; the nodes of one go together.
    Raises on an edge to a node that is not there.
    """
    ids = nodes.select("id").distinct()
    ends = edges.select(F.col("source_id").alias("id")).union(edges.select("target_id")).distinct()
    unknown = ends.join(ids, "id", "left_anti").first()
    if unknown is not None:
        raise ValueError(f"edge references unknown node {unknown[0]!r}")
    steps = Steps(edges)
    down = steps.put(layers(edges, ids, True, rounds))
    tangled = down.where("layer is null").select("id")
    if tangled.isEmpty():
        out = down.select("id", F.col("id").alias("scc"), "layer")
    else:
        # only nodes that reach a cycle and are reached from one can lie on one
        own = edges.join(tangled.withColumnRenamed("id", "source_id"), "source_id", "left_semi").select("source_id", "target_id").join(tangled.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
        core = steps.put(layers(own, tangled, False, rounds)).where("layer is null").select("id")
        inner = own.join(core.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(core.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
        scc = steps.put(strong_components(inner.select("source_id", "target_id"), core))
        scc = steps.put(ids.join(scc, "id", "left").select("id", F.coalesce("scc", "id").alias("scc")))
        name = [scc.select(F.col("id").alias(f"{k}_id"), F.col("scc").alias(k)) for k in ("source", "target")]
        between = edges.join(name[0], "source_id").join(name[1], "target_id").where("source <> target").select(F.col("source").alias("source_id"), F.col("target").alias("target_id")).distinct()
        level = layers(steps.put(between), scc.select(F.col("scc").alias("id")).distinct(), True, rounds)
        out = scc.join(level.withColumnRenamed("id", "scc"), "scc").select("id", "scc", "layer")
    out = steps.put(out)
    places = positions(out.select("scc", "layer").distinct(), [], ["layer", "scc"], "position").select("scc", "position")
    return out.join(places, "scc").select("id", "scc", "layer", "position")


class _Search:
    """Longest simple paths inside one strongly connected component, by numbers of nodes."""

    def __init__(self, edges: list[tuple[str, str]], cap: int, budget: int) -> None:
        self.names = sorted({x for e in edges for x in e})
        at = {n: i for i, n in enumerate(self.names)}
        self.out = [0] * len(self.names)
        for a, b in edges:
            self.out[at[a]] |= 1 << at[b]
        self.cap, self.budget, self.exact = cap, budget, True

    def pairs(self) -> list[tuple[str, str, int]]:
        """(from, to, nodes on the longest simple path)."""
        n = len(self.names)
        return [(self.names[u], self.names[v], best) for u in range(n) for v, best in (self._subsets(u) if n <= SUBSETS else self._walks(u)).items()]

    def _subsets(self, u: int) -> dict[int, int]:
        """Which nodes can end a path over exactly a set of nodes, for all sets, by size."""
        ends, best = {1 << u: 1 << u}, {u: 1}
        for size in range(1, min(len(self.names), self.cap)):
            longer: dict[int, int] = {}
            for mask, lasts in ends.items():
                for v in _bits(lasts):
                    for w in _bits(self.out[v] & ~mask):
                        longer[mask | 1 << w] = longer.get(mask | 1 << w, 0) | 1 << w
            for lasts in longer.values():
                for w in _bits(lasts):
                    best[w] = size + 1
            ends = longer
        return best

    def _walks(self, u: int) -> dict[int, int]:
        """Depth-first over simple paths of at most ``cap`` nodes; ``exact`` falls if the budget ends first."""
        best, steps = {u: 1}, 0
        stack = [(u, 1 << u, 1)]
        while stack:
            v, mask, size = stack.pop()
            steps += 1
            if steps > self.budget:
                self.exact = False
                break
            best[v] = max(best.get(v, 0), size)
            if size < self.cap:
                stack += [(w, mask | 1 << w, size + 1) for w in _bits(self.out[v] & ~mask)]
        return best


def _bits(x: int):
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


#: Nodes of a component up to which all sets of its nodes are looked at, and up to which it is searched at all; steps from a node.
SUBSETS, SEARCHED, STEPS = 12, 64, 100_000


def longest_simple_path(edges: DataFrame, nodes: DataFrame, entries: DataFrame, cap: int = 40, searched: int = SEARCHED, budget: int = STEPS) -> DataFrame:
    """One row (longest, exact): nodes on the longest simple path from an entry, at most ``cap``, of a graph with cycles.

    A path never comes back to a strongly connected component, so it is a way through components with a simple path in each.
    Components of up to ``searched`` nodes are searched, each in a task of its own: those of up to ``SUBSETS`` nodes over
    all sets of nodes, larger ones depth-first with a budget of steps.  ``exact`` is false where a budget ended or a component was
    too large (there, only its nodes and edges count); the length is one that exists then, and may not be the longest,
    unless it is ``cap``.
    """
    steps = Steps(edges)
    ids = nodes.select("id").distinct()
    order = steps.put(condensation(edges, ids).select("id", "scc"))
    ends = [order.select(F.col("id").alias(f"{k}_id"), F.col("scc").alias(k)) for k in ("source", "target")]
    all_ = steps.put(edges.select("source_id", "target_id").where("source_id <> target_id").distinct().join(ends[0], "source_id").join(ends[1], "target_id"))
    sizes = order.groupBy("scc").agg(F.count(F.lit(1)).alias("n"))
    inner = all_.where("source = target").join(sizes.where(f"n <= {searched}").withColumnRenamed("scc", "source"), "source")

    def search(table: pa.Table) -> pa.Table:
        s = _Search(list(zip(table["source_id"].to_pylist(), table["target_id"].to_pylist(), strict=True)), cap, budget)
        rows = s.pairs()
        return pa.table({"u": pa.array([r[0] for r in rows], pa.string()), "v": pa.array([r[1] for r in rows], pa.string()), "n": pa.array([r[2] for r in rows], pa.int64()), "exact": pa.array([s.exact] * len(rows), pa.bool_())})

    found = inner.select("source", "source_id", "target_id").groupBy("source").applyInArrow(search, "u string, v string, n long, exact boolean")
    one = order.join(sizes.where(f"n = 1 or n > {searched}"), "scc").select(F.col("id").alias("u"), F.col("id").alias("v"), F.lit(1).cast("long").alias("n"), (F.col("n") == 1).alias("exact"))
    pair = all_.where("source = target").join(sizes.where(f"n > {searched}").withColumnRenamed("scc", "source"), "source").select(F.col("source_id").alias("u"), F.col("target_id").alias("v"), F.lit(2).cast("long").alias("n"), F.lit(False).alias("exact"))
    ways = steps.put(found.union(one).union(pair))
    # a node is there twice: where a path comes into its component and where it leaves it
    into, leave = lambda c: F.concat(F.lit("i"), c), lambda c: F.concat(F.lit("o"), c)
    e = ways.select(into("u").alias("id"), leave("v").alias("need"), F.col("n").alias("d"))
    e = steps.put(e.union(all_.where("source <> target").select(leave("source_id"), into("target_id"), F.lit(0).cast("long"))))
    twice = order.select(into("id").alias("id")).union(order.select(leave("id")))
    best = _heaviest(e, twice, []).join(entries.select(into("id").alias("id")).distinct(), "id", "left_semi").agg(F.coalesce(F.max("layer"), F.lit(0)).alias("n"))
    whole = ways.agg(F.coalesce(F.min("exact"), F.lit(True)).alias("whole"))
    return best.crossJoin(whole).select(F.least("n", F.lit(cap)).cast("int").alias("longest"), (F.col("whole") | (F.col("n") >= cap)).alias("exact"))


def distances(edges: DataFrame, entries: DataFrame, rounds: list | None = None) -> DataFrame:
    """(id, depth): the fewest edges from an entry to each node it reaches; entries are at 0.

    Nodes with one predecessor are contracted first; distances then spread over the nodes with several until none falls.
    """
    rounds = [] if rounds is None else rounds
    steps = Steps(edges)
    start = steps.put(entries.select("id").distinct())
    e = steps.put(edges.select(F.col("source_id").alias("s"), F.col("target_id").alias("id")).where("s <> id").distinct().join(start, "id", "left_anti"))
    one = e.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("to")).where("n = 1")
    ptr = steps.put(one.select("id", "to", F.lit(1).cast("long").alias("d"), F.lit(None).cast("long").alias("b")))
    if not ptr.isEmpty():
        ptr = _jump(ptr, steps, F.least, rounds)
        ptr = steps.put(ptr.join(ptr.select(F.col("id").alias("to")), "to", "left_anti"))  # a circle of single predecessors has no entry
    led = e.join(one.select("id"), "id", "left_anti").join(ptr.select(F.col("id").alias("s"), "to", "d"), "s", "left")
    # where the predecessor lies in a circle without entries there is no way
    led = led.select(F.coalesce("to", "s").alias("s"), "id", (F.coalesce("d", F.lit(0)) + 1).alias("d"))
    led = steps.put(led.groupBy("s", "id").agg(F.min("d").alias("d")))
    at = steps.put(start.withColumn("depth", F.lit(0).cast("long")))
    front = at
    while True:
        rounds.append("spread")
        offer = front.select(F.col("id").alias("s"), "depth").join(led, "s").groupBy("id").agg(F.min(F.col("depth") + F.col("d")).alias("depth"))
        new = steps.put(at.withColumn("old", F.lit(True)).union(offer.withColumn("old", F.lit(False))).groupBy("id").agg(F.min("depth").alias("depth"), F.min(F.when(F.col("old"), F.col("depth"))).alias("was")))
        front = new.where("was is null or depth < was").select("id", "depth")
        at = new.select("id", "depth")
        if front.isEmpty():
            break
    inner = ptr.join(at.select(F.col("id").alias("to"), "depth"), "to").select("id", (F.col("depth") + F.col("d")).alias("depth"))
    return at.union(inner).select("id", F.col("depth").cast("int").alias("depth"))
