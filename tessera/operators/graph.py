"""Property graph as two DataFrames: nodes (id, name, type, file_path, ...) and edges (source_id, target_id, relationship, ...)."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert_latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last write of each key."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), order).alias("r")).select(*key, "r.*")


def insert_absent(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows whose key, compared null-safely, neither exists nor repeats."""
    a, b = new.dropDuplicates(key).alias("a"), existing.alias("b")
    cond = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    return a.join(b, cond, "left_anti")


def delete_file(nodes: DataFrame, edges: DataFrame, file_path: str) -> tuple[DataFrame, DataFrame]:
    gone = nodes.where(F.col("file_path") == file_path).select("id")
    left = edges.join(gone, edges.source_id == gone.id, "left_anti")
    left = left.join(gone, left.target_id == gone.id, "left_anti")
    return nodes.where(~F.col("file_path").eqNullSafe(file_path)), left


def neighbours(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    ids = edges.where(F.col("source_id") == node_id).select(F.col("target_id").alias("id")).union(edges.where(F.col("target_id") == node_id).select("source_id"))
    return nodes.join(ids.distinct(), "id", "left_semi")


def callees(nodes: DataFrame, edges: DataFrame, node_id: str, relationship: str = "CALLS", limit: int | None = 50) -> DataFrame:
    ids = edges.where((F.col("source_id") == node_id) & (F.col("relationship") == relationship)).select(F.col("target_id").alias("id")).distinct().orderBy("id")
    return nodes.join(ids.limit(limit) if limit else ids, "id", "left_semi")


def callers(nodes: DataFrame, edges: DataFrame, node_id: str, relationship: str = "CALLS", limit: int | None = 50) -> DataFrame:
    ids = edges.where((F.col("target_id") == node_id) & (F.col("relationship") == relationship)).select(F.col("source_id").alias("id")).distinct().orderBy("id")
    return nodes.join(ids.limit(limit) if limit else ids, "id", "left_semi")


def search(nodes: DataFrame, text: str, limit: int = 200) -> DataFrame:
    """Case-insensitive substring search; ``%`` and ``_`` are wildcards; ordered by id."""
    p = f"%{text}%"
    hit = F.col("name").ilike(p) | F.col("id").ilike(p) | F.coalesce(F.col("file_path").ilike(p), F.lit(False))
    return nodes.where(hit).orderBy("id").limit(limit)


def typed_search(nodes: DataFrame, text: str, types: list[str], limit: int = 20) -> DataFrame:
    limit = min(100, max(1, limit))
    if not text.strip():
        return nodes.limit(0)
    return nodes.where(F.col("type").isin(types) & F.lower("name").like(f"%{text.lower()}%")).orderBy("file_path", "start_line", "name").limit(limit)


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    a = nodes.agg(F.count(F.lit(1)).alias("n_nodes"), *[F.count_if(F.col("type") == x).alias(f"n_{x}") for x in ("region", "nation", "customer", "supplier")], F.count_distinct("file_path").alias("n_files"))
    b = edges.agg(F.count(F.lit(1)).alias("n_edges"))
    return a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k").drop("k")


def delta(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change, fields): rows added, removed or modified, with the names of the fields that differ."""
    a = old.select(key, F.struct(*columns).alias("o"))
    b = new.select(key, F.struct(*columns).alias("n"))
    both = a.join(b, key, "full_outer")
    fields = F.filter(F.array(*[F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), c) for c in columns]), lambda x: x.isNotNull())
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.size(fields) > 0, "modified")
    out = both.select(key, change.alias("change"), F.when(F.col("o").isNotNull() & F.col("n").isNotNull(), F.array_join(fields, ",")).otherwise("").alias("fields"))
    return out.where("change is not null")


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("target_id").contains("::")).groupBy("target_id").agg(F.count(F.lit(1)).alias("in_degree"))


def drop_external(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.select("id")
    e = edges.join(n, edges.source_id == n.id, "left_semi")
    return e.join(n, e.target_id == n.id, "left_semi")


def degree_topk(edges: DataFrame, k: int) -> DataFrame:
    return in_degree(edges).orderBy(F.desc("in_degree"), "target_id").limit(k)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only for a local master (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        where = "file://" + folder
        spark.sparkContext.setCheckpointDir(where)
    return where


class Steps:
    """Round tables of an iteration, in the folder named by spark.checkpoint.dir."""

    def __init__(self, df: DataFrame) -> None:
        spark = df.sparkSession
        where = shared_dir(spark)
        self.spark, self.root, self.n = spark, f"{where.rstrip('/')}/steps-{uuid.uuid4().hex}", 0

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        schema = df.schema
        df.write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)


def reachable(edges: DataFrame, entries: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(id, depth): breadth-first from the entries, which count as reached at depth 0."""
    steps = Steps(edges)
    e = steps.put(edges.select(F.col("source_id").alias("s"), F.col("target_id").alias("id")).distinct())
    seen = steps.put(entries.select("id").distinct().withColumn("depth", F.lit(0)))
    front, depth = seen, 0
    while max_hops is None or depth < max_hops:
        depth += 1
        nxt = front.select(F.col("id").alias("s")).join(e, "s").select("id").distinct().join(seen.select("id"), "id", "left_anti")
        front = steps.put(nxt.withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def trace(edges: DataFrame, entries: DataFrame, hops: int) -> DataFrame:
    """Nodes within ``hops`` of the entries in either direction, with their depth."""
    both = edges.select("source_id", "target_id").union(edges.select("target_id", "source_id"))
    return reachable(both, entries, hops)


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component): numbers from 0 in the order of each component's smallest id."""
    steps = Steps(edges)
    both = steps.put(edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).union(edges.select("target_id", "source_id")).where("a <> b").distinct())
    label = steps.put(nodes.select("id", F.col("id").alias("low")))
    while True:
        near = both.join(label, both.b == label.id).groupBy("a").agg(F.min("low").alias("m"))
        step = label.join(near, label.id == near.a, "left").select("id", F.col("low").alias("old"), F.least("low", F.coalesce("m", "low")).alias("low"))
        # pointer jumping: the label's own label
        up = step.select(F.col("id").alias("low"), F.col("low").alias("up"))
        new = steps.put(step.join(up, "low").select("id", F.least("low", "up").alias("low"), (F.least("low", "up") != F.col("old")).alias("moved")))
        label = new.select("id", "low")
        if new.where("moved").isEmpty():
            break
    from .ordered import positions

    number = positions(label.select("low").distinct(), [], ["low"], "component")
    return label.join(number, "low").select("id", F.col("component").cast("int").alias("component"))


def layers(edges: DataFrame, nodes: DataFrame, depends: bool = True) -> DataFrame:
    """(id, layer): the longest path of dependencies below each node; nodes on a cycle get null.

    ``depends``: source needs target, so targets come first.
    """
    steps = Steps(edges)
    a, b = ("source_id", "target_id") if depends else ("target_id", "source_id")
    open_ = steps.put(edges.select(F.col(a).alias("id"), F.col(b).alias("need")).where("id <> need").distinct())
    rest = nodes.select("id").distinct()
    done = rest.limit(0).withColumn("layer", F.lit(0))
    layer = 0
    while True:
        ready = rest.join(done.select("id"), "id", "left_anti").join(open_.select("id"), "id", "left_anti")
        ready = steps.put(ready.withColumn("layer", F.lit(layer)))
        if ready.isEmpty():
            break
        done = done.union(ready)
        open_ = steps.put(open_.join(ready.select(F.col("id").alias("need")), "need", "left_anti").select("id", "need"))
        layer += 1
    return nodes.select("id").distinct().join(done, "id", "left")


def topological_groups(nodes: list[str], edges: list[tuple[str, str]]) -> list[list[str]]:
    """Strongly connected groups of a schema-sized graph, dependencies (targets) first.

    Raises on an edge to an unknown node; ties go to the smaller name.
    """
    known = set(nodes)
    for a, b in edges:
        if a not in known or b not in known:
            raise ValueError(f"unknown node in edge {a} -> {b}")
    out: dict[str, set[str]] = {n: set() for n in nodes}
    back: dict[str, set[str]] = {n: set() for n in nodes}
    for a, b in edges:
        out[a].add(b)
        back[b].add(a)
    # Kosaraju with explicit stacks
    order, seen = [], set()
    for root in sorted(nodes):
        stack = [(root, iter(sorted(out[root])))] if root not in seen else []
        seen.add(root)
        while stack:
            n, it = stack[-1]
            nxt = next((x for x in it if x not in seen), None)
            if nxt is None:
                order.append(n)
                stack.pop()
            else:
                seen.add(nxt)
                stack.append((nxt, iter(sorted(out[nxt]))))
    group: dict[str, int] = {}
    groups: list[list[str]] = []
    for root in reversed(order):
        if root in group:
            continue
        members, todo = [], [root]
        group[root] = len(groups)
        while todo:
            n = todo.pop()
            members.append(n)
            for x in back[n]:
                if x not in group:
                    group[x] = len(groups)
                    todo.append(x)
        groups.append(sorted(members))
    need = {i: {group[b] for m in g for b in out[m]} - {i} for i, g in enumerate(groups)}
    result: list[list[str]] = []
    while need:
        i = min((i for i, n in need.items() if not n), key=lambda i: groups[i])
        result.append(groups[i])
        del need[i]
        for n in need.values():
            n.discard(i)
    return result


def fk_order(tables: list[str], keys: list[tuple[str, str]], on_cycle: str = "error") -> list[str]:
    """Parents before children; references to oneself are ignored; ``append`` puts cycles last by name."""
    for child, parent in keys:
        if parent not in tables:
            raise ValueError(f"{child} references unknown table {parent}")
    out: list[str] = []
    for g in topological_groups(tables, [(c, p) for c, p in keys if c != p]):
        if len(g) > 1 and on_cycle == "error":
            raise ValueError(f"foreign keys form a cycle: {', '.join(g)}")
        out += g
    return out


def longest_path(edges: list[tuple[str, str]], entries: list[str], cap: int = 40) -> int:
    """Nodes on the longest simple path from an entry, at most ``cap`` (a driver-side search of a small graph)."""
    out: dict[str, list[str]] = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    best = 0
    stack = [(e, (e,)) for e in entries]
    while stack:
        n, path = stack.pop()
        best = max(best, len(path))
        if best >= cap:
            return cap
        stack += [(x, (*path, x)) for x in out.get(n, ()) if x not in path]
    return best


def resolve_calls(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """(call_id, node_id): a callee's short name to a node, one of the same file first, then the first in order; no node calls itself.

    Only the first two nodes of each name, and of each name in a file, can be chosen, so
    the join never meets all nodes of a frequent name.
    """

    def first_two(keys: list[str], name: str) -> DataFrame:
        own = nodes.select(F.col("name").alias("callee"), F.col("file_path"), F.struct("seq", F.col("id").alias("node_id")).alias("n"))
        one = own.groupBy(*keys).agg(F.min("n").alias("a"))
        # the second one: the least beside the first
        two = own.join(one, keys).where(F.col("n") > F.col("a")).groupBy(*keys).agg(F.min("n").alias("b"))
        return one.join(two, keys, "left").select(*keys, F.array("a", "b").alias(name))

    near = first_two(["callee", "file_path"], "near")
    far = first_two(["callee"], "far")
    hit = calls.join(far, "callee").join(near, ["callee", "file_path"], "left")
    choice = F.filter(F.concat(F.coalesce("near", F.array()), "far"), lambda x: x.isNotNull() & (x["node_id"] != F.col("caller_id")))
    return hit.select("call_id", F.get(choice, F.lit(0))["node_id"].alias("node_id")).where("node_id is not null")


def strong_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, scc): each node with the smallest id of its strongly connected component.

    In a round every open node takes the smallest id that reaches it and the smallest that it reaches.  Where
    both are one id, that is the node's component.  A component lies within the nodes of one pair of ids, so edges
    between pairs go, and the pairs are searched on side by side; a node without edges is its own component.
    """
    steps = Steps(edges)
    ids = nodes.select("id").distinct()
    e = edges.select(F.col("source_id").alias("s"), F.col("target_id").alias("t")).where("s <> t").distinct()
    e = e.join(ids.withColumnRenamed("id", "s"), "s", "left_semi").join(ids.withColumnRenamed("id", "t"), "t", "left_semi")
    open_, e = steps.put(ids), steps.put(e.select("s", "t"))
    done = [open_.limit(0).select("id", F.col("id").alias("scc"))]
    while not e.isEmpty():
        label = open_.select("id", F.col("id").alias("f"), F.col("id").alias("b"))
        while True:
            into = e.join(label.select(F.col("id").alias("s"), "f"), "s").select(F.col("t").alias("id"), "f", F.lit(None).cast("string").alias("b"))
            out = e.join(label.select(F.col("id").alias("t"), "b"), "t").select(F.col("s").alias("id"), F.lit(None).cast("string").alias("f"), "b")
            near = into.union(out).groupBy("id").agg(F.min("f").alias("nf"), F.min("b").alias("nb"))
            f, b = F.least("f", F.coalesce("nf", "f")), F.least("b", F.coalesce("nb", "b"))
            new = steps.put(label.join(near, "id", "left").select("id", f.alias("f"), b.alias("b"), ((f < F.col("f")) | (b < F.col("b"))).alias("moved")))
            label = new.select("id", "f", "b")
            if new.where("moved").isEmpty():
                break
        done.append(label.where("f = b").select("id", "f"))
        rest = label.where("f <> b")
        ends = [rest.select(F.col("id").alias(k), F.struct("f", "b").alias(f"p{k}")) for k in ("s", "t")]
        e = steps.put(e.join(ends[0], "s").join(ends[1], "t").where("ps = pt").select("s", "t"))
        open_ = rest.select("id")
    done.append(open_.select("id", "id"))
    return reduce(lambda a, b: a.union(b), done)


def longest_walk(edges: DataFrame, entries: DataFrame, cap: int = 40) -> DataFrame:
    """One row (longest): nodes on the longest path from an entry, at most ``cap``; of a graph without cycles that is the longest simple path."""
    steps = Steps(edges)
    e = steps.put(edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("to")).distinct())
    front, n = steps.put(entries.select("id").distinct()), 0
    while not front.isEmpty() and n < cap:
        n += 1
        front = steps.put(front.join(e, "id").select(F.col("to").alias("id")).distinct())
    return edges.sparkSession.range(1).select(F.lit(n).alias("longest"))


def trace_edges(edges: DataFrame, entries: DataFrame, hops: int) -> DataFrame:
    """(id, depth, source_id, target_id): every edge at each visited node that it touches."""
    seen = trace(edges, entries, hops)
    e = edges.select("source_id", "target_id")
    a = seen.join(e, F.col("id") == F.col("source_id"))
    return a.union(seen.join(e, F.col("id") == F.col("target_id")))


def gexf_node(id_col: str, label: str, kind: str):
    """A node element of a GEXF document, its values escaped."""

    def escaped(c: str):
        out = F.coalesce(F.col(c), F.lit(""))
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
            out = F.replace(out, F.lit(a), F.lit(b))
        return out

    return F.concat(F.lit('      <node id="'), escaped(id_col), F.lit('" label="'), escaped(label), F.lit('"><attvalues><attvalue for="0" value="'), escaped(kind), F.lit('"/></attvalues></node>'))


def contained_routes(routes: DataFrame) -> DataFrame:
    """(route, api): pairs of distinct routes (paths that start with ``/``, or none) one of which contains the other.

    A route within another starts at a slash, so its first segment is one of the other's, or, if it
    has one only, what one of them begins with.  Pairs meet by that segment and are then compared.
    """
    parts = lambda c: F.slice(F.split(c, "/"), 2, 1 << 20)
    r = routes.where("route is not null").select("route", parts(F.col("route")).alias("seg"))
    short = r.where("size(seg) <= 1").select(F.col("route").alias("inner"), F.concat(F.lit("p/"), F.coalesce(F.get("seg", F.lit(0)), F.lit(""))).alias("key"))
    long = r.where("size(seg) > 1").select(F.col("route").alias("inner"), F.concat(F.lit("f/"), F.get("seg", F.lit(0))).alias("key"))
    begins = F.flatten(F.transform("seg", lambda x: F.transform(F.sequence(F.lit(0), F.length(x)), lambda i: F.concat(F.lit("p/"), F.substring(x, F.lit(1), i)))))
    keys = F.array_distinct(F.concat(begins, F.transform("seg", lambda x: F.concat(F.lit("f/"), x)), F.array(F.lit("p/"))))
    outer = r.select(F.col("route").alias("outer"), F.explode(keys).alias("key"))
    pairs = short.union(long).join(outer, "key").where(F.contains("outer", F.col("inner"))).select("inner", "outer").distinct()
    return pairs.select(F.col("inner").alias("route"), F.col("outer").alias("api")).union(pairs.where("inner <> outer").select("outer", "inner"))


def substrings(text: Column, n: int) -> Column:
    """All substrings of ``n`` characters."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))


def mutual_stems(rows: DataFrame) -> DataFrame:
    """(a, b), a < b: keys whose texts contain each other's stem.  ``rows``: key, text, stem; the stems' lengths are few."""
    lengths = [r.n for r in rows.select(F.length("stem").alias("n")).where("n > 0").distinct().collect()]
    if not lengths:
        return rows.select(F.col("key").alias("a"), F.col("key").alias("b")).limit(0)
    grams = F.array_distinct(F.concat(*[substrings(F.col("text"), n) for n in lengths]))
    holds = rows.select(F.col("key").alias("holder"), F.explode(grams).alias("stem")).join(rows.select("stem", F.col("key").alias("held")), "stem").where("holder <> held").select("holder", "held")
    ends = [F.least("holder", "held").alias("a"), F.greatest("holder", "held").alias("b")]
    return holds.select(*ends).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("a", "b")
