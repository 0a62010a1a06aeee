"""Graph queries over the foreign keys of the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import deep as D
from ..operators import graph as G
from ..operators.profile import orphan_keys
from .base import query

NODES = """nodes AS (
SELECT 'region::' || r_regionkey AS id, r_name AS name, 'region' AS type, 'geo' AS file_path FROM region UNION ALL
SELECT 'nation::' || n_nationkey, n_name, 'nation', 'geo' FROM nation UNION ALL
SELECT 'customer::' || c_custkey, c_name, 'customer', c_mktsegment FROM customer UNION ALL
SELECT 'supplier::' || s_suppkey, s_name, 'supplier', 'supply' FROM supplier)"""
EDGES = """edges AS (
SELECT 'nation::' || n_nationkey AS source_id, 'region::' || n_regionkey AS target_id, 'REF' AS relationship FROM nation UNION ALL
SELECT 'customer::' || c_custkey, 'nation::' || c_nationkey, 'CALLS' FROM customer UNION ALL
SELECT 'supplier::' || s_suppkey, 'nation::' || s_nationkey, 'CALLS' FROM supplier)"""
BOTH = f"WITH RECURSIVE {NODES}, {EDGES}"


def nodes(t):
    def one(df, kind, key, name, path):
        return df.select(F.concat(F.lit(kind + "::"), key).alias("id"), F.col(name).alias("name"), F.lit(kind).alias("type"), path.alias("file_path"))

    return reduce(lambda a, b: a.union(b), [one(t.region, "region", "r_regionkey", "r_name", F.lit("geo")), one(t.nation, "nation", "n_nationkey", "n_name", F.lit("geo")), one(t.customer, "customer", "c_custkey", "c_name", F.col("c_mktsegment")), one(t.supplier, "supplier", "s_suppkey", "s_name", F.lit("supply"))])


def edges(t):
    def one(df, a, ak, b, bk, r):
        return df.select(F.concat(F.lit(a + "::"), ak).alias("source_id"), F.concat(F.lit(b + "::"), bk).alias("target_id"), F.lit(r).alias("relationship"))

    return reduce(lambda a, b: a.union(b), [one(t.nation, "nation", "n_nationkey", "region", "n_regionkey", "REF"), one(t.customer, "customer", "c_custkey", "nation", "c_nationkey", "CALLS"), one(t.supplier, "supplier", "s_suppkey", "nation", "s_nationkey", "CALLS")])


@query(f"{BOTH} SELECT (SELECT count(*) FROM nodes) AS n_nodes, count(*) FILTER (WHERE type='region') AS n_region, count(*) FILTER (WHERE type='nation') AS n_nation, count(*) FILTER (WHERE type='customer') AS n_customer, count(*) FILTER (WHERE type='supplier') AS n_supplier, count(DISTINCT file_path) AS n_files, (SELECT count(*) FROM edges) AS n_edges FROM nodes")
def graph_stats(t):
    return G.stats(nodes(t), edges(t))


@query(f"{BOTH} SELECT * FROM nodes WHERE id IN (SELECT target_id FROM edges WHERE source_id = 'nation::3' UNION SELECT source_id FROM edges WHERE target_id = 'nation::3')")
def graph_neighbors(t):
    return G.neighbours(nodes(t), edges(t), "nation::3")


@query(f"{BOTH} SELECT * FROM nodes WHERE id IN (SELECT DISTINCT source_id FROM edges WHERE target_id = 'nation::5' AND relationship = 'CALLS' ORDER BY source_id LIMIT 50)")
def graph_callers_callees(t):
    return G.callers(nodes(t), edges(t), "nation::5")


@query(f"{BOTH} SELECT * FROM nodes WHERE name ILIKE '%r%1%' OR id ILIKE '%r%1%' OR file_path ILIKE '%r%1%' ORDER BY id LIMIT 200")
def graph_search(t):
    return G.search(nodes(t), "r%1")


@query(f"{BOTH} SELECT *, CAST(NULL AS INTEGER) AS start_line FROM nodes WHERE type IN ('customer', 'supplier') AND lower(name) LIKE '%00%' ORDER BY file_path, name LIMIT 50")
def graph_typed_search(t):
    return G.typed_search(nodes(t).withColumn("start_line", F.lit(None).cast("int")), "00", ["customer", "supplier"], 50)


@query(f"{BOTH} SELECT count(*) AS n FROM edges WHERE starts_with(source_id, 'customer::1') AND relationship = 'CALLS'")
def graph_prefix_count(t):
    return edges(t).where(F.startswith("source_id", F.lit("customer::1")) & (F.col("relationship") == "CALLS")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{BOTH} SELECT type, count(*) AS n_nodes, count(*) FILTER (WHERE lower(file_path) LIKE 'b%') AS n_b, count(DISTINCT file_path) AS n_paths FROM nodes GROUP BY type")
def graph_diagnostics(t):
    return nodes(t).groupBy("type").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.lower("file_path").startswith("b")).alias("n_b"), F.count_distinct("file_path").alias("n_paths"))


@query(f"{BOTH} SELECT target_id, count(*) AS in_degree FROM edges WHERE contains(target_id, '::') GROUP BY target_id")
def graph_indegree(t):
    return G.in_degree(edges(t))


@query(f"{BOTH} SELECT target_id, count(*) AS in_degree FROM edges GROUP BY target_id ORDER BY in_degree DESC, target_id LIMIT 5")
def graph_degree_topk(t):
    return G.degree_topk(edges(t), 5)


@query(f"{BOTH}, r AS (SELECT id, 0 AS depth FROM nodes WHERE type = 'supplier' UNION SELECT target_id, depth + 1 FROM r JOIN edges ON source_id = id) SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY id")
def graph_reachable(t):
    return G.reachable(edges(t), nodes(t).where("type = 'supplier'").select("id"))


@query(f"{BOTH}, b AS (SELECT source_id AS x, target_id AS y FROM edges UNION SELECT target_id, source_id FROM edges), r AS (SELECT 'nation::7' AS id, 0 AS depth UNION SELECT y, depth + 1 FROM r JOIN b ON x = id WHERE depth < 2) SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY id")
def graph_trace_khop(t):
    return G.trace(edges(t), nodes(t).where("id = 'nation::7'").select("id"), 2)


PARTS = "pn AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_partkey AS k FROM part), pe AS (SELECT CAST(k AS VARCHAR) AS source_id, CAST(k // 3 AS VARCHAR) AS target_id FROM pn WHERE k % 7 <> 0 AND k // 3 > 0)"
#: The same with links back from a grandparent to every fifth part, which close cycles.
CYCLES = PARTS + ", pc AS (SELECT * FROM pe UNION ALL SELECT CAST(k // 9 AS VARCHAR), CAST(k AS VARCHAR) FROM pn WHERE k % 5 = 0 AND k // 9 > 0)"


def part_graph(t):
    """A forest over all part keys: k to k / 3, cut at multiples of 7."""
    n = t.part.select(F.col("p_partkey").cast("string").alias("id"))
    e = t.part.where("p_partkey % 7 <> 0 and p_partkey div 3 > 0").select(F.col("p_partkey").cast("string").alias("source_id"), F.expr("p_partkey div 3").cast("string").alias("target_id"))
    return n, e


def part_cycles(t):
    n, e = part_graph(t)
    back = t.part.where("p_partkey % 5 = 0 and p_partkey div 9 > 0").select(F.expr("p_partkey div 9").cast("string").alias("source_id"), F.col("p_partkey").cast("string").alias("target_id"))
    return n, e.union(back)


@query(f"WITH RECURSIVE {PARTS}, b AS (SELECT source_id AS x, target_id AS y FROM pe UNION SELECT target_id, source_id FROM pe), r AS (SELECT id, id AS low FROM pn UNION SELECT b.y, low FROM r JOIN b ON x = id), m AS (SELECT id, min(low) AS low FROM r GROUP BY id) SELECT id, CAST(dense_rank() OVER (ORDER BY low) - 1 AS INTEGER) AS component FROM m")
def graph_components(t):
    n, e = part_graph(t)
    return G.components(e, n)


@query(f"WITH RECURSIVE {PARTS}, r AS (SELECT id, 0 AS layer FROM pn UNION ALL SELECT source_id, layer + 1 FROM r JOIN pe ON target_id = id) SELECT id, CAST(max(layer) AS INTEGER) AS layer FROM r GROUP BY id")
def graph_topo_layers(t):
    n, e = part_graph(t)
    return G.layers(e, n)


@query(f"WITH RECURSIVE {PARTS}, b AS (SELECT source_id AS x, target_id AS y FROM pe UNION SELECT target_id, source_id FROM pe), r AS (SELECT id, id AS low FROM pn UNION SELECT b.y, low FROM r JOIN b ON x = id), m AS (SELECT id, min(low) AS low FROM r GROUP BY id) SELECT id, CAST(dense_rank() OVER (ORDER BY low) - 1 AS INTEGER) AS component FROM m")
def graph_components_whole(t):
    return graph_components(t)


@query(f"WITH RECURSIVE {PARTS}, r AS (SELECT id, 0 AS layer FROM pn UNION ALL SELECT source_id, layer + 1 FROM r JOIN pe ON target_id = id) SELECT id, CAST(max(layer) AS INTEGER) AS layer FROM r GROUP BY id")
def graph_topo_layers_whole(t):
    """The same layers by contraction, in rounds that grow with the logarithm of the depth."""
    n, e = part_graph(t)
    return D.layers(e, n)


@query("SELECT CAST(i AS INTEGER) AS position, name FROM (VALUES (0,'part'),(1,'region'),(2,'nation'),(3,'customer'),(4,'orders'),(5,'supplier'),(6,'lineitem')) v(i, name)")
def fk_topo_order(t):
    """The order of import by those foreign keys that hold in the tables: a key with an orphan is none."""
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
    keys = [("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey")]
    holds = [(c, p) for c, ck, p, pk in keys if orphan_keys(getattr(t, c), getattr(t, p), [(ck, pk)]).isEmpty()]
    return t.spark.createDataFrame(list(enumerate(G.fk_order(names, holds))), "position int, name string")


@query(f"WITH RECURSIVE {CYCLES}, r AS (SELECT id AS a, id AS b FROM pn UNION SELECT r.a, target_id FROM r JOIN pc ON r.b = source_id) SELECT x.a AS id, min(x.b) AS scc FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a")
def graph_scc(t):
    """Strongly connected components of the part graph with links back, named by their smallest id."""
    n, e = part_cycles(t)
    return G.strong_components(e, n)


@query(f"""WITH RECURSIVE {CYCLES}, r AS (SELECT id AS a, id AS b FROM pn UNION SELECT r.a, target_id FROM r JOIN pc ON r.b = source_id),
s AS (SELECT x.a AS id, min(x.b) AS scc FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
c AS (SELECT DISTINCT a.scc AS source, b.scc AS target FROM pc JOIN s a ON a.id = source_id JOIN s b ON b.id = target_id WHERE a.scc <> b.scc),
l AS (SELECT DISTINCT scc, 0 AS layer FROM s UNION SELECT source, layer + 1 FROM l JOIN c ON target = l.scc),
m AS (SELECT scc, CAST(max(layer) AS INTEGER) AS layer FROM l GROUP BY scc)
SELECT id, s.scc, layer, CAST(dense_rank() OVER (ORDER BY layer, s.scc) - 1 AS BIGINT) AS position FROM s JOIN m ON m.scc = s.scc""")
def graph_condensation(t):
    """The order in which the parts may be taken: those that others point to first, the parts of a cycle together."""
    n, e = part_cycles(t)
    return D.condensation(e, n)


@query(f"WITH RECURSIVE {PARTS}, r AS (SELECT id, 1 AS n FROM pn WHERE CAST(k AS BIGINT) % 2 = 0 UNION SELECT target_id, n + 1 FROM r JOIN pe ON source_id = id WHERE n < 40) SELECT max(n) AS longest FROM r")
def graph_longest_path(t):
    """Nodes on the longest path of the part forest that starts at an even part."""
    n, e = part_graph(t)
    return G.longest_walk(e, t.part.where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("id")), 40)


@query("""
WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 11 <> 0),
n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 17 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 19 <> 0)
SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey,
 CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'removed' ELSE 'modified' END AS change,
 CASE WHEN o.o_orderkey IS NULL OR n.o_orderkey IS NULL THEN '' ELSE concat_ws(',', CASE WHEN o.o_orderstatus IS DISTINCT FROM n.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN o.o_totalprice IS DISTINCT FROM n.o_totalprice THEN 'o_totalprice' END) END AS fields
FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey
WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL OR o.o_orderstatus IS DISTINCT FROM n.o_orderstatus OR o.o_totalprice IS DISTINCT FROM n.o_totalprice""")
def graph_file_delta(t):
    old = t.orders.where("o_orderkey % 11 <> 0").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = t.orders.where("o_orderkey % 19 <> 0").select("o_orderkey", F.expr("case when o_orderkey % 13 = 0 then 'X' else o_orderstatus end").alias("o_orderstatus"), F.expr("case when o_orderkey % 17 = 0 then o_totalprice + 1 else o_totalprice end").alias("o_totalprice"))
    return G.delta(old, new, "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query("SELECT DISTINCT l_orderkey, l_partkey FROM lineitem EXCEPT SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber = 1")
def graph_edge_dedupe(t):
    e = t.lineitem.select("l_orderkey", "l_partkey")
    return G.insert_absent(t.lineitem.where("l_linenumber = 1").select("l_orderkey", "l_partkey"), e, ["l_orderkey", "l_partkey"])


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def graph_upsert_latest(t):
    return G.upsert_latest(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey")


@query(f"{BOTH} SELECT * FROM edges WHERE source_id NOT IN (SELECT id FROM nodes WHERE file_path = 'BUILDING') AND target_id NOT IN (SELECT id FROM nodes WHERE file_path = 'BUILDING')")
def graph_delete_file(t):
    return G.delete_file(nodes(t), edges(t), "BUILDING")[1]


@query(f"{BOTH} SELECT e.* FROM edges e WHERE source_id IN (SELECT id FROM nodes WHERE file_path IN ('geo', 'supply')) AND target_id IN (SELECT id FROM nodes WHERE file_path IN ('geo', 'supply'))")
def graph_drop_external(t):
    return G.drop_external(edges(t), nodes(t).where("file_path in ('geo', 'supply')"))


@query(f"{BOTH} SELECT id, name, CASE type WHEN 'customer' THEN '#1' WHEN 'supplier' THEN '#2' ELSE '#9' END AS color, coalesce(file_path, '') AS file, greatest(1, length(name) % 3) AS val FROM nodes")
def graph_export(t):
    palette = F.create_map(F.lit("customer"), F.lit("#1"), F.lit("supplier"), F.lit("#2"))
    return nodes(t).select("id", "name", F.coalesce(palette[F.col("type")], F.lit("#9")).alias("color"), F.coalesce("file_path", F.lit("")).alias("file"), F.greatest(F.lit(1), F.length("name") % 3).cast("long").alias("val"))


@query("""
WITH c AS (SELECT event_id AS call_id, event_type AS callee, user_id AS f FROM events),
n AS (SELECT event_type AS name, event_id AS id, user_id AS f FROM events)
SELECT call_id, arg_min(id, (CASE WHEN c.f = n.f THEN 0 ELSE 1 END) * 1000000000000 + id) AS node_id FROM c JOIN n ON callee = name AND call_id <> id GROUP BY call_id""")
def resolve_callee(t):
    calls = t.events.select(F.col("event_id").alias("call_id"), F.col("event_type").alias("callee"), F.col("user_id").alias("file_path"), F.col("event_id").alias("caller_id"))
    n = t.events.select(F.col("event_type").alias("name"), F.col("user_id").alias("file_path"), F.col("event_id").alias("id"), F.col("event_id").alias("seq"))
    return G.resolve_calls(calls, n)


@query("SELECT page_id, regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '[?#].*$', '') AS path, regexp_replace(regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '[?#].*$', ''), '[0-9]+', '*', 'g') AS route FROM pages")
def route_normalise(t):
    path = F.regexp_replace(F.regexp_replace("url", r"^https?://[^/]+", ""), r"[?#].*$", "")
    return t.pages.select("page_id", path.alias("path"), F.regexp_replace(path, "[0-9]+", "*").alias("route"))


@query("""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '[?#].*$', ''), '[0-9]+', '*', 'g') AS route FROM pages),
r AS (SELECT DISTINCT route AS api FROM p)
SELECT page_id, api FROM p JOIN r ON route = api OR contains(route, api) OR contains(api, route)""")
def route_theta_join(t):
    """Routes that contain one another.  The distinct routes are paired once; pages join by equality."""
    p = route_normalise(t).select("page_id", "route")
    near = G.contained_routes(p.select("route").distinct())
    return p.join(near, "route").select("page_id", "api")


@query("WITH n AS (SELECT DISTINCT p_name AS n FROM part) SELECT a.n AS a, b.n AS b FROM n a JOIN n b ON a.n < b.n AND contains(a.n, substr(b.n, 1, 3)) AND contains(b.n, substr(a.n, 1, 3))")
def circular_pairs(t):
    """Pairs of names each of which contains the other's stem (its first three letters)."""
    n = t.part.select("p_name").distinct()
    return G.mutual_stems(n.select(F.col("p_name").alias("key"), F.col("p_name").alias("text"), F.substring("p_name", 1, 3).alias("stem")))


CALLEES = f"{BOTH} SELECT * FROM nodes WHERE id IN (SELECT target_id FROM edges WHERE source_id = 'customer::7' AND relationship = 'CALLS')"


@query(CALLEES)
def graph_callees(t):
    return G.callees(nodes(t), edges(t), "customer::7")


@query(f"{BOTH} SELECT * FROM nodes WHERE file_path IS DISTINCT FROM 'BUILDING'")
def graph_delete_file_nodes(t):
    return G.delete_file(nodes(t), edges(t), "BUILDING")[0]


@query(f"{BOTH} SELECT * FROM nodes WHERE id = 'supplier::9'")
def graph_point_lookup(t):
    return nodes(t).where("id = 'supplier::9'")


@query(f"{BOTH} SELECT * FROM nodes WHERE file_path = 'supply'")
def graph_nodes_by_file(t):
    return nodes(t).where("file_path = 'supply'")


@query(f"{BOTH}, l AS (SELECT source_id AS source, target_id AS target, relationship AS type FROM edges) SELECT to_json(struct_pack(source := source, target := target, type := type)) AS link FROM l")
def graph_export_links(t):
    return edges(t).select(F.to_json(F.struct(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("relationship").alias("type"))).alias("link"))


def _escaped(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = f"replace({c}, '{a.replace(chr(39), chr(39) * 2)}', '{b}')"
    return c


@query(f"""SELECT '      <node id="' || {_escaped("p_partkey::VARCHAR")} || '" label="' || {_escaped("p_name || ' & <' || p_type || '>'")} || '"><attvalues><attvalue for="0" value="' || {_escaped("p_brand")} || '"/></attvalues></node>' AS line FROM part""")
def graph_gexf(t):
    n = t.part.select(F.col("p_partkey").cast("string").alias("id"), F.concat("p_name", F.lit(" & <"), "p_type", F.lit(">")).alias("name"), F.col("p_brand").alias("type"))
    return n.select(G.gexf_node("id", "name", "type").alias("line"))


@query(f"""{BOTH}, b AS (SELECT source_id AS x, target_id AS y FROM edges UNION SELECT target_id, source_id FROM edges), r AS (SELECT 'nation::7' AS id, 0 AS depth UNION SELECT y, depth + 1 FROM r JOIN b ON x = id WHERE depth < 2),
v AS (SELECT id, min(depth) AS depth FROM r GROUP BY id)
SELECT v.id, CAST(v.depth AS INTEGER) AS depth, source_id, target_id FROM v JOIN edges ON v.id = source_id UNION ALL SELECT v.id, CAST(v.depth AS INTEGER), source_id, target_id FROM v JOIN edges ON v.id = target_id""")
def graph_trace_edges(t):
    return G.trace_edges(edges(t), nodes(t).where("id = 'nation::7'").select("id"), 2)


@query(f"WITH RECURSIVE {PARTS}, b AS (SELECT source_id AS x, target_id AS y FROM pe UNION SELECT target_id, source_id FROM pe), r AS (SELECT id, id AS low FROM pn UNION SELECT b.y, low FROM r JOIN b ON x = id), m AS (SELECT id, min(low) AS low FROM r GROUP BY id), e AS (SELECT id FROM pn WHERE k % 10 = 0 UNION SELECT target_id FROM e JOIN pe ON source_id = e.id) SELECT m.id, e.id IS NOT NULL AS reachable, CAST(dense_rank() OVER (ORDER BY low) - 1 AS INTEGER) AS cluster FROM m LEFT JOIN e ON m.id = e.id")
def graph_entry_map(t):
    """Of each node: whether an entry reaches it, and its cluster."""
    n, e = part_graph(t)
    entries = t.part.where("p_partkey % 10 = 0").select(F.col("p_partkey").cast("string").alias("id"))
    reached = G.reachable(e, entries).select("id", F.lit(True).alias("r"))
    return G.components(e, n).join(reached, "id", "left").select("id", F.coalesce("r", F.lit(False)).alias("reachable"), F.col("component").alias("cluster"))
