"""Deep graphs against plain searches."""

import random

import pytest

from tessera.operators import deep, graph


def frames(spark, nodes, edges):
    return spark.createDataFrame([(e[0], e[1]) for e in edges], "source_id string, target_id string"), spark.createDataFrame([(n,) for n in nodes], "id string")


def plain_layers(nodes, edges):
    need, state = {n: set() for n in nodes}, {}
    for a, b in edges:
        if a != b and a in need:
            need[a].add(b)
    done = {}
    while True:
        ready = [n for n in nodes if n not in done and all(x in done for x in need[n])]
        if not ready:
            return {n: done.get(n) for n in nodes} | state
        for n in ready:
            done[n] = 1 + max((done[x] for x in need[n]), default=-1)


def test_layers_of_small_graphs(spark):
    r = random.Random(2)
    nodes, edges = [], []
    for g in range(25):  # many small graphs side by side, some with cycles, loops and unknown needs
        own = [f"{g}_{i}" for i in range(r.randint(1, 12))]
        nodes += own
        for _ in range(r.randint(0, 16)):
            a, b = r.choice(own), r.choice(own)
            if g % 3 or a > b:
                edges.append((a, b))
        if g % 5 == 0:
            edges.append((own[0], f"{g}_none"))
    e, n = frames(spark, nodes, edges)
    want = plain_layers(nodes, edges)
    assert {x.id: x.layer for x in deep.layers(e, n).collect()} == want and len({v for v in want.values()}) > 4
    back = plain_layers(nodes, [(b, a) for a, b in edges if b in nodes])
    known = e.join(n.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    assert {x.id: x.layer for x in deep.layers(known, n, depends=False).collect()} == back


def test_a_chain_of_ten_thousand(spark):
    n = 10_000
    edges = [(f"n{i + 1}", f"n{i}") for i in range(n - 1)]
    # diamonds on top of the chain
    edges += [x for i in range(0, 40) for x in ((f"d{i + 1}", f"a{i}"), (f"d{i + 1}", f"b{i}"), (f"a{i}", f"d{i}"), (f"b{i}", f"d{i}"))] + [("d0", f"n{n - 1}")]
    nodes = [f"n{i}" for i in range(n)] + [f"{k}{i}" for k in "dab" for i in range(40)] + ["d40"]
    rounds = []
    e, ids = frames(spark, nodes, edges)
    out = {r.id: (r.scc, r.layer, r.position) for r in deep.condensation(e, ids, rounds).collect()}
    assert len(rounds) <= 25 and len([x for x in rounds if x == "jump"]) <= 22
    assert all(out[f"n{i}"] == (f"n{i}", i, i) for i in range(n)) and out["d40"][1] == n + 80
    rounds = []
    got = {r.id: r.depth for r in deep.distances(e, ids.where("id = 'd40'"), rounds).collect()}
    assert got["n0"] == n + 80 and got["d0"] == 80 and len(got) == len(nodes)


CASES = [
    ([], []),
    (["A"], []),
    (["A"], [("A", "A")]),
    (["A", "B", "C"], [("A", "B"), ("B", "C")]),
    (["A", "B", "C", "D"], [("A", "B"), ("C", "D")]),
    (["A", "B", "C", "D"], [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D")]),
    (["A", "B"], [("A", "B"), ("B", "A")]),
    (["A", "B", "C", "D"], [("A", "B"), ("B", "C"), ("C", "A"), ("C", "D")]),
    (["A", "B", "C", "D", "E"], [("A", "B"), ("B", "A"), ("B", "C"), ("C", "D"), ("D", "C"), ("E", "A")]),
]


def test_condensation(spark):
    # the graphs side by side, as parts of one
    nodes = [f"{g}{n}" for g, (own, _) in enumerate(CASES) for n in own]
    edges = [(f"{g}{a}", f"{g}{b}") for g, (_, own) in enumerate(CASES) for a, b in own]
    e, n = frames(spark, nodes, edges)
    rows = deep.condensation(e, n).collect()
    place = {r.id: r.position for r in rows}
    groups = [sorted(r.id for r in rows if r.position == p) for p in sorted(set(place.values()))]
    assert sorted(groups) == sorted(graph.topological_groups(nodes, edges)) and len(rows) == len(nodes)
    assert all(place[b] <= place[a] for a, b in edges)
    assert sorted(place.values()) == sorted(place[x] for g in groups for x in g) and max(place.values()) == len(groups) - 1
    with pytest.raises(ValueError, match="unknown node"):
        deep.condensation(e.union(spark.createDataFrame([("A", "nowhere")], e.schema)), n)


def test_distances(spark):
    r = random.Random(7)
    nodes = [f"n{i}" for i in range(60)]
    edges = [(r.choice(nodes), r.choice(nodes)) for _ in range(75)]
    e, ids = frames(spark, nodes, edges)
    for entries in (["n0", "n5"], ["n9"], ["absent"]):
        depth, front = {x: 0 for x in entries}, list(entries)
        while front:
            front = sorted({b for a, b in edges if a in front and b not in depth})
            depth |= {x: max(depth.values()) + 1 for x in front}
        got = {x.id: x.depth for x in deep.distances(e, spark.createDataFrame([(x,) for x in entries], "id string")).collect()}
        assert got == depth


def test_longest_simple_path(spark):
    r = random.Random(11)
    for size, n_edges in ((12, 26),):
        nodes = [f"n{i}" for i in range(size)]
        edges = [(r.choice(nodes), r.choice(nodes)) for _ in range(n_edges)]
        e, ids = frames(spark, nodes, edges)
        start = ids.where("id in ('n0', 'n3')")
        want = graph.longest_path([(a, b) for a, b in edges if a != b], ["n0", "n3"])
        got = deep.longest_simple_path(e, ids, start).first()
        assert tuple(got) == (want, True)
    # whole components, by all three ways of searching
    edges = [(f"n{i}", f"n{j}") for i in range(13) for j in range(13) if i != j and r.random() < 0.25]
    names = sorted({x for e in edges for x in e})
    a, b = deep._Search(edges, 40, 10**9), deep._Search(edges, 40, 10**9)
    for u in range(len(names)):
        assert a._subsets(u) == b._walks(u)
    assert graph.longest_path(edges, ["n0"]) == max(a._subsets(names.index("n0")).values())
    e, ids = frames(spark, ["a", "b", "c"], [("a", "b"), ("b", "a"), ("b", "c")])
    assert tuple(deep.longest_simple_path(e, ids, ids.where("id = 'a'"), searched=1).first()) == (3, False)
    short = deep._Search(edges, 40, 5)
    short.pairs()
    assert short._walks(0) and not short.exact
