"""Literal cases of the operators that have no table query, or whose edge cases matter."""

import itertools
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import redact, transform
from tessera.operators import graph, matching, provenance
from tessera.plans import datalog
from tessera.sources import ddl, pgoutput
from tessera.streaming import cdc as stream_cdc


def run(spark, program, edb, target):
    tables = {k: spark.createDataFrame(rows, schema) for k, (rows, schema) in edb.items()}
    out = datalog.evaluate(spark, program, tables, target)
    return {tuple(r) for r in out.collect()} if out is not None else set()


ONE = ([(1,), (2,), (3,)], "a int")


@pytest.mark.parametrize(
    ("program", "edb", "want"),
    [
        ("target(X,Y) :- legacy(X,Z), Y == Z * 2.", {"legacy": ([(1, 10), (2, 20)], "a int, b int")}, {(1, 20), (2, 40)}),
        ("cand(X) :- legacy(X). target(X) :- cand(X), not exclude(X).", {"legacy": ONE, "exclude": ([(2,)], "a int")}, {(1,), (3,)}),
        ("target(N) :- legacy(X), N = count(X).", {"legacy": ONE}, {(3,)}),
        ("target(S) :- legacy(K,V), S = sum(V).", {"legacy": ([("a", 10), ("b", 20), ("c", 30)], "a string, b int")}, {(60,)}),
        ("target(M) :- legacy(X), M = min(X).", {"legacy": ([(5,), (3,), (9,), (1,)], "a int")}, {(1,)}),
        ("target(N) :- legacy(X), N = count(X).", {"legacy": ([], "a int")}, {(0,)}),
        ("path(X,Y) :- edge(X,Y). target(X,Z) :- path(X,Z). path(X,Z) :- path(X,Y), edge(Y,Z).", {"edge": ([(1, 2), (2, 3), (3, 1)], "a int, b int")}, set(itertools.product((1, 2, 3), repeat=2))),
    ],
)
def test_datalog(spark, program, edb, want):
    assert run(spark, program, edb, "target") == want


def test_datalog_errors(spark):
    with pytest.raises(datalog.StratificationError):
        datalog.stratify(datalog.parse("a(X) :- n(X), not b(X). b(X) :- n(X), not a(X)."))
    for bad in ("target(X) :- legacy(X", "target(Y) :- legacy(X).", "target(X) :- @."):
        with pytest.raises(datalog.DatalogSyntaxError):
            datalog.parse(bad)
    with pytest.raises(datalog.DatalogTimeout):
        datalog.evaluate(spark, "t(X) :- a(X).", {"a": spark.createDataFrame(*ONE)}, "t", timeout_ms=0)


def test_topological_groups_and_paths():
    assert graph.topological_groups(list("ABC"), [("A", "B"), ("B", "C")]) == [["C"], ["B"], ["A"]]
    assert graph.topological_groups(list("abc"), [("a", "b"), ("b", "a"), ("b", "c")]) == [["c"], ["a", "b"]]
    with pytest.raises(ValueError, match="unknown"):
        graph.topological_groups(["a"], [("a", "x")])
    with pytest.raises(ValueError, match="cycle"):
        graph.fk_order(["a", "b"], [("a", "b"), ("b", "a")])
    assert graph.fk_order(["b", "a"], [("a", "b"), ("a", "a")]) == ["b", "a"]
    assert graph.longest_path([("a", "b"), ("b", "a"), ("b", "c")], ["a"]) == 3


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for n, m in ((4, 4), (3, 5), (5, 3)):
        s = rng.random((n, m))
        got = matching.assign(s)
        total = sum(s[i, j] for i, j in enumerate(got) if j is not None)
        if n <= m:
            best = max(sum(s[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        else:
            best = max(sum(s[p[j], j] for j in range(m)) for p in itertools.permutations(range(n), m))
        assert abs(total - best) < 1e-9


def test_transformers_compile_and_refuse(spark):
    df = spark.createDataFrame([(" Ab ",), (None,), ("xyz",)], "v string")
    src = "def transform(v):\n    if v is None:\n        return 'none'\n    s = v.strip()\n    return s.lower() + '!'"
    assert [r[0] for r in df.select(transform.compile_transformer(src, F.col("v"))).collect()] == ["ab!", "none", "xyz!"]
    for bad in ("import os", "def transform(v):\n    return open(v)", "def transform(v):\n    while True:\n        pass", "def transform(v):\n    return v.__class__"):
        with pytest.raises(transform.SecurityViolation):
            transform.compile_transformer(bad, F.col("v"))


def test_python_and_column_arithmetic_agree(spark):
    pairs = [(a, b) for a in (-7, 7, 0) for b in (-3, 3, 2)]
    df = spark.createDataFrame(pairs, "a long, b long")
    for op, f in (("%", lambda a, b: a % b), ("//", lambda a, b: a // b)):
        for b in (-3, 3, 2):
            c = transform.compile_transformer(f"def transform(v):\n    return v {op} {b}", F.col("a"))
            assert {(r.a, int(r.x)) for r in df.select("a", c.alias("x")).collect()} == {(a, f(a, b)) for a, _ in pairs}


def test_redaction(spark):
    df = spark.createDataFrame([("a alice@bank.com 4111 1111 1111 1111, 1.2.3.4",)], "t string")
    assert df.select(redact.redact(F.col("t"))).first()[0] == "a <email> <pan>, <ipv4>"


def test_ddl_dialects():
    pg = ddl.parse_ddl("CREATE TABLE pet (id serial PRIMARY KEY, owner_id int NOT NULL REFERENCES owner(id) ON DELETE CASCADE, born timestamptz, price numeric(10,2) DEFAULT 0, CONSTRAINT u PRIMARY KEY (id)); CREATE TABLE owner (id int, PRIMARY KEY (id)); CREATE UNIQUE INDEX ix ON pet USING btree (owner_id); COMMENT ON COLUMN pet.born IS 'it''s';", "postgres")
    pet = pg.tables["pet"]
    assert [c.tag for c in pet.columns] == ["INTEGER", "INTEGER", "TIMESTAMP_TZ", "DECIMAL"]
    assert pet.primary_key == ["id"] and not pet.columns[0].effective_nullable and pet.columns[2].comment == "it's"
    assert pet.foreign_keys[0].table == "owner" and pet.foreign_keys[0].on_delete.lower() == "cascade" and pet.indexes == [("ix", ["owner_id"], True)]
    assert pet.schema()["price"].dataType.simpleString() == "decimal(10,2)"
    ora = ddl.parse_ddl("CREATE TABLE v (id NUMBER(10) PRIMARY KEY, d DATE NOT NULL, a NUMBER(38,10), c CLOB); CREATE SEQUENCE s;", "oracle")
    assert [c.tag for c in ora.tables["v"].columns] == ["DECIMAL", "TIMESTAMP", "DECIMAL", "STRING"] and ora.warnings
    my = ddl.parse_ddl("CREATE TABLE `m` (`id` bigint unsigned NOT NULL AUTO_INCREMENT, `e` enum('a','b'), KEY `k` (`e`), PRIMARY KEY (`id`))", "mysql")
    assert my.tables["m"].primary_key == ["id"] and [c.tag for c in my.tables["m"].columns] == ["INTEGER", "STRING"]
    mo = ddl.parse_ddl('{"collections": {"u": {"$jsonSchema": {"required": ["_id"], "properties": {"_id": {"bsonType": "objectId"}, "a": {"bsonType": "object", "properties": {"b": {"bsonType": ["null", "int"]}}}}}}}}', "mongodb")
    assert [(c.name, c.tag) for c in mo.tables["u"].columns] == [("_id", "STRING"), ("a", "JSON"), ("a.b", "INTEGER")]
    assert all(isinstance(ddl.parse_ddl(t, d), ddl.ParseFailure) for t, d in (("", "postgres"), ("x", "sqlite"), ("select 1", "postgres"), ("{", "mongodb")))


def test_pgoutput():
    state = pgoutput.State()
    pgoutput.decode(b"R" + struct.pack(">I", 7) + b"public\0t\0d" + struct.pack(">H", 2) + b"\1id\0" + struct.pack(">Ii", 23, -1) + b"\0v\0" + struct.pack(">Ii", 25, -1), state)
    pgoutput.decode(b"B" + struct.pack(">QqI", (1 << 32) + 255, 0, 9), state)
    row = struct.pack(">H", 2) + b"t" + struct.pack(">I", 2) + b"42" + b"n"
    (e,) = pgoutput.decode(b"I" + struct.pack(">I", 7) + b"N" + row, state)
    assert (e["op"], e["after"], e["lsn"], e["seq"], e["key_columns"]) == ("I", {"id": 42, "v": None}, "1/FF", 0, ["id"])


def test_merkle_odd_and_chain(spark):
    import hashlib

    df = spark.createDataFrame([(i, f"c{i}") for i in range(3)], "i int, c string")
    h = [hashlib.sha256(f"c{i}".encode()).digest() for i in range(3)]
    pair = lambda a, b: hashlib.sha256(a + b).digest()
    assert provenance.merkle_root(df, "i", "c").first()[0] == pair(pair(h[0], h[1]), pair(h[2], h[2])).hex()
    assert provenance.merkle_root(df.limit(0), "i", "c").first()[0] == hashlib.sha256(b"empty_scan").hexdigest()


def test_stream_replay_is_idempotent(spark, tmp_path):
    schema = "tab string, lsn long, seq long, payload string, arrival long"
    for k in range(2):  # every event is delivered twice, its rows in any order
        rows = [("t", i, 0, f"p{i}", 20 * k + i) for i in range(20)]
        spark.createDataFrame(rows[::-1], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_cdc.fresh_events(stream).writeStream.format("memory").queryName("fresh").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.lsn for r in spark.table("fresh").collect()) == list(range(20))


def test_queries_over_all_parts(spark, tmp_path):
    from tessera import catalog

    keys = range(1, 421)
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    up = {k: k // 3 for k in keys if k % 7 and k // 3}
    root = {}
    layer = dict.fromkeys(keys, 0)
    for k in keys:
        root[k] = root[up[k]] if k in up else k
        layer[k] = layer[up[k]] + 1 if k in up else 0
    low = {r: min(str(k) for k in keys if root[k] == r) for r in set(root.values())}
    number = {x: i for i, x in enumerate(sorted(low.values()))}
    run = lambda name: catalog.QUERIES[name](spark, str(tmp_path)).collect()
    assert {r.id: r.component for r in run("graph_components_whole")} == {str(k): number[low[root[k]]] for k in keys}
    assert {r.id: r.layer for r in run("graph_topo_layers_whole")} == {str(k): layer[k] for k in keys}
    assert {(r.a, r.b) for r in run("datalog_recursive_whole")} == {(k, k >> i) for k in keys if k >= 2 for i in range(1, k.bit_length())}
