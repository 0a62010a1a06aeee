"""Many names and patterns in texts against plain loops, in one automaton and in groups of names."""

import random
import re

import pytest

from tessera.operators import patterns as P


def table(spark, seed=0):
    r = random.Random(seed)
    letters = ["a", "b", "c", "é", "_", "A", "."]
    word = lambda k: "".join(r.choice(letters) for _ in range(k))
    names = [(i, word(r.randint(1, 5)), None) for i in range(60)] + [(100, "", None), (101, None, None), (102, "nowhere", None)]
    names += [(200 + i, n, pattern) for i, (n, pattern) in enumerate([("ab", r"ab.c"), ("a", r"^a"), ("c", r"c\b"), ("b", "b(?=c)")])]
    names += [(300, names[0][1], None)]  # two rules of one name
    texts = [(k, word(r.randint(0, 60))) for k in range(80)] + [(500, None), (501, ""), (502, "a" * 20_000 + "nowhere")]
    return names, texts, spark.createDataFrame(names, "rule int, name string, pattern string").repartition(3), spark.createDataFrame(texts, "path long, text string").repartition(3)


@pytest.mark.parametrize("limit", [1 << 19, 200, 1])
def test_matches(spark, monkeypatch, limit):
    monkeypatch.setattr(P, "TEXTS", 30)
    names, texts, rules, own = table(spark)
    want = {(i, k) for i, n, p in names for k, t in texts if n and t is not None and n in t and (p is None or re.search(p, t))}
    got = [(r.rule, r.path) for r in P.matches(rules, own, limit).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500
    assert P.matches(rules.limit(0), own, limit).count() == 0
    assert P.matches(rules, own.limit(0), limit).count() == 0


def test_groups_of_names_are_bounded(spark):
    rules = spark.createDataFrame([(c + str(i),) for c, n in (("x", 500), ("y", 5), ("z", 5)) for i in range(n)], "name string")
    group, n = P._deal(rules, 300)
    sizes = [r["count"] for r in rules.groupBy(group.alias("g")).count().collect()]
    assert n == len(sizes) == 8 and max(sizes) < 150


def test_contained_names(spark):
    names = spark.createDataFrame([("m", "Later", 2), ("m", "First", 1), ("n", "first", 5), ("n", "Absent", 0)], "owner string, name string, place int")
    texts = spark.createDataFrame([("1", "the FIRST and the LATER"), ("2", "later"), ("3", "none"), ("4", None)], "path string, text string")
    for limit in (1 << 19, 1):
        assert sorted(tuple(r) for r in P.contained_names(names, texts, limit).collect()) == [("m", "1", "First"), ("m", "2", "Later"), ("n", "1", "first")]


def test_consumers(spark):
    files = spark.createDataFrame([("a.py", "x = DB_URL"), ("b.ts", "process.env.PORT"), ("c.tsx", "nothing"), ("d.md", "DB_URL"), ("api/e.py", "from app.settings_dev import X"), ("routes/f.ts", "const s = require('./settings_dev')"), ("my_Router.py", "V21")], "path string, text string")
    variables = spark.createDataFrame([("env", "DB_URL", 0), ("many", "V0", 0), *[("many", f"V{i}", i) for i in range(1, 30)], ("empty", "", 0)], "owner string, name string, place int")
    got = sorted(tuple(r) for r in P.environment_consumers(variables, files).collect())
    assert got == [("env", "a.py"), ("env", "b.ts"), ("many", "b.ts"), ("many", "my_Router.py")]  # V2 is in V21; V21 itself is beyond the first 20
    configs = spark.createDataFrame([("cfg", "settings_dev.py"), ("other", "a+b.py")], "owner string, file string")
    assert sorted(tuple(r) for r in P.import_consumers(configs, files).collect()) == [("cfg", "api/e.py"), ("cfg", "routes/f.ts")]
    assert sorted(tuple(r) for r in P.middleware_consumers(configs.where("owner = 'cfg'"), files).collect()) == [("cfg", "api/e.py"), ("cfg", "my_Router.py")]


def test_caller_literals(spark):
    calls = spark.createDataFrame([(f"s{i}", "f", i) for i in range(5)] + [("s9", "g", 0)], "source string, target string, at int")
    literals = spark.createDataFrame([(f"s{i}", "f", 0, "int") for i in range(5)] + [("s0", "f", 1, None), ("s1", "f", 1, "str"), ("s0", "f", 0, "int"), ("s0", "h", 0, "int")], "caller string, callee string, place int, kind string")
    got = {tuple(r) for r in P.caller_literals(calls, literals, most=3).collect()}
    assert got == {("f", 0, "int", 4), ("f", 1, "None", 1), ("f", 1, "str", 1)}
