"""Faults once found, sources and sinks, streams, and operators without SQL, against plain versions."""

import hashlib
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import mapping, redact, transform
from tessera.operators import cdc, files, graph, ordered, profile, provenance
from tessera.sources import migration, observe, pgoutput
from tessera.streaming import bus
from tessera.streaming import cdc as stream_cdc


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_redaction_of_long_cards_and_letters(spark):
    texts = {"card 1234567890123456789 end": "card <pan>end", "a 1234567890123 b": "a <pan>b", "x é@b.co y": "x <email> y", "1.2.3.4 and 123-45-6789": "<ipv4> and <ssn>", "no": "no"}
    df = spark.createDataFrame(list(texts.items()), "t string, want string")
    assert df.where(redact.redact(F.col("t")) != F.col("want")).count() == 0


def test_layers_of_cycles_and_nothing(spark):
    cycle = spark.createDataFrame([("a", "b"), ("b", "a")], "source_id string, target_id string")
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    assert {r.layer for r in graph.layers(cycle, nodes).collect()} == {None}
    assert graph.layers(cycle.limit(0), nodes.limit(0)).count() == 0


def test_strong_components(spark):
    r = random.Random(2)
    ids = [f"n{i}" for i in range(40)]
    links = {(r.choice(ids), r.choice(ids)) for _ in range(60)}
    reach = {a: {a} for a in ids}
    for _ in ids:
        for a, b in links:
            for s in ids:
                if a in reach[s]:
                    reach[s].add(b)
    want = {a: min(b for b in reach[a] if a in reach[b]) for a in ids}
    e = spark.createDataFrame(list(links), "source_id string, target_id string")
    n = spark.createDataFrame([(i,) for i in ids], "id string")
    assert {x.id: x.scc for x in graph.strong_components(e, n).collect()} == want
    assert graph.strong_components(e.limit(0), n.limit(0)).count() == 0


def test_contained_routes(spark):
    routes = ["", "/", "/a", "/a/*", "/b/a/*/c", "/ab", "/b/ab", "/x/y"]
    want = {(a, b) for a in routes for b in routes if a in b or b in a}
    df = spark.createDataFrame([(x,) for x in routes], "route string")
    assert {tuple(r) for r in graph.contained_routes(df).collect()} == want


def test_running_values_across_ranges(spark):
    r = random.Random(5)
    rows = [(r.choice("aab"), i, r.randrange(50)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(7)
    seen, want = {}, {}
    for k, i, v in rows:
        own = seen.setdefault(k, [])
        want[i] = (len(own), max(own, default=None), own[-1] if own else None)
        own.append(v)
    at = ordered.positions(df, ["k"], ["i"], "p")
    got = {x.i: x.p for x in at.collect()}
    top = {x.i: x.m for x in ordered.greatest_before(df, ["k"], ["i"], F.col("v"), "m").collect()}
    last = {x.i: x.l for x in ordered.previous(df, ["k"], ["i"], "v", "l").collect()}
    assert {i: (got[i], top[i], last[i]) for i in got} == want


def test_merkle_blocks_and_proofs(spark, monkeypatch):
    monkeypatch.setattr(provenance, "BLOCK", 4)
    pair = lambda a, b: hashlib.sha256(a + b).digest()
    for n in (1, 4, 5, 11, 17, 70):
        level = [hashlib.sha256(f"c{i}".encode()).digest() for i in range(n)]
        leaf = level[n // 2].hex()
        while len(level) > 1:
            level = [pair(level[k], level[min(k + 1, len(level) - 1)]) for k in range(0, len(level), 2)]
        df = spark.createDataFrame([(i, f"c{i}") for i in range(n)], "i int, c string")
        root = provenance.merkle_root(df, "i", "c").first().root
        assert root == level[0].hex()
        if n in (5, 11):
            proof = provenance.inclusion_proof(df, "i", "c", n // 2).orderBy("level").collect()
            claims = [(leaf, root, [(p.side, p.sibling) for p in proof]), (leaf, root[::-1], [(p.side, p.sibling) for p in proof]), ("00" * 32, root, [])]
            c = spark.createDataFrame(claims, "leaf string, root string, proof array<struct<side: string, sibling: string>>")
            assert [r.ok for r in provenance.verify_inclusion(c).collect()] == [True, False, False]
    assert provenance.inclusion_proof(df, "i", "c", 99).count() == 0


def test_broken_links(spark):
    a, b = "0" * 64, "1" * 64
    rows = [("g", 1, "x", a), ("g", 2, a, b), ("g", 3, "y", "z"), ("h", 1, b, a)]
    df = spark.createDataFrame(rows, "g string, i int, predecessor_hash string, chain_hash string")
    assert [r.i for r in provenance.broken_links(df, "g", "i").collect()] == [3]


def test_pgoutput_binary_values_and_cut_messages():
    state = pgoutput.State()
    pgoutput.decode(b"R" + struct.pack(">I", 7) + b"public\0t\0d" + struct.pack(">H", 2) + b"\1id\0" + struct.pack(">Ii", 23, -1) + b"\0v\0" + struct.pack(">Ii", 25, -1), state)
    row = struct.pack(">H", 2) + b"b" + struct.pack(">I", 2) + b"\x01\x02" + b"t" + struct.pack(">I", 1) + b"x"
    whole = b"I" + struct.pack(">I", 7) + b"N" + row
    assert pgoutput.decode(whole, state)[0]["after"] == {"id": "0102", "v": "x"}
    for bad in (whole[:-1], whole[:4], b"I" + struct.pack(">I", 8) + b"N" + row, b"R" + struct.pack(">I", 7) + b"public"):
        with pytest.raises(pgoutput.ParseError):
            pgoutput.decode(bad, state)


def test_encoding_samples(spark):
    df = spark.createDataFrame([(f"Ã{i}",) for i in range(9)] + [("fine",)], "v string")
    got = {r.kind: (r.n_values, r.samples) for r in profile.encoding_probe(df, "v", None, 3).collect()}
    assert got == {"mojibake": (9, ["Ã0", "Ã1", "Ã2"]), "clean": (1, ["fine"])}


def test_sql_tier_is_checked(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "v int, legacy string")
    got = [r.x for r in df.select(transform.sql_case("CASE WHEN legacy_col = 1 THEN 'is legacy_col' ELSE 'no' END", "v").alias("x")).collect()]
    assert got == ["is legacy_col", "no"]
    for bad in ("legacy", "(select 1)", "legacy_col -- x", "java_method('x')", "legacy_col; drop", "reflect(legacy_col)"):
        with pytest.raises(transform.SecurityViolation):
            transform.sql_case(bad, "v")


def test_jdbc_scan_with_ranges(spark):
    url, driver = "jdbc:derby:memory:legacy;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = spark.createDataFrame([(i, f"n{i}", i % 2 == 0) for i in range(50)], "id int, name string, even boolean")
    rows.write.format("jdbc").options(url=url, driver=driver, dbtable="pets").mode("overwrite").save()
    got = migration.jdbc_scan(spark, url, "pets", ["id", "name"], key="id", partitions=4, options={"driver": driver})
    assert got.rdd.getNumPartitions() == 4 and sorted(map(tuple, got.collect())) == [(i, f"n{i}") for i in range(50)]
    with pytest.raises(migration.ReadOnlyError):
        migration.jdbc_scan(spark, url, "pets", ["id"], options={"driver": driver}, dialect="sqlite")


def test_read_only_and_retry():
    for dialect, answer in (("postgres", "on"), ("mysql", 1), ("oracle", "READ ONLY WITH APPLY")):
        migration.check_read_only(dialect, lambda q, a=answer: a)
    for dialect, answer in (("postgres", "off"), ("mysql", 0), ("oracle", "READ WRITE"), ("mongodb", True)):
        with pytest.raises(migration.ReadOnlyError):
            migration.check_read_only(dialect, lambda q, a=answer: a)
    waits, left = [], [ValueError(), ValueError()]

    def shaky():
        if left:
            raise left.pop()
        return 7

    assert migration.with_retry(shaky, sleep=waits.append) == 7 and waits == [1, 2]
    with pytest.raises(KeyError):
        migration.with_retry(lambda: {}["x"], sleep=waits.append)


def test_snapshots_and_replacement(spark, tmp_path):
    a = spark.createDataFrame([("x", "y"), ("x", "z")], "s string, t string")
    b = spark.createDataFrame([("x", "y"), ("q", "r"), ("q", "r")], "s string, t string")
    assert migration.imported(a, b).count() == 5 and migration.imported(a, b, ["s", "t"]).count() == 3
    migration.replaced(a, str(tmp_path / "t"))
    migration.replaced(b.limit(0), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 0
    with pytest.raises(ValueError, match="columns differ"):
        migration.union_all([a, a.select("t", "s")])
    tries = spark.createDataFrame([("n", 2, 1), ("n", 1, 5), ("n", 1, 3)], "node string, attempt_number int, id int")
    assert [r.id for r in migration.attempts(tries, "node").collect()] == [3, 5, 1]


def test_documents_scan(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"_id": 1, "a": "x", "b": 2}\nnot json\n{"_id": "q"}\n')
    assert sorted(map(tuple, migration.documents_scan(spark, str(tmp_path), ["a", "b"]).collect())) == [("1", "x", "2"), ("q", None, None)]


def test_walk_and_dotenv(spark, tmp_path):
    (tmp_path / "src").mkdir()
    for name, n in (("src/a.ts", 3), ("src/b.d.ts", 3), ("skip.ts", 3), ("src/big.ts", 99)):
        (tmp_path / name).write_text("x" * n)
    got = {r.path: r.skipped for r in files.walk(spark, str(tmp_path), "*.ts", ["skip"], 50).collect()}
    assert got == {"src/a.ts": None, "src/b.d.ts": "declaration", "skip.ts": "ignored", "src/big.ts": "too_large"}
    lines = F.array(*map(F.lit, ["A=1", "# c", "b=2", 'KEY_2="q q"']))
    assert [tuple(x) for x in one(spark, files.dotenv(lines))] == [("A", "1"), ("KEY_2", "q q")]
    assert tuple(one(spark, files.safe_extension(F.lit(b".p\xff")))) == (".p�", "2e70ff")


def test_hashed_vectors_and_scores(spark):
    def plain(text):
        raw = b""
        while len(raw) < 384 * 4:
            raw += hashlib.sha256(text.encode() + (len(raw) // 32).to_bytes(4, "big")).digest()
        x = np.frombuffer(raw[: 384 * 4], np.uint32).astype(np.float32) / np.float32(2**32 - 1) - np.float32(0.5)
        return x / np.linalg.norm(x)

    df = spark.createDataFrame([("name",), ("é",), (None,)], "t string").select("t", mapping.embed(F.col("t")).alias("v"))
    for r in df.collect():
        assert r.v is None if r.t is None else np.allclose(r.v, plain(r.t), atol=1e-7)
    s = spark.createDataFrame([(1, 2.0), (3, 0.5)], "a int, b double")
    assert sorted(r.score for r in mapping.scored(s, lambda f: f["a"] * f["b"]).collect()) == [1.5, 2.0]


def test_observation_collectors(spark):
    lines = ['{"payload": {"op": "u", "source": {"db": "shop", "table": "t"}}}', '{"op": "c", "source": {"db": "d", "table": "x"}}', '{"op": "r"}', "", "{bad"]
    raw = observe.json_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert {(r.kind, r.service) for r in observe.debezium(raw).collect()} == {("update", "db://shop.t"), ("insert", "db://d.x")}
    events = ['{"pod": {"name": "p", "labels": {"observe": "true"}}, "dns": {}, "sql": {}}', '{"process": {"pod": {"labels": {"observe": "true"}}}, "process_kprobe": {}}', '{"pod": {"labels": {}}, "dns": {}}']
    raw = observe.json_lines(spark.createDataFrame([(x,) for x in events], "value string"))
    assert sorted(r.kind for r in observe.tetragon(raw).collect()) == ["dns_lookup", "syscall"]
    records = ['{"smf_type": "30.4", "region": "r", "system_id": "s"}', '{"smf_type": "30.5"}', '{"transaction_id": "T"}', '{"dataset": "D"}']
    raw = observe.json_lines(spark.createDataFrame([(x,) for x in records], "value string"))
    assert sorted((r.kind, r.service) for r in observe.mainframe(raw).collect()) == [("cics_transaction", ""), ("smf_step_end", "r/s"), ("vsam_access", "")]
    assert one(spark, observe.smf_header(F.lit(bytes([0, 0, 0, 0, 30, 4, 0, 0])))) == "30.4"
    assert one(spark, observe.vsam_payload(F.lit(bytes(24) + b"data"))) == b"data"
    log = ["COMMIT:h1|An|2024-01-01|s", "3\t1\ta.py", "-\t-\tb.bin", "COMMIT:h2|Bo|2024-01-02|t", "5\t0\tc/d.ts"]
    got = observe.git_numstat(spark.createDataFrame(list(enumerate(log)), "line_no int, value string")).collect()
    assert {(r.commit, r.author, r.added, r.deleted, r.path) for r in got} == {("h1", "An", 3, 1, "a.py"), ("h2", "Bo", 5, 0, "c/d.ts")}


def test_unquote_and_extensions(spark):
    assert [one(spark, redact.unquote(F.lit(x))) for x in ("'a b' ", '"x"', " y ", '"')] == ["a b", "x", "y", '"']
    assert [one(spark, files.extension(F.lit(x))) for x in (" .PY", "Rs", "?", "")] == [".py", ".rs", "?", "?"]


def run_stream(query):
    query.awaitTermination(120)


def test_apply_batches_keeps_deletions(spark, tmp_path):
    schema = "k long, v string, op string, lsn long"
    for rows in ([(1, "a", "I", 1), (2, "b", "I", 2)], [(1, "a2", "U", 3), (2, "b", "D", 5)], [(2, "old", "U", 4), (3, "c", "I", 6)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run_stream(stream_cdc.apply_batches(stream, str(tmp_path / "out"), "k", "op", ["lsn"], str(tmp_path / "ck")))
    got = stream_cdc.current(spark, str(tmp_path / "out"), "k", "op", ["lsn"])
    assert sorted((r.k, r.v) for r in got.collect()) == [(1, "a2"), (3, "c")]
    assert len(list((tmp_path / "out" / "manifests").glob("*.json"))) == 2


def test_bus_replay_and_deltas(spark, tmp_path):
    schema = "job string, seq long, v string"
    spark.createDataFrame([("j", 1, "a"), ("j", 2, "b"), ("k", 3, "c")], schema).coalesce(1).write.parquet(str(tmp_path / "h"))
    assert sorted(r.seq for r in bus.replay(spark, str(tmp_path / "h"), "seq", 1).collect()) == [2, 3]
    assert bus.replay(spark, str(tmp_path / "h"), "seq", 99).count() == 3
    seen = []
    q = bus.debounced_deltas(bus.job_events(spark, str(tmp_path / "h"), schema), "job", "seq", lambda b, e: seen.extend(map(tuple, b.collect())), str(tmp_path / "ck"))
    run_stream(q)
    assert sorted((r[0], r[2]) for r in seen) == [("j", "b"), ("k", "c")]
    assert bus.flushed_position([{"sources": [{"endOffset": "7"}]}, {}]) == "7" and bus.flushed_position([]) is None
    counts = stream_cdc.windowed_counts(spark.createDataFrame([("2024-01-01 00:01:00", "a"), ("2024-01-01 00:02:00", "a")], "ts string, k string").select(F.to_timestamp("ts").alias("ts"), "k"), "ts", "k")
    assert [r.n for r in counts.collect()] == [2]


def test_sampled_share(spark):
    df = spark.range(20_000)
    n = cdc.sampled(df, "id", 0.01).count()
    assert 120 < n < 300 and cdc.sampled(df, "id", 0.01).count() == n


TRANSFORMERS = [
    ("string", ["  Ab c ", "x", "", "a-b-c", "12", "-7", "été", "a,b"], [
        "return v.strip().title().removeprefix('A')", "return v.zfill(5) + v.ljust(4, '.') + v.rjust(4) + v.center(7, '*')", "return v.find('b') + v.rfind('-') + len(v) + v.count('-')",
        "return '|'.join(v.split('-')) + str(len(v.split()))", "return v[::-1] + v[1:3] + v[-2:] if v else None", "return v[0] if v else 'none'",
        "xs = [c.upper() for c in v if c.isalpha()]\n    xs.append('!')\n    return ''.join(xs)", "return ''.join(sorted(set(v)))", "return any(c.isdigit() for c in v) and not all(c == 'x' for c in v)",
        "return v or 'empty'", "return v and v.lower()", "return 'a' in v or v in ['x', '12']", "return f'{v:>6}|{v!s}|{len(v):03d}'", "return '{} and {:>4}'.format(v, len(v))",
        "import_ = v.isdigit()\n    n: int = int(v) if import_ else 0\n    n += 2\n    return n * 3 - 1", "return v.translate(str.maketrans('abc', 'xyz'))", "return v.encode('utf-8').decode('utf-8') * 2",
        "import_ = re.match(r'(\\w+)-(\\w+)', v)\n    return import_.group(2) if import_ is not None else 'no'", "return re.sub(r'(\\w)-(\\w)', r'\\2+\\1', v, flags=re.I)", "return ''.join(re.findall(r'[a-z]', v))", "return len(re.split(r'[-,]', v))", "return bool(re.fullmatch(r'-?\\d+', v)) if v else False", "return re.search('b', v) is None",
        "return sum(i for i, c in enumerate(v) if c == '-')", "return ''.join(a + b for a, b in zip(v, v[1:]))", "return ''.join(map(lambda c: c + c, filter(lambda c: c != '-', v)))", "return max(v) if v else min(['q', 'p'])",
        "d = {'x': 1, 'a,b': 2}\n    d.update({'y': 3})\n    return d.get(v, 0) + len(d.keys()) + sum(d.values())", "return json.dumps(v)", "return isinstance(v, str)", "if v == 'x':\n        return 'is x'\n    elif v.startswith('a'):\n        return 'starts'\n    return v.upper()",
    ]),
    ("number", [0, 1, -7, 255, 3], ["return hex(v) + oct(v) + bin(v)", "return divmod(v, 3)[0] * 100 + divmod(v, 3)[1]", "return -2 <= v < 200", "return f'{v:05d}|{v:,}|{v:>8}'", "return sum(range(3)) + pow(v, 2)", "return (v + 10) // 3 % 4 + (v << 2) + (v >> 1)", "return max(v, 2) - min(v, 5, 1) + abs(v)", "return [x * v for x in range(4) if x % 2][-1]", "return str(Decimal(v) + Decimal('0.5'))[:3] if v > 0 else None", "return v if v else 'zero'.upper()[:0] or None"]),
    ("string", ["2024-02-28T10:20:30", "1999-12-31T00:00:00.500000"], ["return datetime.fromisoformat(v).isoformat()", "return (datetime.fromisoformat(v) + timedelta(days=2, hours=1)).strftime('%d/%m/%Y %H:%M:%S at')", "return datetime.fromisoformat(v).weekday() * 1000 + datetime.fromisoformat(v).year", "return date.fromisoformat(v[:10]).isoformat() + str(date.fromisoformat(v[:10]).replace(day=1))", "return (datetime.fromisoformat(v) - datetime(1999, 1, 1)).total_seconds()", "return datetime.strptime(v[:10], '%Y-%m-%d').date().isoweekday()", "return datetime.fromisoformat(v).replace(hour=5).isoformat()"]),
    ("string", ["1.005", "-2.345", "7", "0.125"], ["return str(Decimal(v).quantize(Decimal('0.01'), ROUND_HALF_UP))", "return str(Decimal(v).quantize(Decimal('0.01')))", "return str(Decimal(v).quantize(Decimal('0.1'), rounding=ROUND_DOWN))", "return str(Decimal(v).quantize(Decimal('0.1'), rounding=ROUND_UP))", "return Decimal(v).compare(Decimal('1'))", "return f'{float(v):.2f}|{float(v):>9.1f}'" if False else "return f'{float(v) * 4:.1f}'"]),
]


def test_transformers_equal_python(spark):
    """Each transformer, compiled and as Python runs it."""
    import datetime as d
    import decimal
    import json
    import re

    scope = {"re": re, "json": json, "Decimal": decimal.Decimal, "datetime": d.datetime, "date": d.date, "timedelta": d.timedelta, **{m: getattr(decimal, m) for m in ("ROUND_HALF_UP", "ROUND_DOWN", "ROUND_UP")}}
    for kind, values, bodies in TRANSFORMERS:
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v " + ("string" if kind == "string" else "long"))
        sources = [f"def transform(v):\n    {b}" for b in bodies]
        got = df.select("i", *[transform.compile_transformer(s, F.col("v"), kind).cast("string").alias(f"x{k}") for k, s in enumerate(sources)]).orderBy("i").collect()
        for k, s in enumerate(sources):
            own = dict(scope)
            exec(s, own)  # the test's own sources
            for r, v in zip(got, values, strict=True):
                want = own["transform"](v)
                x = r[f"x{k}"]
                if isinstance(want, bool):
                    want = str(want).lower()
                same = x == want if want is None or isinstance(want, str) else x is not None and abs(float(x) - float(want)) < 1e-9
                assert same, (s, v, x, want)


def test_transformers_refuse():
    for body in ("return open('x')", "return v.__class__", "import os", "return eval(v)", "while True: pass", "return [x for x in v for y in v]", "return f'{v:{v}}'", "return re.sub(v, '', v)", "return json.dumps([v])", "return sorted(v, key=len)", "return lambda x: x", "return v.format_map({})", "return unknown"):
        with pytest.raises(transform.SecurityViolation):
            transform.compile_transformer(f"def transform(v):\n    {body}", F.lit("x"), "string")


def test_links_without_a_predecessor(spark):
    a, b = "a" * 64, "b" * 64
    rows = spark.createDataFrame([("g", 1, "GENESIS", a), ("g", 2, None, b), ("g", 3, b, a), ("h", 1, None, a), ("h", 2, a, b)], "g string, o int, predecessor_hash string, chain_hash string")
    assert [(r.g, r.o) for r in provenance.broken_links(rows, "g", "o").collect()] == [("g", 2)]
    assert sorted((r.g, r.o) for r in provenance.broken_links(rows, "g", "o", "GENESIS").collect()) == [("g", 2), ("h", 1)]


def test_lasting_errors_are_not_tried_again():
    tries = []

    def refused():
        tries.append(1)
        raise RuntimeError("FATAL: password authentication failed")

    with pytest.raises(RuntimeError):
        migration.with_retry(refused, sleep=lambda s: None)
    assert len(tries) == 1


def test_numstat_and_counters(spark):
    text = ["COMMIT:h1|ann|2024-01-01|first", "3\t1\ta.py", "-\t-\tb.png", "COMMIT:h2|bob|2024-01-02|second", "x\t2\tc.ts", "", "5\t0\td.js"]
    lines = spark.createDataFrame(list(enumerate(text)), "line_no long, value string").repartition(4)
    got = sorted((r.commit, r.author, r.added, r.deleted, r.path) for r in observe.git_numstat(lines).collect())
    assert got == [("h1", "ann", 3, 1, "a.py"), ("h2", "bob", 0, 2, "c.ts"), ("h2", "bob", 5, 0, "d.js")]
    events = ['{"pod": {"labels": {"observe": "true"}}, "dns": {}}', '{"pod": {"labels": {}}, "dns": {}}', '{"dns": {}}', '{"pod": {"labels": {"observe": "true"}}}', "bad"]
    raw = observe.json_lines(spark.createDataFrame([(x,) for x in events], "value string"))
    assert [tuple(r) for r in observe.counters(raw).collect()] == [("dns_lookup", 3, 1, 2)]
