"""Vector codes, shared lines and periodic runs against brute force on small tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import line_dedup, periodic, queries, vector_codes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"


def brute_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    """rows of (id, vector, label), usable ones of one length."""
    ints = {i: [int(np.floor(scale * x)) for x in v] for i, v, _ in rows}
    d = len(rows[0][1]) // parts
    cut = lambda v, k: v[k * d : (k + 1) * d]
    first = sorted(ints)[:entries]
    books = [[cut(ints[i], k) for i in first] for k in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for k in range(parts):
            got = defaultdict(list)
            for v in ints.values():
                got[near(cut(v, k), books[k])[1]].append(cut(v, k))
            for e, xs in got.items():
                books[k][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out, by_label = {}, defaultdict(int)
    for i, _, label in rows:
        hit = [near(cut(ints[i], k), books[k]) for k in range(parts)]
        out[i] = ("".join(f"{e:02x}" for _, e in hit), sum(x for x, _ in hit))
        by_label[label] += out[i][1]
    text = ",".join(str(c) for b in books for e in b for c in e)
    return {i: (*out[i], by_label[label]) for i, _, label in rows}, hashlib.sha256(text.encode()).hexdigest()


def coded(df, **how):
    return {r[0]: tuple(r)[1:] for r in vector_codes.compress_vectors(df, **how).collect()}


@pytest.mark.parametrize("entries,bits,spread", [(5, 4, 1.0), (16, 1, 1.0), (7, 3, 0.01), (256, 4, 1.0)])
def test_vector_codes(spark, entries, bits, spread):
    r = random.Random(entries)
    rows = [(3 * i - 40, [float(np.float32(r.gauss(0, spread))) for _ in range(8)], r.choice([None, 1, 2])) for i in range(60)]
    rows += [(1000 + i, list(rows[i][1]), 2) for i in range(6)]  # ties
    bad = [(5000, None, 1), (5001, [None] + [1.0] * 7, 1), (5002, [float("nan")] * 8, 1), (5003, [float("inf")] + [0.0] * 7, 2)]
    other = [(6000, [1.0, 2.0], 7), (6001, [], None), (6002, [1.0] * 12, 7)]
    df = spark.createDataFrame(rows + bad + other, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 id", "'x' code", "2 vec", "3 m0").repartition(3)
    want, sha = brute_codes(rows, entries=entries)
    got = coded(df, entries=entries, bits=bits)
    assert {i: v for i, v in got.items() if i < 5000} == {i: (*v, sha) for i, v in want.items() if i < 6000}
    # other lengths have no code; their label none of its own, or that of the coded rows
    assert {i: v[:2] for i, v in got.items() if i >= 5000} == {i: (None, None) for i in (6000, 6001, 6002)}
    assert got[6000][2] is None and got[6001][2] == next(v[2] for i, v in want.items() if dict((a, c) for a, _, c in rows)[i] is None)


def test_vector_codes_of_large_components(spark):
    rows = [(i, [float(10 ** (7 * (i % 4)) * (1 if i % 2 else -1) * (j + 1 + i)) for j in range(4)], None) for i in range(12)]
    exact = [(i, [int(c) * 1024 for c in v]) for i, v, _ in rows]
    books = [[[v[k]] for i, v in exact[:3]] for k in range(4)]
    for _ in range(2):
        for k in range(4):
            got = defaultdict(list)
            for _, v in exact:
                got[min(((v[k] - c[0]) ** 2, e) for e, c in enumerate(books[k]))[1]].append(v[k])
            for e, xs in got.items():
                books[k][e] = [sum(xs) // len(xs)]
    want = {i: [min(((v[k] - c[0]) ** 2, e) for e, c in enumerate(books[k])) for k in range(4)] for i, v in exact}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = coded(df, entries=3, rounds=2)
    most = (1 << 63) - 1
    assert {i: v[:2] for i, v in got.items()} == {i: ("".join(f"{e:02x}" for _, e in h), min(most, sum(x for x, _ in h))) for i, h in want.items()}
    assert {v[2] for v in got.values()} == {min(most, sum(v[1] for v in got.values()))}
    huge = spark.createDataFrame([(1, [1e300, -1e300, 3.0, 0.0], 1), (2, [5e-324, 1.7e308, -1.7e308, 1.0], 1)], "vec_id long, embedding array<double>, label long")
    assert {i: v[0] for i, v in coded(huge).items()} == {1: "00000000", 2: "01010101"}


def test_vector_codes_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert coded(spark.createDataFrame([], schema)) == {}
    none = spark.createDataFrame([(1, None, 1), (2, [], 1), (3, [1.0], 2)], schema)
    assert coded(none) == {2: (None, None, None, None), 3: (None, None, None, None)}
    twice = spark.createDataFrame([(1, [1.0] * 4, 1), (1, [1.0] * 4, 1), (2, [3.0] * 4, 1), (None, [2.0] * 4, None)], schema)
    got = sorted(tuple(r)[:4] for r in vector_codes.compress_vectors(twice, entries=3).collect() if r.vec_id)
    # the null id's vector goes to the first of two equal entries and draws it away
    assert got == [(1, "01010101", 0, 0), (1, "01010101", 0, 0), (2, "02020202", 0, 0)]
    books = vector_codes.fit_codebooks(spark.read.parquet(f"{SMALL}/embeddings.parquet"), entries=16, rounds=2)
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    near = [np.linalg.norm(np.array(books.decode(r.code)) - np.array(r.m0)) for r in vector_codes.encode(rows, books, keep=("embedding",)).collect()]
    assert np.mean(near) < 0.95  # vectors of length one: the code tells something


def test_va_file_bounds():
    rng = np.random.default_rng(3)
    entries, q = rng.integers(-300, 300, (256, 16)), rng.integers(-400, 400, (500, 16))
    dist = ((q[:, None] - entries[None]) ** 2).sum(axis=2)
    va = vector_codes.VaFile(entries, 4)
    at, error = va.nearest(q)
    assert (at == dist.argmin(axis=1)).all() and (error == dist.min(axis=1)).all()
    row, entry = va.candidates(q)
    assert len(row) < 0.6 * dist.size and (np.unique(row) == np.arange(500)).all()
    same = vector_codes.VaFile(np.zeros((9, 4), np.int64), 4)
    assert same.nearest(np.ones((3, 4), np.int64))[0].tolist() == [0, 0, 0]


def brute_lines(rows, min_chars, min_docs):
    low = str.maketrans({c: c + 32 for c in range(65, 91)})
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low)
    as_id = lambda i: -(1 << 63) if i is None else i
    docs, out = defaultdict(set), []
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                docs[key(x)].add(as_id(i))
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(docs[key(x)]) >= min_docs and max(docs[key(x)]) != as_id(i))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def lined():
    r = random.Random(3)
    pool = [f"Line Number {i} of the pool  \x0b\t" for i in range(30)] + ["É" * 20, "  not stripped  "]
    rows = []
    for i in range(150):
        lines = [r.choice(pool) if r.random() < 0.4 else f"own {i} {j}" * 2 for j in range(r.randint(0, 8))]
        if r.random() < 0.7:
            lines += ["hot LINE that all have "] * r.randint(1, 3)
        rows.append((i * 2 - 30, "\n".join(lines)))
    rows += [(None, "hot line that all have\nx"), (None, None), (None, "Hot line that all have"), (5000, None), (5001, ""), (5002, "\n"), (5003, "a\r\n" * 3), (4, rows[17][1]), (6, "hot line that all have\n" * 5)]
    return rows + [rows[3]] * 10 + [(7000, "\n".join(f"line {i} of a very long text" for i in range(30_000)))]


@pytest.mark.parametrize("ranges,batch,chars,least", [(1, 10_000, 10, 5), (16, 17, 10, 5), (40, 5, 10, 2), (8, 3, 12, 1)])
def test_shared_lines(spark, monkeypatch, lined, ranges, batch, chars, least):
    set_ = {"spark.sql.shuffle.partitions": ranges, "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": batch}
    before = {k: spark.conf.get(k) for k in set_}
    rows = lined if ranges == 1 else lined[:-1]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as pos", "'k' as keep", "2 as id", "3 as print", "4 as doc").repartition(3)
    try:
        for k, v in set_.items():
            spark.conf.set(k, v)
        got = line_dedup.drop_shared_lines(df, min_chars=chars, min_docs=least).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got), key=repr) == brute_lines(rows, chars, least)
    assert all((r.keep is None) == (r.n_dropped == 0) for r in got)


def test_shared_lines_edges(spark):
    assert line_dedup.drop_shared_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    for n in (1, 7, 8, 9, 1000):
        gone = np.arange(0, n, 3)
        want = np.ones(n + 5, bool)
        want[gone] = False
        assert (line_dedup.unpack_bits(line_dedup.pack_bits(gone), n + 5) == want).all()


def brute_runs(w, least=24, times=3):
    n, out = len(w), {}
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            if i > s and i - s + p >= max(least, times * p):
                out.setdefault((s, i + p), p)
            i += i == s
    return sorted((s, e - s, p) for (s, e), p in out.items())


def test_runs():
    r = random.Random(1)
    ids = np.random.default_rng(5).integers(0, 2**63, 64).astype(np.uint64)
    for _ in range(60):
        docs = []
        for _ in range(r.randint(1, 6)):
            w = [r.randrange(r.choice([1, 2, 3, 50])) for _ in range(r.randint(0, 120))]
            for _ in range(r.randint(0, 3)):
                a, p = r.randrange(len(w) + 1), r.randint(1, 12)
                for i in range(a, min(len(w), a + p * r.randint(2, 8))):
                    w[i] = w[a + (i - a) % p]
            docs.append(w)
        least, times = r.choice([(24, 3), (6, 2), (5, 3)])
        sizes = np.array([len(d) for d in docs])
        t, s, length, p = periodic.find_runs(ids[np.array(sum(docs, []), int)], sizes, None, least, times)
        begins = np.cumsum(sizes) - sizes
        for k, d in enumerate(docs):
            got = [(int(x - begins[k]), int(y), int(z)) for n, x, y, z in zip(t, s, length, p, strict=True) if n == k]
            assert got == sorted(brute_runs(d, least, times), key=lambda x: (x[0], x[2]))


def test_runs_of_colliding_hashes():
    """Words are compared themselves where their hashes say too much."""
    w = [x for _ in range(12) for x in ("a", "b", "c")]
    w[17] = "C"
    hashed = np.array([{"a": 1, "b": 2, "c": 3, "C": 3}[x] for x in w], np.uint64)
    same = periodic._agreeing([" ".join(w).encode()], np.array([0]))
    got = periodic.find_runs(hashed, np.array([len(w)]), same, 9, 3)
    assert [x.tolist() for x in got[1:]] == [[0, 18], [17, 18], [3, 3]] and brute_runs(w, 9, 3) == [(0, 17, 3), (18, 18, 3)]


def expected_runs(text):
    w = WORD.findall(text or "")
    runs = brute_runs(w)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
    return len(w), runs, best, " ".join(x for i, x in enumerate(w) if i not in gone)


def test_periodic_rows(spark):
    block = "one two  three\tfour five"
    texts = [None, "", " \n ", "short", f"start {block * 1} " + f"{block} " * 8 + "end", "x " * 24, "x " * 23, "a b " * 12 + "c d " * 12 + "z", "é ü " * 30]
    texts += [texts[4]] * 3 + ["same " * 200_000]
    df = spark.createDataFrame([(i % 9, t) for i, t in enumerate(texts)], "doc_id int, text string").selectExpr("*", "1 as n_words", "'r' as runs", "null as `best`", "0 as t", "array(1) as c0").repartition(2)
    got = periodic.periodic_runs(df).collect()
    assert len(got) == len(texts)
    want = {t: expected_runs(t) for t in texts[:-1]} | {texts[-1]: (200_000, [(0, 200_000, 1)], (0, 200_000, 1), "same")}
    seen = {(r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.best and tuple(r.best), r.collapsed) for r in got}
    assert seen == {(i % 9, n, tuple(runs), best, left) for i, t in enumerate(texts) for n, runs, best, left in [want[t]]}
    assert periodic.periodic_runs(df.limit(0)).count() == 0


def test_periodic_query_over_all_documents(spark):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, SMALL).collect()}
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        w = WORD.findall(r.text or "")
        n, h = len(w), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        if n > 4000:  # quadratic
            continue
        _, runs, best, left = expected_runs(" ".join(w))
        lines = "".join(f"{s},{k},{p}\n" for s, k, p in runs)
        want = (len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())
        assert got[r.doc_id] == want


def test_planting_keeps_other_texts(spark):
    df = spark.createDataFrame([(i, t) for i in range(40) for t in (None, "", " a  b\n", " ".join(map(str, range(50))))], "doc_id long, text string")
    got = queries.planted(df).withColumn("h", F.crc32(F.col("doc_id").cast("string")) % 10).collect()
    assert all(r.text in (None, "", " a  b\n", " ".join(map(str, range(50)))) for r in got if r.h) and sum(1 for r in got if not r.h) > 4
