"""The pipeline and the licence scan against plain versions of what they compute."""

import re
from collections import Counter

import numpy as np

import corpus_pipeline
from tessera.llm import licenses, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE = " ".join(f"passage{i}" for i in range(60))


def documents(spark, path):
    """The smallest documents with rejects, copies, near copies and a repeated passage among them."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    long = [t for _, t, *_ in rows if t and 120 < len(WORD.findall(t)) < 600]
    near = long[0].split()
    near[len(near) // 2] = "changed"
    texts = [None, "", " \t ", "12 %% 34", long[0], " ".join(near), long[1] + "\n" + PASSAGE, PASSAGE + " " + long[2], "x" * 30_000, "one word"]
    rows += [(1_000_000 + i, t, None, None, len(t or "")) for i, t in enumerate(texts)]
    schema = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").schema
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    return [(r[0], r[1]) for r in rows]


def near_groups(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = frozenset(tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))) if w else frozenset()
    low = {i: i for i in sets}
    ids = sorted(sets)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * min(len(sets[a]), len(sets[b])) >= percent * max(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while True:
        before = dict(low)
        for a, b in linked:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            return low


def without_repeats(rows, window):
    first, out = {}, []
    for i, t in sorted(rows):
        w = WORD.findall(t)
        gone = set()
        for j in range(len(w) - window + 1):
            if first.setdefault(tuple(w[j : j + window]), i) < i:
                gone.update(range(j, j + window))
        text = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else t
        if text or not gone:
            out.append((i, text))
    return out


def filled(room, items):
    """The longest items first, each if it still fits."""
    total = 0
    for n in items:
        if n <= room - total:
            total += n
    return total


def packed(rows, permitted):
    """Lengths in each bin, and its size."""
    items = []
    for i, t in rows:
        n = len(WORD.findall(t))
        items += [(min(max(permitted), n - at), i, at) for at in range(0, n, max(permitted))]
    items.sort(key=lambda x: (-x[0], x[1], x[2]))
    lengths, bins = [n for n, *_ in items], []
    for turn, n in enumerate(lengths):
        fits = [b for b in bins if b[0] >= n]
        if fits:  # of equal rooms, the one that came to it last
            b = min(fits, key=lambda b: (b[0], -b[2]))
        else:
            size = min((c for c in permitted if c >= n), key=lambda c: ((64 + c + c * c / 16384) / (n + filled(c - n, lengths[turn + 1 :])), c))
            bins.append(b := [size, [], 0])
        b[0], b[2] = b[0] - n, turn
        b[1].append(n)
    return Counter((tuple(sorted(b[1])), min(c for c in permitted if c >= sum(b[1]))) for b in bins)


def test_pipeline(spark, tmp_path):
    rows = documents(spark, tmp_path)
    model = queries.language_model(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    known = [(i, t) for i, t in rows if t and re.search(r"[^\W\d_]", t) and not model.predict([t])[2][0]]
    assert {1_000_000, 1_000_001, 1_000_002, 1_000_003}.isdisjoint(i for i, _ in known)
    low = near_groups(known, 5, 80)
    single = [(i, t) for i, t in known if low[i] == i]
    assert {1_000_004, 1_000_005}.isdisjoint(i for i, _ in single)
    left = without_repeats(single, 40)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    words = Counter()
    for r in got:
        words[r.doc_id] += r.length
    assert dict(words) == {i: len(WORD.findall(t)) for i, t in left}
    bins = {}
    for r in got:
        if r.bin_id is not None:
            bins.setdefault((r.bin_id, r.bin_length), []).append(r.length)
    assert Counter((tuple(sorted(v)), k[1]) for k, v in bins.items()) == packed(left, queries.LENGTHS)


def test_rows_without_an_id_and_repeated_ids(spark):
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    a, b, c, shared = words("a", 60), words("b", 60), words("c", 60), words("s", 50)
    near = a.replace("a30 ", "changed ")
    rows = [(3, a), (3, a), (5, near), (5, b), (None, c), (None, c), (None, near), (None, None), (7, f"{c} {shared}"), (8, f"{shared} p"), (8, f"q r {shared}"), (8, "clean"), (None, f"{shared} t"), (9, shared)]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long").repartition(3)
    one = [(r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_group(spark, docs, "").collect()]
    # the texts around ``shared`` that are its near copies go with the smallest id that has one
    want = [(3, a), (5, b), (None, c), (None, None), (7, f"{c} {shared}"), (8, "clean")]
    of_shared = {(8, f"{shared} p"), (8, f"q r {shared}")}
    assert Counter(x for x in one if x not in of_shared) == Counter(want) and sum(x in of_shared for x in one) == 1
    cut = Counter((r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.cut_repeated_passages(spark, docs.where("doc_id in (7, 8, 9) or doc_id is null"), "").collect())
    left = [(None, c), (None, c), (None, near), (None, None), (7, f"{c} {shared}"), (8, "p"), (8, "q r"), (8, "clean"), (None, f"{shared} t")]
    assert cut == Counter((i, t, len(t or "")) for i, t in left)


def test_stages_on_no_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, "/root/testdata/sf0.001")
        assert out.count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns


def test_license_query_against_every_template(spark):
    """Every segment of every text against every template, without size bounds."""
    sets = [(name, licenses.bigrams(text)) for name, text in licenses.TEMPLATES]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r in docs:
        text, best = r.text or "", {}
        for s in {*text.split("\n"), *re.split(r"\n\s*\n", text), text}:
            b = licenses.bigrams(s)
            for name, t in sets:
                dice = 2 * len(b & t) / (len(b) + len(t)) if b else 0
                if dice >= 0.85:
                    best.setdefault(s, []).append((dice, name))
        # a segment has the licence of its best template
        first = [max(v, key=lambda x: x[0]) for v in best.values()]
        want[r.doc_id] = {n: max(d for d, m in first if m == n) for n in {m for _, m in first}}
    got = queries.op5_license_scan(spark, "/root/testdata/sf0.001").collect()
    assert any(want.values())
    assert {r.doc_id: set(filter(None, r.licenses.split(","))) for r in got} == {i: set(w) for i, w in want.items()}
    assert all(r.dice is None if not want[r.doc_id] else np.isclose(r.dice, max(want[r.doc_id].values())) for r in got)
