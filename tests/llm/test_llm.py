"""The operators against brute force on small tables with nulls, empty texts, ties, repeated rows and clashing columns."""

import base64
import hashlib
import random
import re
import time
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, html_text, langid, licenses, ngram_join, packing, queries, scratch, sharding, suffix_dedup, vectors
from tessera.llm.ngram_join import ngram_jaccard_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    base = [" ".join(r.choice(vocab) for _ in range(r.randint(20, 90))) for _ in range(12)]
    passage = " ".join(f"q{i}" for i in range(30))
    texts = [None, "", "  \t ", "one", "One", "one two three", "x" * 5000]
    for b in base:
        texts += [b, b.upper(), b]
        for edits in (1, 2, 4, 8):
            w = b.split()
            for _ in range(edits):
                w[r.randrange(len(w))] = r.choice(vocab)
            texts.append(" ".join(w))
    texts += [b + " " + passage for b in base[:4]]
    order = list(range(len(texts)))
    r.shuffle(order)
    return [(i * 3, texts[k]) for i, k in enumerate(order)]


def frame(spark, rows):
    # columns whose names the operators use inside
    return spark.createDataFrame([(i, t, 1, "n", t, "v") for i, t in rows], "doc_id long, text string, id int, node string, items string, component string").repartition(3)


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))) if w else frozenset()


def closed(ids, linked):
    low = dict(zip(ids, ids, strict=True))
    moved = True
    while moved:
        moved = False
        for a, b in linked:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                moved = True
    return low


@pytest.mark.parametrize("short", [24, 1])
def test_ngram_join(spark, monkeypatch, short):
    monkeypatch.setattr(ngram_join, "SHORT", short)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rows = corpus()
    sets = {i: shingles(t) for i, t in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = closed([i for i, _ in rows], linked)
    got = ngram_jaccard_components(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in sets}
    assert ngram_jaccard_components(frame(spark, rows).limit(0)).count() == 0
    long = " ".join(f"w{i}" for i in range(150_000))
    far = ngram_jaccard_components(frame(spark, [(1, long), (2, long + " end"), (3, "a b c d e f"), (4, None)])).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in far} == {1: (149_997, 1), 2: (149_998, 1), 3: (3, 3), 4: (0, 4)}
    twice = ngram_jaccard_components(frame(spark, [(5, "a b c d e"), (5, "a b c d e"), (9, "a b c d e")])).collect()
    assert sorted((r.doc_id, r.component_id) for r in twice) == [(5, 5), (5, 5), (9, 5)]


def test_ngram_join_lists(spark, monkeypatch):
    """Lists with the same nodes are kept and compared once; long ones are cut into rows and still compared whole."""
    rng = np.random.default_rng(3)
    rows = []
    for g in range(12):
        words = [f"g{g}w{i}" for i in range(200)]
        for k in range(9):
            mine = list(words)
            for at in rng.choice(200, int(rng.integers(0, 9)), replace=False):
                mine[at] = f"x{g}-{k}-{at}"
            rows.append((100 * g + k, " ".join(mine)))
    sets = {i: shingles(t) for i, t in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want, put, sizes = closed(list(sets), linked), scratch.Scratch.put, {}

    def counted(self, df, name):
        out = put(self, df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(scratch.Scratch, "put", counted)
    got = ngram_jaccard_components(frame(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == want and len(set(want.values())) > 12
    assert sizes["lists"] < len(rows) * 4
    monkeypatch.setattr(ngram_join, "LANE", 3)
    monkeypatch.setattr(ngram_join, "SHORT", 2)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    got = ngram_jaccard_components(frame(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_ngram_join_parts():
    """Packed lists against plain grouping, over any cut into batches; parities never part sets that link."""
    rng = np.random.default_rng(4)
    t = np.sort(rng.integers(0, 12, 60))
    for most, step in ((3, 1), (4, 7), (100, 60), (1, 5)):
        batches = [pa.RecordBatch.from_arrays([pa.array(t[i : i + step]), pa.array(np.arange(60)[i : i + step]), pa.array(np.arange(60, dtype=np.int32)[i : i + step])], ["token", "node", "m"]) for i in range(0, 60, step)]
        out = [r for b in ngram_join._packed(most)(batches) for r in b.to_pylist()]
        lists = {}
        for r in out:
            assert r["many"] == len(r["nodes"]) // 8 <= most and (r["cut"] is None or r["cut"] == r["token"])
            lists.setdefault(r["token"], []).extend(np.frombuffer(r["nodes"], "<i8").tolist())
        assert lists == {k: np.flatnonzero(t == k).tolist() for k in set(t.tolist()) if (t == k).sum() > 1}
        assert {r["token"] for r in out if r["cut"] is not None} == {k for k in set(t.tolist()) if (t == k).sum() > most}
    kept = parted = 0
    for _ in range(2000):
        whole = rng.integers(0, 1 << 63, int(rng.integers(1, 400)), dtype=np.uint64)
        a = np.unique(whole[: max(1, int(len(whole) * rng.uniform(0.7, 1)))])
        b = np.unique(whole[int(len(whole) * rng.uniform(0, 0.3)) :])
        links, may = ngram_join.jaccard_links(a, b, 85), ngram_join.may_link(ngram_join.parity(a), len(a), ngram_join.parity(b), len(b), 85)
        assert may or not links
        kept, parted = kept + links, parted + (not may)
    assert kept > 200 and parted > 800


def test_suffix_subtrees():
    """The parts of the operator against plain loops, on words that collide in half of their bits."""
    rng = np.random.default_rng(0)
    words = rng.integers(0, 3, 3000).astype(np.uint32) * np.uint32(0x10001) + rng.integers(0, 2, 3000).astype(np.uint32) * np.uint32(0x10000)
    at = np.arange(len(words) - 5)
    doc = at // 40
    seen = {}
    for i in at:
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    want = {i for v in seen.values() for i in v if doc[i] > min(doc[j] for j in v)}
    for limit in (1, 7, 1 << 20):
        assert set(suffix_dedup.owned_elsewhere(words, at, doc, 5, limit).tolist()) == want
    assert set(np.flatnonzero(suffix_dedup.repeats_within(words.astype(np.uint64), at, doc, 5)).tolist()) == want


def brute_cut(rows, window):
    first, out = {}, {}
    for i, t in sorted(rows):
        w = WORD.findall(t or "")
        gone = set()
        for j in range(len(w) - window + 1):
            if first.setdefault(tuple(w[j : j + window]), i) < i:
                gone.update(range(j, j + window))
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("limit", [1, 1 << 20])
def test_suffix_dedup(spark, monkeypatch, limit):
    # small batches and partitions: suffixes of one text meet others of several tasks
    monkeypatch.setattr(suffix_dedup, "BATCH", 400)
    monkeypatch.setattr(suffix_dedup, "PARTITION", 300)
    long = " ".join(f"v{i % 977}" for i in range(30_000))
    rows = corpus(2) + [(10_000, " ".join(["z"] * 40)), (10_001, " ".join(["z"] * 41)), (10_002, long), (10_003, "u " + long)]
    got = suffix_dedup.suffix_dedup(frame(spark, rows), group_limit=limit).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == brute_cut(rows, 13)
    assert suffix_dedup.suffix_dedup(frame(spark, rows).limit(0)).count() == 0


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = queries.op2_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.98 and sum(r.rejected for r in out) == 0
    model = queries.language_model(docs)
    odd = langid.identify(frame(spark, [(1, None), (2, ""), (3, "12 %%"), (4, "the and of that with this")]).withColumn("score", F.lit(9)), model).collect()
    assert [r.lang_pred for r in sorted(odd)] == ["und", "und", "und", "en"] and all(0 <= r.score <= 1 for r in odd)
    none = langid.identify(frame(spark, [(1, "abc")]), queries.language_model(docs.limit(0))).first()
    assert none.lang_pred == "und" and none.rejected


def test_numbers_are_no_letters(spark):
    model = langid.fit_language_model(spark.createDataFrame([(f"the words of text {i} go on", "en", i) for i in range(30)] + [(f"les mots du texte {i} sont longs", "fr", i) for i in range(30)], "text string, lang string, i int"), "text", "lang", F.col("i"))
    got = langid.identify(spark.createDataFrame([(i, t) for i, t in enumerate(["½ ²³", "Ⅷ", "1 2_3", "ª"])], "doc_id long, text string"), model).collect()
    assert {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id < 3} == {i: ("und", 0.0) for i in range(3)}


def test_language_query_against_plain_vectors(spark):
    """Every gram of every text counted one by one, and every centroid tried."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = queries.language_model(docs)
    got = {r.doc_id: r for r in queries.op2_language_id(spark, "/root/testdata/sf0.001").collect()}
    held = queries.held_out(F.col("doc_id"))
    assert {i: r.held_out for i, r in got.items()} == {r.doc_id: r.h for r in docs.select("doc_id", held.alias("h")).collect()}
    for r in docs.select("doc_id", "text").collect():
        own = got[r.doc_id]
        if not r.text or not any(map(str.isalpha, r.text)):
            assert (own.lang_pred, own.score) == ("und", 0)
            continue
        raw = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in f" {r.text} ".lower().encode())
        slots = Counter()
        for k in range(len(raw) - 1):
            if (two := int.from_bytes(raw[k : k + 2])) != 0x2020:
                slots[(two + 1) * 0x9E3779B1 % 2**32 >> 20] += 1
            if k < len(raw) - 2:
                slots[(int.from_bytes(raw[k : k + 3]) + 1) * 0x85EBCA6B % 2**32 >> 20] += 1
        v = np.zeros(langid.DIMS)
        for slot, n in slots.items():
            v[slot] = np.log1p(n) * model.idf[slot]
        cosine = model.centroids.astype(float) @ v / np.linalg.norm(v)
        assert own.lang_pred == model.languages[int(cosine.argmax())] and abs(own.score - cosine.max()) < 1e-5
    # other columns, repeated rows, texts longer than a slice
    rows = [(1, "the and of that with this"), (1, "the and of that with this"), (2, "the and " * 200_000)]
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang_pred", F.lit(5)), model, names=("l", "s", "r"))
    assert sorted((r.doc_id, r.lang_pred, r.l) for r in out.collect()) == [(1, 5, "en"), (1, 5, "en"), (2, 5, "en")]


def test_language_id_rejects_what_was_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = queries.language_model(docs)
    rng = np.random.default_rng(1)
    words = lambda letters, n: " ".join("".join(rng.choice(list(letters), rng.integers(2, 10))) for _ in range(n))
    odd = [words("bcdfghjklmnpqrstvwxz", n) for n in (20, 300)] + [base64.b64encode(rng.bytes(n)).decode() for n in (90, 900)] + [rng.bytes(n).hex() for n in (90, 900)]
    odd += ["Suomen kieli on uralilaisten kielten itämerensuomalaiseen ryhmään kuuluva kieli, jota puhuvat pääosin suomalaiset.", "Język polski jest językiem z grupy zachodniosłowiańskiej, do której należą również czeski, kaszubski i słowacki."]
    assert model.predict(odd)[2].all()
    # held-out texts stay, whole and cut
    clean = [r.text for r in docs.where(queries.held_out(F.col("doc_id"))).collect() if r.text and len(r.text) > 400]
    for n in (100, 400, 10**6):
        assert model.predict([t[:n] for t in clean])[2].mean() < 0.02
    # an odd row neither is a centroid nor sets a floor
    rows = [r for r in docs.where("lang = 'de'").collect() if r.text] + [(-1, "Zzqx", "de")]
    one = langid.fit_language_model(spark.createDataFrame(rows, docs.schema), "text", "lang", F.col("doc_id"))
    best = np.bincount([int(np.argmax(langid.unit(np.log1p(langid.count_matrix([r[1]])) * one.idf) @ one.centroids.T)) for r in rows], minlength=len(one.centroids))
    assert best.min() > 0.02 * len(rows) and one.predict([odd[1]])[2].all()


def test_bpe_matches_the_library():
    import tiktoken

    ranks = bpe.load_ranks(queries.RANKS)
    own = bpe.PrefixBpe(ranks, public_tokenizers.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(3)
    texts = ["", " ", "a  b\n\n c", "don't I'LL", "éèê 日本語 😀", "=" * 3000, "<|endoftext|>"] + ["".join(r.choice("abcdefghij éz 12\n.,'") for _ in range(200)) for _ in range(60)]
    for t in texts:
        ids = own.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t)
        assert own.decode(ids) == t.encode()


def test_bpe_query_equals_the_library(spark):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(queries.RANKS), special_tokens={})
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op7_byte_bpe(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(texts)
    for r in got:
        ids = np.array(enc.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_bpe_edits():
    own = bpe.PrefixBpe(bpe.load_ranks(queries.RANKS), public_tokenizers.PATTERN)
    t = bpe.PrefixText(own, b"international")
    t.append(b"isation")
    assert t.ids() == own.merged(b"internationalisation")
    t.replace(5, 8, b"xyz")
    assert t.ids() == own.merged(t.raw)
    t.replace(3, 9, b"")
    assert t.ids() == own.merged(t.raw)
    with pytest.raises(ValueError, match="no token for the byte"):
        bpe.PrefixBpe({b"a": 0, b"b": 1, b"ab": 2}, r"\w+")


def test_bpe_rows(spark):
    rows = [(1, None), (2, "ab é"), (2, "ab é"), (3, "x" * 5000), (4, "")]
    got = bpe.encode_decode(frame(spark, rows).withColumn("ids", F.lit(1)), queries.RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id, bytes(r.decoded)) for r in got) == [(i, (t or "").encode()) for i, t in rows]
    assert [r.n_tokens for r in got if r.doc_id in (1, 4)] == [0, 0]
    assert bpe.encode_decode(frame(spark, rows).limit(0), queries.RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<p>a<p>b &amp; c", "a\nb & c"),
        ('<body><nav><a href=x>menu</a></nav><article><h1>T</h1><p>x  <b>y</b>\n z</p><script>var p="</p>"</script></article><footer>f</footer>', "T\nx y z"),
        ('<body><div class="ad">buy</div><div class="content"><p>first long paragraph, with words.</p><p>second one is long, too.</p></div><div id="comments"><p>nice text, thank you very much indeed, really</p></div><form>mail <input></form>', "first long paragraph, with words.\nsecond one is long, too."),
    ],
)
def test_html(page, want):
    assert html_text.main_text(page) == want


LONG = " ".join(["words of a long paragraph, which go on and on,"] * 6)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        # marks inside the article: text and headings stay, links and scraps go
        (f'<article><div class="entry-header"><h1>Title</h1></div><p>{LONG}</p><h2 id="related-work">Related work</h2><p id="share">short</p><section id="survey-results"><p>{LONG} A</p></section><div class="share">Share it</div><div class="related"><a href=x>one other page of ours</a><a href=y>another one</a></div></article>', f"Title\n{LONG}\nRelated work\nshort\n{LONG} A"),
        # a mark within a marked part that stays
        (f'<main><p>{LONG}</p><div id="notice-of-rights"><p>{LONG} B</p><div class="social">like</div></div></main>', f"{LONG}\n{LONG} B"),
        # marks on nested parts that stay
        (f'<main><p>{LONG}</p><section id="survey-results"><div class="survey"><p>{LONG} I</p></div></section></main>', f"{LONG}\n{LONG} I"),
        (f'<body><p>menu</p><div class="widget"><div class="widget-content"><p>{LONG}</p><p>{LONG} K</p></div></div></body>', f"{LONG}\n{LONG} K"),
        # all of the page in a marked part
        (f'<body><p>menu</p><div class="widget"><p>{LONG}</p><p>{LONG} C</p></div></body>', f"{LONG}\n{LONG} C"),
        # without an article: text in the parent itself, with inline elements, in page order
        (f'<body><div>{LONG} <b>bold</b> D<div><p>{LONG} E</p><p>{LONG} F</p><p>{LONG} G</p></div><em>{LONG}</em> H</div><div><a href=x>{LONG}</a></div></body>', f"{LONG} bold D\n{LONG} E\n{LONG} F\n{LONG} G\n{LONG} H"),
    ],
)
def test_html_marks_and_loose_text(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<body class="no-sidebar"><div class="wrap no-sidebar"><p>{LONG}</p><p>{LONG} A</p></div></body>', f"{LONG}\n{LONG} A"),
        (f'<body><div id="social-sciences"><p>{LONG}</p><p>{LONG} B</p></div></body>', f"{LONG}\n{LONG} B"),
        # all of the page in a form; a form beside the text
        (f'<body><form action="x"><div><p>{LONG}</p><p>{LONG} C</p></div></form></body>', f"{LONG}\n{LONG} C"),
        (f"<body><main><p>{LONG}</p><form>{LONG}<input></form><p>{LONG} D</p></main></body>", f"{LONG}\n{LONG} D"),
        # readers' comments as articles, beside the article and in it
        (f'<body><article><h1>T</h1><p>{LONG}</p><p>{LONG} E</p></article><article class="comment"><p>{LONG}</p></article></body>', f"T\n{LONG}\n{LONG} E"),
        (f'<body><main><article><p>{LONG}</p><p>{LONG} F</p></article><section id="comments-area"><article class="comment-body"><p>{LONG}</p></article></section></main></body>', f"{LONG}\n{LONG} F"),
        ("<body>" + "<div>" * 3000 + f"<p>{LONG}</p>" + "</div>" * 3000, LONG),
        (f"<body><p>{LONG}</p>" + "<a " * 20_000, LONG),
        (f"<body><p>{LONG}</p>" + '<a href="x' * 20_000, LONG),
        (f"<body><article><p>{LONG} 1 < 2 <3 &lt; 4</p></article>", f"{LONG} 1 < 2 <3 < 4"),
    ],
)
def test_html_layouts_and_broken_tags(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        # comments that hold most of the page, in the article and beside it
        (f'<body><article><p>{LONG} M</p><section class="comments"><p>{LONG}</p><p>{LONG}</p></section></article></body>', f"{LONG} M"),
        (f'<body><article><p>short article, all of it.</p></article><div id="comments"><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div></body>', "short article, all of it."),
        (f'<body><div><p>{LONG} N</p></div><form><p>{LONG}</p><p>{LONG}</p></form></body>', f"{LONG} N"),
        (f'<body><form><div class="comments"><p>{LONG}</p></div><p>{LONG} O</p></form></body>', f"{LONG} O"),
        # a sign-up and an advert within the article; a part of it that only has such a word
        (f'<body><article><p>{LONG} P</p><div class="newsletter-signup"><h3>Stay with us</h3><p>Get all of our long letters every day, for free, in your mail.</p></div><div class="ad-slot">Buy this now, it is cheap and good, and it is yours today.</div><section id="cookies-explained"><p>{LONG}</p></section><p>{LONG} Q</p></article></body>', f"{LONG} P\n{LONG}\n{LONG} Q"),
    ],
)
def test_html_comments_forms_and_parts_beside_the_text(page, want):
    assert html_text.main_text(page) == want


def test_html_stray_tags_take_linear_time():
    began = time.perf_counter()
    for tags in ("<i>" * 10_000 + "</b>" * 10_000, "<i>" * 10_000 + "<hr>" * 10_000, "<i>" * 10_000 + "<header></header>" * 10_000):
        assert LONG in html_text.main_text(f"<body><article><p>{LONG}</p>{tags}</article>")
    assert time.perf_counter() - began < 3


class PlainArticle(HTMLParser):
    """The blocks of the article of a page, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = 0, [[]]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in ("article", "h1", "p"):
            self.blocks.append([])
        elif tag == "br":
            self.blocks[-1].append(" ")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in ("article", "h1", "p"):
            self.blocks.append([])

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1].append(data)


def test_html_query_over_all_pages(spark):
    """All pages, as they are and with nothing that names the article."""
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    want = {}
    for i, page in pages.items():
        p = PlainArticle()
        p.feed(page)
        p.close()
        want[i] = "\n".join(t for b in p.blocks if (t := " ".join("".join(b).split())))
    got = queries.op8_html_text(spark, "/root/testdata/sf0.01").collect()
    assert {r.page_id: (r.text, r.n_chars) for r in got} == {i: (t, len(t)) for i, t in want.items()}
    bare = {i: html_text.main_text(page.replace("<article>", "<div>").replace("</article>", "</div>")) for i, page in pages.items()}
    # by densities alone: nothing but article text, and all of it but for some pages of two or three short blocks
    assert np.mean([bare[i] == want[i] for i in want]) > 0.93
    assert all(set(bare[i].split("\n")) <= set(want[i].split("\n")) for i in want)


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (2, "u", "<article><p>é</p></article>", "x")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(df).collect()) == [(1, "", 0), (2, "é", 1)]


def embeddings(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 8))
    rows = [(i, [float(v) for v in x[i % 20] + (0.15 * x[i] if i >= 20 else 0)]) for i in range(60)]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, [0.0] * 8), (103, None), (104, [1.0, None] + [0.0] * 6), (105, [float("nan")] * 8), (106, [2 * v for v in rows[0][1]])]
    return rows, spark.createDataFrame([(i, v, 3, 1) for i, v in rows], "vec_id long, embedding array<float>, label int, id int").repartition(3)


def usable(rows):
    return {i: np.array(np.float32(v), float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}


def test_embedding_dedup(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", 16)
    monkeypatch.setattr(vectors, "BLOCK", 8)
    rows, df = embeddings(spark)
    v = usable(rows)
    linked = [(a, b) for a in v for b in v if a != b and v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b]) >= 0.9]
    low = closed([i for i, _ in rows], linked)
    got = vectors.embedding_dedup(df).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (sum(a == i for a, _ in linked), low[i], low[i] == i) for i, _ in rows}
    assert vectors.embedding_dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("k", [3, 500])
def test_vp_search(spark, monkeypatch, k):
    monkeypatch.setattr(vectors, "SHARD", 16)
    rows, df = embeddings(spark)
    v = usable(rows)
    got = vectors.vp_search(df, F.col("vec_id") % 20 == 0, k=k).collect()
    want = {}
    for q in v:
        if q % 20 == 0:
            want[q] = [i for _, i in sorted((-round(float((v[q] * v[i]).sum()), 10), i) for i in v if i != q)[:k]]
    mine = {q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in want}
    assert mine == want
    assert vectors.vp_search(df.limit(0), F.lit(True)).count() == 0


def test_vp_tree_recall():
    x = np.random.default_rng(0).normal(size=(2000, 6))
    ids = np.arange(len(x))
    exact = np.argsort(-(x[:20] @ x.T), axis=1)

    def nearest(factor):
        found = vectors.TopProducts(ids, x, ids[:20], x[:20], 10, np.full(20, -np.inf))
        tree = vectors.VpTree(found.tree_rows(), leaf=32)
        tree.search(found.tree_queries(), found, factor)
        return found.vec.tolist()

    want = [[i for i in r if i != q][:10] for q, r in enumerate(exact.tolist())]
    assert nearest(1.0) == want
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(nearest(1.5), want, strict=True)]) > 0.7


def hard_vectors():
    """Tables on which scores tie, lengths differ by far, or components are extreme."""
    rng = np.random.default_rng(9)
    yield "one-hot", {i: np.eye(64)[i] for i in range(64)}
    yield "one long", {i: rng.normal(size=16) * (1e8 if i == 7 else 1) for i in range(400)}
    yield "scales", {i: rng.normal(size=8) * 10.0 ** (i % 9 * 20 - 80) for i in range(120)}
    yield "signs", {i: np.sign(rng.normal(size=5)) for i in range(300)}


@pytest.mark.parametrize(("name", "table"), list(hard_vectors()))
def test_vp_search_is_exact(spark, monkeypatch, name, table):
    monkeypatch.setattr(vectors, "SHARD", 50)
    monkeypatch.setattr(vectors, "QUERIES", 8)
    monkeypatch.setattr(vectors, "FIRST", 32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in table.items()], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in vectors.vp_search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert len(got) == sum(i % 20 == 0 for i in table)
    for q, own in got.items():
        score = {i: float((table[q] * v).sum()) for i, v in table.items() if i != q}
        want = sorted(score, key=lambda i: (-score[i], i))[:20]
        assert [own[k + 1] for k in range(len(want))] == [(i, score[i]) for i in want]


def test_embedding_dedup_planted_links(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", 100)
    monkeypatch.setattr(vectors, "BLOCK", 64)
    rng = np.random.default_rng(3)
    x = vectors.unit(rng.normal(size=(2000, 64)))
    for i in range(1000, 2000):  # near an earlier one, on both sides of the threshold
        z = rng.normal(size=64)
        c = rng.uniform(0.85, 0.99)
        base = x[i - 1000 if i % 10 else 5]
        z -= (z @ base) * base
        x[i] = c * base + (1 - c * c) ** 0.5 * z / np.linalg.norm(z)
    x *= 10.0 ** rng.integers(-30, 200, size=(2000, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    u = vectors.unit(x)
    near = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    got = {r.vec_id: r for r in vectors.embedding_dedup(df).collect()}
    links = np.array([got[i].n_links for i in range(2000)])
    assert (links <= near.sum(axis=1)).all() and links.sum() >= 0.98 * near.sum() > 1000
    low = closed(list(range(2000)), np.argwhere(near).tolist())
    assert np.mean([got[i].component_id == low[i] for i in range(2000)]) > 0.98


def test_packing(spark):
    rows = [(i, n) for i, n in enumerate([None, 0, 1, 5, 9, 10, 10, 23, 7, 3, 3])]
    df = spark.createDataFrame(rows, "doc_id long, n long")
    got = packing.pack(df, "doc_id", F.col("n"), permitted=(4, 10), group_items=4).collect()
    assert {i: sum(r.length for r in got if r.doc_id == i) for i, _ in rows} == {i: n or 0 for i, n in rows}
    for b in {r.bin_id for r in got if r.bin_id is not None}:
        own = sorted((r.bin_offset, r.length, r.bin_length) for r in got if r.bin_id == b)
        end = 0
        for at, n, size in own:
            assert at == end and n > 0
            end += n
        assert end <= size == (4 if end <= 4 else 10)
    assert packing.best_fit([6, 5, 4, 3], (10,), 1)[0] == [0, 1, 0, 1]
    # a short bin where nothing fills a long one, a long one where it does
    assert packing.best_fit([600], (1024, 8192))[2] == [1024] and packing.best_fit([600, 400], (512, 1024, 8192), 200)[2] == [1024]
    assert packing.pack(df.limit(0), "doc_id", F.col("n")).count() == 0
    twice = packing.pack(df.where("doc_id = 7").union(df.where("doc_id = 7")), "doc_id", F.col("n"), permitted=(4, 10)).collect()
    assert sorted(r.length for r in twice) == [3, 3, 10, 10, 10, 10]


def test_packing_query_in_several_groups(spark):
    from test_pipeline import packed

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    got = packing.pack(docs, "doc_id", queries.n_words(F.col("text")), group_items=60).collect()
    n = {i: len(WORD.findall(t)) for i, t in texts.items()}
    assert {i: sum(r.length for r in got if r.doc_id == i) for i in n} == n
    groups = {}
    for r in got:
        if r.bin_id is not None:
            groups.setdefault(r.bin_id >> 32, []).append(r)
    assert len(groups) > 2
    for rows in groups.values():
        bins = {}
        for r in rows:
            bins.setdefault((r.bin_id, r.bin_length), []).append(r.length)
        # whole documents only, so that the plain version packs the same pieces
        if all(r.piece == 0 and n[r.doc_id] == r.length for r in rows):
            assert Counter((tuple(sorted(v)), k[1]) for k, v in bins.items()) == packed([(r.doc_id, texts[r.doc_id]) for r in rows], queries.LENGTHS)
    one = {r.doc_id: r for r in queries.op10_best_fit(spark, "/root/testdata/sf0.001").collect() if r.piece == 0}
    assert set(one) == set(texts)


def test_sharding(spark):
    rows = [(i, 10 + i % 7) for i in range(300)] + [(7, 11), (None, 3), (999, 500)]
    out = sharding.extendible_shards(spark.createDataFrame(rows, "doc_id long, n long"), "doc_id", F.col("n"), limit=200).collect()
    assert len(out) == len(rows)
    size = {}
    for r in out:
        size[r.shard] = size.get(r.shard, 0) + r.n_bytes
    assert all(n <= 200 for s, n in size.items() if not any(r.oversize for r in out if r.shard == s))
    assert {r.doc_id for r in out if r.oversize} == {999}
    names = sorted(size)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))
    for s in names:  # no bucket split that fitted
        if s:
            assert sum(n for t, n in size.items() if t.startswith(s[:-1])) > 200
    none = spark.createDataFrame(rows, "doc_id long, n long").limit(0)
    assert sharding.extendible_shards(none, "doc_id", F.col("n"), limit=10).count() == 0
    odd = spark.createDataFrame([(1, None), (2, 5)], "doc_id long, shard long").withColumn("prefix", F.lit("p"))
    assert sorted((r.doc_id, r.n_bytes) for r in sharding.extendible_shards(odd, "doc_id", F.col("shard"), limit=10).collect()) == [(1, 0), (2, 5)]
    assert len({r.shard for r in sharding.extendible_shards(spark.createDataFrame(rows[:300], "doc_id long, n long"), "doc_id", F.col("n"), limit=10**9).collect()}) == 1


def test_licenses(spark):
    rows = [(1, None), (2, "some prose here"), (3, "prose\nLicensed under the APACHE license, version 2.0\nmore"), (4, "Released under the MIT License.\nLicensed under CC BY-NC 4.0."), (5, "")]
    got = {r.doc_id: (r.license, r.n_licenses) for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    assert got[1] == got[2] == got[5] == (None, 0) and got[3] == ("Apache-2.0", 1) and got[4][1] == 2


def test_licenses_in_running_text():
    scan = licenses.Matcher().scan
    named = lambda text: [n for n, _ in scan(text)]
    wrapped = lambda text, width: "\n".join(" * " + " ".join(text.split()[i : i + width]) for i in range(0, len(text.split()), width))
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the 'Software'), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: * Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. * Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    third = " * Neither the name of Example Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    for text, want in ((mit, "MIT"), (gpl, "GPL-2.0"), (gpl.replace("version 2", "version 3"), "GPL-3.0"), (gpl.replace("GNU", "GNU Affero").replace("version 2", "version 3"), "AGPL-3.0"), (bsd, "BSD-2-Clause"), (bsd + third, "BSD-3-Clause")):
        assert named(text) == named(wrapped(text, 9)) == named(f"some prose before it {text} and some prose after it") == [want]
    assert scan("we say here: Released under the MIT License. and five more words follow") == [("MIT", 1.0)]
    assert named("this work is licensed under no terms, and the license of the software is not known") == []


def test_licenses_against_every_run():
    """Every run of a text's words with every template, without bounds."""
    rng = random.Random(4)
    templates = licenses.TEMPLATES[:5] + licenses.TEMPLATES[6:8] + licenses.TEMPLATES[9:16]
    matcher = licenses.Matcher(templates, 0.7)
    vocabulary = sorted({w for _, t in templates for w in licenses._WORD.findall(t.lower())})
    for _ in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            own = [w for w in licenses._WORD.findall(rng.choice(templates)[1].lower()) if rng.random() < 0.95]
            at = rng.randrange(len(words) + 1)
            words[at:at] = own
        want = set()
        for i, (_, text) in enumerate(templates):
            t = licenses.bigrams(text)
            dices = [2 * len(b & t) / (len(b) + len(t)) for s in range(len(words)) for e in range(s + 1, len(words) + 1) if (b := licenses.bigrams(" ".join(words[s:e])))]
            if max(dices, default=0) >= 0.7:
                want.add((i, max(dices)))
        hits = {i: [k for k in range(len(words) - 1) if (words[k], words[k + 1]) in matcher.sets[i]] for i in range(len(templates))}
        assert {(i, max(r[0] for r in runs)) for i in hits if (runs := matcher.runs(words, i, hits[i]))} == want


def test_digest(spark):
    rows = corpus(4)
    want = {i: hashlib.sha256(x[2].encode()).hexdigest() for i, x in brute_cut(rows, 13).items()}
    got = suffix_dedup.suffix_dedup(frame(spark, rows)).select("doc_id", F.sha2("kept_text", 256).alias("s")).collect()
    assert {r.doc_id: r.s for r in got} == want
