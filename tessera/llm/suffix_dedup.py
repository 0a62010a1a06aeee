"""Removal of repeated passages with prefix-partitioned suffix trees over words.

A suffix is a place of a text that has ``window - 1`` words after it; its tree is cut off below
depth ``window``.  Suffixes that could agree must meet, so each goes to the partition of the rarest word of
its window (by a count sketch of fixed size, then by a hash).  Neighbouring suffixes mostly
have that word in common and travel as one segment of words, so a suffix costs about as
much as one hash would.

In a partition, prefixes of variable length split the suffixes into groups that fit in memory: a group
that is too large is split by one word more.  The subtree of a group is built from the
top: suffixes are sorted by their next words, suffixes that agree with no other are leaves and
end there, and what is left at depth ``window`` are the deep internal nodes.  The
smallest document below such a node owns the passage.  Nodes of adjoining suffixes together
are the maximal repeats.

A task settles the suffixes that repeat within what it has read before it sends
anything: only those of the smallest document go on.  A passage of very many
copies therefore reaches its partition once for each batch, not once for each copy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .textkit import U, corpus_sketch, mix, sequences, texts_of, word_hashes

#: Suffixes that a task packs at once, and those of a partition on average.
BATCH, PARTITION = 1 << 19, 1 << 20
#: Words sorted by at once, as 16 bits each of two halves.
STEP = 4


def fingerprint(h: np.ndarray) -> int:
    """Of a text's words in order."""
    return int((np.add.reduce(mix(h + np.arange(len(h), dtype=np.uint64) * U(0x9E3779B97F4A7C15))) ^ U(len(h))).astype(np.int64))


def least_of_windows(score: np.ndarray, window: int) -> np.ndarray:
    """The least score of each run of ``window`` words."""
    low, have = score, 1
    while have < window:
        step = min(have, window - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return low


def repeats_within(words: np.ndarray, at: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """Of the suffixes at places ``at`` of ``words``: those that a smaller document has among them too."""
    full = sequences(words, window)[at]
    order = np.argsort(full, kind="stable")
    first = np.flatnonzero(np.append(True, full[order][1:] != full[order][:-1]))
    runs = np.diff(np.append(first, len(order)))
    order = order[np.repeat(runs > 1, runs)]
    runs = runs[runs > 1]
    known = np.zeros(len(at), bool)
    if not len(order):
        return known
    first = np.append(0, np.cumsum(runs)[:-1])
    low = np.repeat(np.minimum.reduceat(doc[order], first), runs)
    # the smallest document's first place in the run, for comparing words and not only their hash
    lead = np.flatnonzero(doc[order] == low)
    owner = np.repeat(order[lead[np.searchsorted(lead, first)]], runs)
    same = doc[order] > low
    for k in range(window):
        same &= words[at[order] + k] == words[at[owner] + k]
    known[order] = same
    return known


def prefix_groups(words: np.ndarray, at: np.ndarray, rows: np.ndarray, depth: int, window: int, limit: int):
    """Splits suffixes by prefixes of as many words as it takes until a group has at most ``limit``, or all words are used."""
    if len(rows) <= limit or depth == window:
        if len(rows) > 1:
            yield rows
        return
    key = mix(words[at[rows] + depth].astype(np.uint64) + U(depth)) % U(2 * -(-len(rows) // limit))
    order = np.argsort(key.astype(np.uint16 if key.max(initial=0) < 1 << 16 else np.int64), kind="stable")
    cuts = np.flatnonzero(np.diff(key[order])) + 1
    for part in np.split(rows[order], cuts):
        yield from prefix_groups(words, at, part, depth + 1, window, limit)


def deep_nodes(words: np.ndarray, at: np.ndarray, rows: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The subtree of one group, from the top: suffixes that agree with others on all ``window`` words, and their nodes."""
    node = np.zeros(len(rows), np.int64)
    for depth in range(0, window, STEP):
        used = range(depth, min(depth + STEP, window))
        for shift in (0, 16):
            if len(rows) < 2:
                return rows[:0], node[:0]
            key = np.zeros(len(rows), np.uint64)
            for k in used:
                key = key << U(16) | (words[at[rows] + k].astype(np.uint64) >> U(shift) & U(0xFFFF))
            order = np.lexsort((key, node)) if node[-1] else np.argsort(key, kind="stable")
            key, node, rows = key[order], node[order], rows[order]
            first = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
            node = np.cumsum(first)
            inner = ~(first & np.append(first[1:], True))  # a branch of one suffix is a leaf
            rows, node = rows[inner], node[inner]
    return rows, node


def owned_elsewhere(words: np.ndarray, at: np.ndarray, doc: np.ndarray, window: int, limit: int) -> np.ndarray:
    """The suffixes below a deep node that a smaller document is below, too."""
    hits = [np.empty(0, np.int64)]
    for group in prefix_groups(words, at, np.arange(len(at)), 0, window, limit):
        rows, node = deep_nodes(words, at, group, window)
        if len(rows):
            first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            low = np.repeat(np.minimum.reduceat(doc[rows], first), np.diff(np.append(first, len(rows))))
            hits.append(rows[doc[rows] > low])
    return np.concatenate(hits)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers of all ranges [start, start + length), one range after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def repeated_windows(own: DataFrame, scratch: Scratch, window: int, group_limit: int) -> DataFrame:
    """(id, print, starts): the window starts of a text that also start in a text of a smaller id."""
    spark = own.sparkSession

    def make(h):
        return h if len(h) >= window else h[:0]

    make.lower = False
    sketch = corpus_sketch(own.select("text"), make, bits=18)
    total = int(sketch.table[0].sum(dtype=np.uint64))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION))
    shared = spark.sparkContext.broadcast(sketch)
    columns = ["part", "words", "counts", "starts", "ids", "prints"]

    def rows_of(held):
        """The segments of one batch of texts [(id, words)], for the partitions, and what is settled already."""
        size = np.array([len(h) for _, h in held])
        counts = size - window + 1
        words = np.concatenate([h for _, h in held])
        ids = np.array([i for i, _ in held], np.int64)
        prints = np.array([fingerprint(h) for _, h in held], np.int64)
        base = np.cumsum(size) - size
        at = _ranges(base, counts)
        text = np.repeat(np.arange(len(held)), counts)
        known = repeats_within(words, at, ids[text], window)
        rank = np.minimum(np.log2(shared.value.of(words).astype(np.float64) + 1) * 2, 63).astype(np.uint64)
        least = least_of_windows(rank << U(58) | mix(words) >> U(6), window)[at]
        send = np.flatnonzero(~known)
        new = np.ones(len(send), bool)
        new[1:] = (send[1:] != send[:-1] + 1) | (text[send[1:]] != text[send[:-1]]) | (least[send[1:]] != least[send[:-1]])
        first = np.flatnonzero(new)
        lengths, first = np.diff(np.append(first, len(send))), send[first]
        part = (mix(least[first]) % U(parts)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        first, lengths, part = first[by], lengths[by], part[by]
        own_words = (words >> U(32)).astype(np.uint32)[_ranges(at[first], lengths + window - 1)]
        ends = np.append(0, np.cumsum(lengths + window - 1))
        cuts = np.searchsorted(part, np.arange(parts + 1))
        start = (at[first] - base[text[first]]).astype(np.uint32)
        for p in np.flatnonzero(cuts[1:] > cuts[:-1]):
            s = slice(cuts[p], cuts[p + 1])
            whose = text[first[s]]
            yield [int(p), own_words[ends[cuts[p]] : ends[cuts[p + 1]]].tobytes(), lengths[s].astype(np.uint32).tobytes(), start[s].tobytes(), ids[whose].tobytes(), prints[whose].tobytes()]
        begin = np.cumsum(counts) - counts
        for i in np.unique(text[known]):
            own_ = np.flatnonzero(known[begin[i] : begin[i] + counts[i]])
            # these are only passed on: dealt by id, so that copies do not meet in one task
            yield [int(mix(ids[i : i + 1].view(np.uint64))[0] % U(parts)), b"", b"", own_.astype(np.uint32).tobytes(), ids[i : i + 1].tobytes(), prints[i : i + 1].tobytes()]

    def spread(batches):
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, h in zip(ids, word_hashes(texts_of(batch, 1)), strict=True):
                if i is not None and len(h) >= window:
                    held.append((i, h))
                    size += len(h)
                if size >= BATCH:
                    yield from packed(rows_of(held))
                    held, size = [], 0
        if held:
            yield from packed(rows_of(held))

    def packed(rows):
        some: list[list] = []
        for r in rows:
            some.append(r)
            if len(some) == 64:
                yield as_batch(some)
                some = []
        if some:
            yield as_batch(some)

    def as_batch(rows):
        kinds = [pa.int32()] + [pa.binary()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], columns)

    def trees(table: pa.Table) -> pa.Table:
        kinds = {"words": np.uint32, "counts": np.uint32, "starts": np.uint32, "ids": np.int64, "prints": np.int64}
        # views of the table's own memory
        rows = list(zip(*([np.frombuffer(x.as_buffer(), k) for x in table.column(c)] for c, k in kinds.items()), strict=True))
        ready = [(np.repeat(ids, len(at)), np.repeat(pr, len(at)), at) for w, _, at, ids, pr in rows if not len(w)]
        rows = [r for r in rows if len(r[0])]
        found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32))
        if rows:
            w, n, begin, d, f = (np.concatenate(x) for x in zip(*rows, strict=True))
            n = n.astype(np.int64)
            rows = table = None
            segment = np.repeat(np.arange(len(n), dtype=np.int32), n)
            at = _ranges(np.cumsum(n + window - 1) - (n + window - 1), n)
            hit = owned_elsewhere(w, at, d[segment], window, group_limit)
            whose = segment[hit]
            found = d[whose], f[whose], begin[whose] + (hit - (np.cumsum(n) - n)[whose]).astype(np.uint32)
            del w, at, segment
        ready = list(zip(*ready, strict=True)) or [(), (), ()]
        docs, f, at = (np.concatenate([x, *y]) for x, y in zip(found, ready, strict=True))
        # answers go back packed by document bucket: a row for each pair of partition and bucket at most
        bucket = (mix(docs.view(np.uint64)) % U(parts)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[by], np.arange(parts + 1))
        used = np.flatnonzero(cuts[1:] > cuts[:-1])
        packs = [[x[by[cuts[b] : cuts[b + 1]]].tobytes() for b in used] for x in (docs, f, at)]
        return pa.Table.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(x, pa.binary()) for x in packs)], ["bucket", "ids", "prints", "starts"])

    def collect(table: pa.Table) -> pa.Table:
        d, f, at = (np.frombuffer(b"".join(table.column(c).to_pylist()), k) for c, k in (("ids", np.int64), ("prints", np.int64), ("starts", np.uint32)))
        by = np.lexsort((at, f, d))
        d, f, at = d[by], f[by], at[by]
        cut = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (f[1:] != f[:-1])))
        starts = [at[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(d)), strict=True)]
        return pa.Table.from_arrays([pa.array(d[cut]), pa.array(f[cut]), pa.array(starts, pa.binary())], ["id", "print", "starts"])

    rows = own.mapInArrow(spread, "part int, words binary, counts binary, starts binary, ids binary, prints binary")
    rows = rows.groupBy("part").applyInArrow(trees, "bucket int, ids binary, prints binary, starts binary")
    rows = rows.groupBy("bucket").applyInArrow(collect, "id long, print long, starts binary")
    hits = scratch.put(rows, "hits")
    del rows
    scratch.release()
    return hits


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 13, group_limit: int = 1 << 18, text_key: bool = False) -> DataFrame:
    """Returns (id_col, n_words, n_removed, kept_text, spans), one row per input row.

    A word is removed if it lies in ``window`` consecutive words that also start in a
    document of a smaller id; windows are judged on the input.  ``kept_text`` joins the
    words that stay by one space; ``spans`` are the removed word ranges [start, end).
    A null text has no words; texts are read whole, whatever their length, and an empty table gives an
    empty result.  Rows of one id never remove words from each other, and
    a row with a null id neither removes nor loses words.  Other columns are not read.
    ``group_limit`` is how many suffixes a subtree is built from at once.
    ``text_key`` adds a column of that name, ``xxhash64`` of the input text.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    hits = repeated_windows(own, scratch, window, group_limit)
    hits = hits.groupBy("id").agg(F.collect_list(F.struct("print", "starts")).alias("hits"))

    def remove(batches):
        for batch in batches:
            n, gone, kept, spans = [], [], [], []
            for text, hit in zip(texts_of(batch, 1), batch.column(2).to_pylist(), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                if hit and len({x["print"] for x in hit}) > 0:
                    own_print = fingerprint(next(word_hashes([text])))
                    edge = np.zeros(len(words) + 1, np.int64)
                    for x in hit:
                        if x["print"] == own_print:
                            at = np.frombuffer(x["starts"], np.uint32)
                            np.add.at(edge, at, 1)
                            np.add.at(edge, at + window, -1)
                    covered = np.cumsum(edge)[:-1] > 0
                    turn = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in turn.reshape(-1, 2)])
                    gone.append(int(covered.sum()))
                    left = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                else:
                    spans.append([])
                    gone.append(0)
                    left = words
                n.append(len(words))
                kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, span), batch.column(3)], ["id", "n_words", "n_removed", "kept_text", "spans", "text_key"])

    out = own.join(hits, "id", "left").select("id", "text", "hits", F.xxhash64("text").alias("text_key")).mapInArrow(remove, "id long, n_words long, n_removed long, kept_text string, spans array<struct<start: int, end: int>>, text_key long")
    return (out if text_key else out.drop("text_key")).withColumnRenamed("id", id_col)
