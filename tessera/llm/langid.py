"""Language identification by the nearest of several centroids for each language.

A text becomes a vector of byte n-gram counts, hashed into DIMS slots, weighted by
TF-IDF and scaled to unit length.  The vectors of each language are clustered by
spherical k-means; a text gets the language of the centroid of largest cosine, and is
rejected if that cosine is below what texts of that language and of its length reach, by
a margin.

Fitting uses at most ``sample`` texts of each language (a documented bound); every
text is scored whole, in one pass without a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .textkit import SLICE, texts_of

DIMS = 4096
UNKNOWN = "und"
#: Share of a language's rows that a centroid has at least.
LEAST = 0.05
#: Numbers of n-grams for which floors are set, and the quantile of cosines they are set from.
SIZES = 2 ** np.arange(3, 15)
QUANTILE = 0.01
_LETTER = regex.compile(r"\p{L}")
_PLAIN = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def count_matrix(texts: list[str]) -> np.ndarray:
    """Counts of 2- and 3-byte grams of the lower-cased texts, a row for each text."""
    out = np.zeros((len(texts), DIMS), np.float32)
    for row, text in enumerate(texts):
        raw = (" " + text + " ").lower().encode("utf-8", "surrogatepass").translate(_PLAIN)
        for at in range(0, len(raw), 4 * SLICE):
            b = np.frombuffer(raw[at : at + 4 * SLICE + 2], np.uint8).astype(np.uint32)
            two = b[:-1] << np.uint32(8) | b[1:]
            three = two[:-1] << np.uint32(8) | b[2:]
            two = two[: 4 * SLICE]  # the next slice has the gram at the border
            for gram, salt in ((two[two != 0x2020], 0x9E3779B1), (three, 0x85EBCA6B)):
                slot = (gram + np.uint32(1)) * np.uint32(salt) >> np.uint32(20)
                out[row] += np.bincount(slot, minlength=DIMS)[:DIMS]
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """At most ``k`` unit centroids of unit rows, each of a ``LEAST`` share of the rows.

    Starts as k-means++ does; the smallest cluster below the share goes, and its rows move
    to the others, until none is.
    """
    rng = np.random.default_rng(seed)
    picked = [int(rng.integers(len(x)))]
    near = x @ x[picked[0]]
    for _ in range(min(k, len(x)) - 1):
        weight = np.maximum(1 - near.astype(np.float64), 0) ** 2
        if weight.sum() <= 0:
            break
        picked.append(int(rng.choice(len(x), p=weight / weight.sum())))
        near = np.maximum(near, x @ x[picked[-1]])
    c = x[picked]
    while True:
        for _ in range(rounds):
            best = np.argmax(x @ c.T, axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, best, x)
            moved = unit(sums)
            c = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, moved, c)
        own = np.bincount(np.argmax(x @ c.T, axis=1), minlength=len(c))
        if len(c) == 1 or own.min() >= LEAST * len(x):
            return c
        c = np.delete(c, own.argmin(), axis=0)


def length_floors(counts: np.ndarray, idf: np.ndarray, centroids: np.ndarray, slack: float, seed: int = 7) -> np.ndarray:
    """Of each of ``SIZES``, ``slack`` times a low quantile of the best cosines of texts of that size.

    Texts of a size are those that have as many n-grams, thinned to it at random.
    """
    rng = np.random.default_rng(seed)
    total = counts.sum(1, dtype=np.int64)
    out = []
    for size in SIZES:
        some = np.flatnonzero(total >= size)[:200]
        if not len(some):
            break
        thin = rng.binomial(counts[some], (size / total[some])[:, None])
        cosine = (unit(np.log1p(thin.astype(np.float32)) * idf) @ centroids.T).max(1)
        out.append(slack * float(np.quantile(cosine, QUANTILE)))
    # no text is as long: as for the longest there are, and none at all rejects nothing
    return np.array(out + [out[-1] if out else 0.0] * (len(SIZES) - len(out)))


@dataclass
class LanguageModel:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    floors: np.ndarray  # of each centroid and each of SIZES: cosine below which a text is rejected
    idf: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        counts = count_matrix(texts)
        cosine = unit(np.log1p(counts) * self.idf) @ self.centroids.T
        best = np.argmax(cosine, axis=1)
        score = cosine[np.arange(len(texts)), best].astype(np.float64)
        size = np.log2(np.maximum(counts.sum(1), 1))
        floor = np.array([np.interp(n, np.log2(SIZES), self.floors[i]) for n, i in zip(size, best, strict=True)])
        return [self.languages[i] for i in best], np.clip(score, 0.0, 1.0), score < floor


def _sample_of(table: pa.Table, sample: int) -> np.ndarray:
    """Count vectors of the rows of smallest key, as they were packed by ``fit_language_model``."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("key", "slots", "counts")), strict=True))[:sample]
    out = np.zeros((len(rows), DIMS), np.uint32)
    for row, (_, slots, counts) in zip(out, rows, strict=True):
        row[np.frombuffer(slots, np.uint16)] = np.frombuffer(counts, np.uint32)
    return out


def fit_language_model(labelled: DataFrame, text_col: str, lang_col: str, key: Column, *, sample: int = 1000, centroids: int = 3, slack: float = 0.5) -> LanguageModel:
    """``labelled``: rows to learn from; ``key`` picks the sample and is no feature.

    The ``sample`` rows of each language that have the smallest key hashes, of a share of rows that holds
    1.3 times as many, are taken as count vectors; equal keys go by their counts.  Each language is clustered in a task of its own; only
    document frequencies, centroids and floors reach the driver.  A text's floor is ``slack`` times the
    hundredth of the cosines that texts of the language have at its length.  Rows without text, language or
    any letter are left out; repeated rows count each; no rows at all give a model that rejects everything.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(key).alias("key"))
    rows = rows.where(F.col("text").rlike(r"\p{L}"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return LanguageModel([], np.zeros((0, DIMS)), np.zeros((0, len(SIZES))), np.ones(DIMS))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 1.3 * sample / n))])
    rows = rows.where(F.pmod("key", F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)

    def vectors(batches):
        for batch in batches:
            slots, counts = [], []
            for t in texts_of(batch, 1):
                row = count_matrix([t])[0]
                some = np.flatnonzero(row)
                slots.append(some.astype(np.uint16).tobytes())
                counts.append(np.minimum(row[some], 0xFFFF_FFFF).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(slots, pa.binary()), pa.array(counts, pa.binary())], ["lang", "key", "slots", "counts"])

    def frequencies(table: pa.Table) -> pa.Table:
        x = _sample_of(table, sample)
        return pa.table({"n": pa.array([len(x)], pa.int64()), "df": pa.array([(x > 0).sum(0).astype(np.int64).tobytes()], pa.binary())})

    scratch = Scratch(labelled.sparkSession, "langid")
    taken = scratch.put(rows.select("lang", "text", "key").mapInArrow(vectors, "lang string, key long, slots binary, counts binary"), "sample")
    df, n = np.zeros(DIMS, np.int64), 0
    for r in taken.groupBy("lang").applyInArrow(frequencies, "n long, df binary").collect():
        df, n = df + np.frombuffer(r.df, np.int64), n + r.n
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    def cluster(table: pa.Table) -> pa.Table:
        raw = _sample_of(table, sample)
        c = spherical_kmeans(unit(np.log1p(raw.astype(np.float32)) * idf), centroids)
        floors = length_floors(raw, idf, c, slack)
        return pa.table({"lang": [table.column("lang")[0].as_py()], "places": pa.array([c.astype(np.float32).tobytes()], pa.binary()), "floors": pa.array([floors.astype(np.float64).tobytes()], pa.binary())}, pa.schema([("lang", pa.string()), ("places", pa.binary()), ("floors", pa.binary())]))

    names, places, floors = [], [], []
    for r in sorted(taken.groupBy("lang").applyInArrow(cluster, "lang string, places binary, floors binary").collect()):
        c = np.frombuffer(r.places, np.float32).reshape(-1, DIMS)
        names += [r.lang] * len(c)
        places.append(c)
        floors += [np.frombuffer(r.floors, np.float64)] * len(c)
    scratch.drop("sample")
    return LanguageModel(names, np.concatenate(places), np.array(floors), idf)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """Adds a language, a score and whether it is rejected to the rows, replacing columns of those ``names``.

    A text that is null or has no letter gets ``und``, score 0, and is rejected.  A text is
    scored whole, whatever its length; equal texts get equal results; of centroids equally near the first
    counts, in the order of the languages' names.  An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    mine = {n.lower() for n in names}
    keep = [c for c in docs.columns if c.lower() not in mine]
    at = keep.index(text_col)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def predict(batches):
        for batch in batches:
            texts = texts_of(batch, at)
            lang, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            some = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
            for a in range(0, len(some), 256):
                part = some[a : a + 256]
                best, s, r = shared.value.predict([texts[i] for i in part])
                for i, name in zip(part, best, strict=True):
                    lang[i] = name
                score[part], rejected[part] = s, r
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang), pa.array(score), pa.array(rejected)], [*keep, *names])

    return docs.select(*keep).mapInArrow(predict, f"{fields}, {names[0]} string, {names[1]} double, {names[2]} boolean")
