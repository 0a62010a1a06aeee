"""Runs of words that repeat with a period, found on a harmonic grid.

A run of period p is a stretch whose words p apart are equal; in terms of pairs, the words i and i + p agree
for every i of the stretch less its last p.  A run of at least ``max(least, times * p)`` words has
``max(least, times * p) - p`` such pairs in a row, so a grid of that step has a point among them: over all
periods a harmonic sum of points, n log n for n words.  Points whose two words differ are left out at once.

For all (period, point) pairs of a block of periods, over all texts of a batch, the longest common extensions of
the places i and i + p, forwards and backwards, are found by one binary search on prefix hashes.  Words of the
runs so found are then compared themselves; where they differ, the extension is taken from the words.

If a run's smallest period is q, it is found again at multiples of q and never for other periods (Fine and Wilf),
with equal ends, so the smallest period for given ends is the run's.  Points in a run already known
whose period divides p are left out for the same reason, which keeps long runs cheap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import SLICE, texts_of, word_hashes

#: Words of a batch of texts, and grid points looked at together.
WORDS, POINTS = 1 << 17, 1 << 20
#: A prime below 2^31 and two bases: hashes of 62 bits whose products fit in 64.
PRIME, BASES = (1 << 31) - 1, (1_103_515_245, 1_664_525_013)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1), by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), PRIME)) % np.uint64(PRIME)])
        _powers[base] = have
    return have


class PrefixHashes:
    """Tells whether two stretches of one array of word hashes are equal, for many pairs at once."""

    def __init__(self, words: np.ndarray) -> None:
        self.lanes = []
        for k, base in enumerate(BASES):
            x = (words >> np.uint64(32 * k)) % np.uint64(PRIME)
            power = _power(base, len(words) + 1)
            total = np.zeros(len(words) + 1, np.uint64)
            np.cumsum(x * power[: len(words)] % np.uint64(PRIME), out=total[1:])
            self.lanes.append((total % np.uint64(PRIME), power))

    def equal(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the ``n`` words from ``i`` on equal those from ``j`` on, for i < j."""
        same = np.ones(len(i), bool)
        p = np.uint64(PRIME)
        for total, power in self.lanes:
            a, b = total[i + n] + p - total[i], total[j + n] + p - total[j]
            same &= a % p * power[j - i] % p == b % p
        return same

    def forwards(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from ``i`` and from ``j`` on agree, ``most`` at most."""
        return self._search(most, lambda at, n: self.equal(i[at], j[at], n))

    def backwards(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words before ``i`` and before ``j`` agree, ``most`` at most."""
        return self._search(most, lambda at, n: self.equal(i[at] - n, j[at] - n, n))

    @staticmethod
    def _search(most: np.ndarray, agree) -> np.ndarray:
        low, high = np.zeros(len(most), np.int64), most.astype(np.int64)
        at = np.flatnonzero(low < high)
        while len(at):
            mid = (low[at] + high[at] + 1) >> 1
            yes = agree(at, mid)
            low[at[yes]] = mid[yes]
            high[at[~yes]] = mid[~yes] - 1
            at = at[low[at] < high[at]]
        return low


def _grid(sizes: np.ndarray, begins: np.ndarray, first: int, last: int, least: int, times: int):
    """Blocks of (text, period, place) for all grid points of the periods first ... last - 1."""
    p = np.arange(first, last)
    need = np.maximum(least, times * p)
    text, at = np.nonzero(sizes[:, None] >= need[None, :])
    period, step = p[at], (need - p)[at]
    count = -(-(sizes[text] - period) // step)
    ends = np.cumsum(count)
    a = 0
    while a < len(count):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + POINTS, "right")))
        n = count[a:b]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(text[a:b], n), np.repeat(period[a:b], n), np.repeat(begins[text[a:b]], n) + k * np.repeat(step[a:b], n)
        a = b


def find_runs(words: np.ndarray, sizes: np.ndarray, same_words=None, least: int = 24, times: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of texts whose word hashes follow each other in ``words``, ``sizes`` words each.

    Returns text number, start (in ``words``), length and period, sorted by text, start and period.
    ``same_words(text, i, j, n)`` tells how many of the ``n`` words from i and from j on truly agree before the first that
    does not; without it hashes of words count as the words.
    """
    if times < 2:
        raise ValueError("a run repeats its period at least twice")
    begins = np.cumsum(sizes) - sizes
    hashes = PrefixHashes(words)
    covered, until = np.ones(len(words), np.int64), np.zeros(len(words), np.int64)  # period and end of a run known at a word
    found: dict[tuple[int, int], tuple[int, int]] = {}
    largest, first = int(sizes.max(initial=0)) // times, 1
    wide = np.flatnonzero(sizes >= least)
    while first <= largest:
        last = min(2 * first, first + max(1, POINTS // max(1, len(wide))), largest + 1)
        wide = wide[sizes[wide] >= max(least, times * first)]
        for text, p, i in _grid(sizes[wide], begins[wide], first, last, least, times):
            text = wide[text]
            keep = words[i] == words[i + p]
            keep &= (p % covered[i] != 0) | (i + p >= until[i])
            text, p, i = text[keep], p[keep], i[keep]
            if not len(i):
                continue
            low, high = begins[text], begins[text] + sizes[text]
            back = hashes.backwards(i, i + p, i - low)
            ahead = hashes.forwards(i, i + p, high - i - p)
            long = back + ahead + p >= np.maximum(least, times * p)
            for t, q, s, e, g in zip(*(x[long].tolist() for x in (text, p, i - back, i + p + ahead, i)), strict=True):
                if same_words is not None and (s, e) not in found and same_words(t, s, s + q, e - s - q) < e - s - q:
                    s, e = _by_words(t, q, g, int(begins[t]), int(begins[t] + sizes[t]), same_words)
                    if e - s < max(least, times * q):
                        continue
                if (s, e) not in found or found[s, e][0] > q:
                    found[s, e] = (q, t)
                    covered[s:e], until[s:e] = q, e
        first = last
    runs = sorted((t, s, q, e - s) for (s, e), (q, t) in found.items())
    out = np.array(runs, np.int64).reshape(-1, 4)
    return out[:, 0], out[:, 1], out[:, 3], out[:, 2]


def _by_words(t: int, q: int, g: int, low: int, high: int, same_words) -> tuple[int, int]:
    """The ends of the stretch of period ``q`` around place ``g``, from the words themselves."""
    e = g + same_words(t, g, g + q, high - q - g)
    s = g
    while s > low and same_words(t, s - 1, s - 1 + q, 1):
        s -= 1
    return s, e + q


def _agreeing(texts: list[bytes], begins: np.ndarray):
    """``same_words`` over the texts' own words, split when a text is first asked for."""
    split: dict[int, list[bytes]] = {}

    def same(t: int, i: int, j: int, n: int) -> int:
        w = split.get(t)
        if w is None:
            split[t] = w = texts[t].split()
        i, j = i - int(begins[t]), j - int(begins[t])
        if w[i : i + n] == w[j : j + n]:
            return n
        return next(k for k in range(n) if w[i + k] != w[j + k])

    return same


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [w for w, gone in zip(words, (np.cumsum(edge)[:-1] > 0).tolist(), strict=True) if not gone]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact length / period; of ties the smallest start, then period."""
    best = None
    for r in runs:
        if best is None or (a := r[1] * best[2]) > (b := best[1] * r[2]) or a == b and (r[0], r[2]) < (best[0], best[2]):
            best = r
    return best


def periodic_runs(docs: DataFrame, text_col: str = "text", *, least: int = 24, times: int = 3) -> DataFrame:
    """Adds ``n_words``, ``runs`` (start, length, period of each, by start, then period), ``best`` and ``collapsed``.

    A word is ``[^\\x20\\x09-\\x0D]+``.  A run is a stretch of words with smallest period p, of at least
    ``max(least, times * p)`` words, that no neighbouring word extends.  ``best`` is the run of the greatest exact
    length / period (ties: smallest start, then period), null if there is none.  ``collapsed`` joins by one space the words
    that no run contains after its first period.  A null or empty text has no words, no runs and an empty
    ``collapsed``.  Texts are read whole; one of n words takes time and memory of n log n at most, and long ones
    go through a batch of their own.  Each row is for itself: repeated rows keep theirs, an empty table gives an empty
    result, other columns stay, and input columns of the added names are replaced.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    kinds = [pa.int64(), pa.list_(run), run, pa.string()]
    added = ["n_words", "runs", "best", "collapsed"]
    keep = [c for c in docs.columns if c != text_col and c not in added]
    shown = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").cast("string").alias("t"))
    whole = text_col not in added
    names = shown.columns[: len(keep) + whole]

    def settle(texts: list[str | None]):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        hashed = list(word_hashes(texts))
        sizes = np.array([len(h) for h in hashed], np.int64)
        begins = np.cumsum(sizes) - sizes
        of, start, length, period = find_runs(np.concatenate(hashed), sizes, _agreeing(raw, begins), least, times)
        cuts = np.searchsorted(of, np.arange(len(texts) + 1))
        spans = np.stack([start - begins[of], length, period], axis=1).tolist() if len(of) else []
        for k, text in enumerate(raw):
            runs = [tuple(r) for r in spans[cuts[k] : cuts[k + 1]]]
            yield int(sizes[k]), runs, b" ".join(collapse(text.split(), runs) if runs else text.split()).decode("utf-8", "surrogatepass")

    def named(r):
        return None if r is None else dict(zip(("start", "length", "period"), r, strict=True))

    def work(batches):
        for batch in batches:
            texts = texts_of(batch, batch.num_columns - 1)
            at = 0
            while at < len(texts):
                first, size = at, 0
                while at < len(texts) and (at == first or size + len(texts[at] or "") < 2 * SLICE):
                    size += len(texts[at] or "")
                    at += 1
                done = list(settle(texts[first:at]))
                new = [[n for n, _, _ in done], [[named(r) for r in runs] for _, runs, _ in done], [named(strongest(runs)) for _, runs, _ in done], [c for _, _, c in done]]
                cols = [batch.column(i).slice(first, at - first) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(v, k) for v, k in zip(new, kinds, strict=True))], [*names, *added])

    fields = [f"{c} {shown.schema[c].dataType.simpleString()}" for c in names]
    span = "struct<start: long, length: long, period: long>"
    out = shown.mapInArrow(work, ", ".join([*fields, "n_words long", f"runs array<{span}>", f"best {span}", "collapsed string"]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *([F.col("t").alias(text_col)] if whole else []), *added)
