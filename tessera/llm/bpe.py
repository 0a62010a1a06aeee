"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a byte string exactly one token can end its encoding: the token
``t`` such that the prefix before ``t`` ends in a token ``s`` and the bytes of ``s`` and
``t`` together encode as ``[s, t]``.  The table of last tokens therefore holds the encoding
of every prefix; appending bytes extends the table, and after an edit it is rebuilt only
from the edit on.
"""

from __future__ import annotations

import base64
import sys

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import texts_of


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merged(raw: bytes, ranks: dict[bytes, int], down_to: int = 1) -> list[bytes]:
    """The encoding by its definition: the adjacent pair of lowest rank is joined until none has a rank or ``down_to`` parts are left."""
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while len(parts) > down_to:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], sys.maxsize), i) for i in range(len(parts) - 1))
        if rank == sys.maxsize:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def last_merges(ranks: dict[bytes, int]) -> np.ndarray:
    """For each id, the two tokens that are joined last in its own encoding; for a single byte, -1 twice."""
    out = np.full((max(ranks.values()) + 1, 2), -1, np.int32)
    for raw, i in ranks.items():
        if len(raw) > 1:
            parts = merged(raw, ranks, 2)
            if len(parts) > 2:
                raise ValueError(f"token {i} does not encode as itself")
            out[i] = [ranks[p] for p in parts]
    return out


class PrefixBpe:
    """Encoder and decoder of a rank table whose single bytes are all tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, merges: np.ndarray | None = None) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            self.tokens[i] = raw
        if missing := [i for i in range(256) if bytes([i]) not in ranks]:
            raise ValueError(f"no token for the byte {missing[0]}")
        self.longest = max(map(len, ranks))
        first, second = (last_merges(ranks) if merges is None else merges).T.tolist()
        self.first, self.second = first, second
        #: What tokens begin with, byte by byte; the key -1 holds the token that ends there.
        self._trie: dict[int, dict] = {}
        for raw, i in ranks.items():
            node = self._trie
            for b in raw:
                node = node.setdefault(b, {})
            node[-1] = i
        self._pair: dict[int, bool] = {}
        self._known: dict[str, bytes] = {}

    def merged(self, raw: bytes) -> list[int]:
        return [self.ranks[p] for p in merged(raw, self.ranks)]

    def follows(self, s: int, t: int) -> bool:
        """Whether the bytes of two tokens encode as these two.

        Goes back through the merges beside the border, the latest first: wherever the two tokens that touch
        there would join before either is used up by its own next merge, they do not.
        Of merges of one rank, the left comes first.
        """
        tokens, ranks, first, second = self.tokens, self.ranks, self.first, self.second
        left = right = sys.maxsize
        while True:
            joint = ranks.get(tokens[s] + tokens[t])
            if joint is not None and joint < left and joint <= right:
                return False
            if second[s] >= 0 and (s > t or first[t] < 0):
                left, s = s, second[s]
            elif first[t] >= 0:
                right, t = t, first[t]
            else:
                return True

    def table(self, raw: bytes, last: list[int] | None = None, start: int = 0) -> list[int]:
        """The last token of each prefix 1..len(raw); the first ``start`` entries are taken from ``last``."""
        n = len(raw)
        have = min(start, len(last)) if last else 0
        ends = [-1] + (last[:have] if last else []) + [-1] * (n - have)
        trie, pair = self._trie, self._pair
        for at in range(max(0, have - self.longest), n):
            before, node, end = ends[at] << 32, trie, at
            for byte in raw[at : at + self.longest]:
                node = node.get(byte)
                if node is None:
                    break
                end += 1
                t = node.get(-1)
                if t is None or ends[end] >= 0:
                    continue
                if at:
                    ok = pair.get(before | t)
                    if ok is None:
                        if len(pair) > 2_000_000:
                            pair.clear()
                        ok = pair[before | t] = self.follows(ends[at], t)
                    if not ok:
                        continue
                ends[end] = t
        if n and min(ends[1:]) < 0:
            raise ValueError("a prefix has no last token")
        return ends[1:]

    def walk(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.tokens[out[-1]])
        return out[::-1]

    def encode_piece(self, raw: bytes) -> list[int]:
        whole = self.ranks.get(raw)
        return [whole] if whole is not None else self.walk(self.table(raw))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        known, out = self._known, []
        for piece in self.pattern.findall(text):
            ids = known.get(piece)
            if ids is None:
                ids = np.array(self.encode_piece(piece.encode("utf-8", "replace")), "<u4").tobytes()
                if len(piece) <= 64:
                    if len(known) > 400_000:
                        known.clear()
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class PrefixText:
    """One piece of text under edits: appends extend the table, other edits rebuild it from the edit on."""

    def __init__(self, bpe: PrefixBpe, raw: bytes = b"") -> None:
        self.bpe, self.raw, self.last = bpe, raw, bpe.table(raw)

    def append(self, raw: bytes) -> None:
        self.last = self.bpe.table(self.raw + raw, self.last, len(self.raw))
        self.raw += raw

    def replace(self, start: int, end: int, raw: bytes) -> None:
        self.raw = self.raw[:start] + raw + self.raw[end:]
        self.last = self.bpe.table(self.raw, self.last, start)

    def ids(self) -> list[int]:
        return self.bpe.walk(self.last)


_loaded: dict[tuple, PrefixBpe] = {}


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns (id_col, n_tokens, ids binary, decoded binary), one row per input row.

    The rank table goes to the tasks with the job (its size is fixed), so executors need
    no file.  A null text is empty.  Texts are encoded whole; a piece of any length takes time
    linear in it.  Repeated rows each keep theirs, an empty table gives an empty result, and other
    columns are not read.
    """
    spark = docs.sparkSession
    ranks = load_ranks(ranks_path)
    shared = spark.sparkContext.broadcast((ranks, pattern, last_merges(ranks)))

    def run(batches):
        key = ("bpe", len(shared.value[0]), hash(pattern))
        bpe = _loaded.get(key) or _loaded.setdefault(key, PrefixBpe(*shared.value))
        for batch in batches:
            ids, texts = batch.column(0), texts_of(batch, 1)
            at = 0
            while at < len(texts):
                # bounded output: a long text goes out in a batch of its own
                encoded, size, first = [], 0, at
                while at < len(texts) and size < 1 << 22:
                    encoded.append(bpe.encode(texts[at] or ""))
                    size += len(encoded[-1])
                    at += 1
                cols = [ids[first:at], pa.array([len(x) // 4 for x in encoded], pa.int64()), pa.array(encoded, pa.binary()), pa.array([bpe.decode(x) for x in encoded], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["id", "n_tokens", "ids", "decoded"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "id long, n_tokens long, ids binary, decoded binary").withColumnRenamed("id", id_col)
