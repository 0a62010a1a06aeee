"""Decoder of the logical replication messages of protocol version 1 (public PostgreSQL documentation)."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

#: Type numbers that decode to something other than text.
DECODERS = {16: lambda s: s == "t", 20: int, 21: int, 23: int, 700: float, 701: float}


@dataclass
class Relation:
    schema: str
    name: str
    columns: list[tuple[str, int, bool]]  # name, type number, part of the key


@dataclass
class State:
    relations: dict[int, Relation] = field(default_factory=dict)
    lsn: int = 0
    xid: int = 0
    micros: int = 0
    seq: int = 0


class ParseError(ValueError):
    """A message that is cut short, of an unknown relation, or not of this protocol."""


class _Reader:
    def __init__(self, raw: bytes) -> None:
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise ParseError(f"message ends at byte {len(self.raw)}, {n} more expected at {self.at}")
        self.at += n
        return self.raw[self.at - n : self.at]

    def number(self, form: str) -> int:
        return struct.unpack(">" + form, self.take(struct.calcsize(">" + form)))[0]

    def text(self) -> str:
        end = self.raw.find(b"\0", self.at)
        if end < 0:
            raise ParseError("text without an end")
        out = self.raw[self.at : end].decode("utf-8", "replace")
        self.at = end + 1
        return out

    def row(self, rel: Relation) -> dict:
        out = {}
        for name, oid, _ in rel.columns[: self.number("H")]:
            kind = chr(self.number("B"))
            if kind == "n":
                out[name] = None
            elif kind == "t":
                value = self.take(self.number("I")).decode("utf-8", "replace")
                try:
                    out[name] = DECODERS[oid](value) if oid in DECODERS else value
                except ValueError:
                    out[name] = value
            elif kind == "b":  # the binary form of the value
                out[name] = self.take(self.number("I")).hex()
            elif kind != "u":
                raise ParseError(f"unknown kind of value {kind!r}")
        return out  # an unchanged large value ('u') has no entry


def decode(raw: bytes, state: State) -> list[dict]:
    """The changes of one message; relation, begin and commit messages only move the state."""
    r = _Reader(raw)
    kind = chr(r.number("B"))
    if kind == "B":
        state.lsn, state.micros, state.xid, state.seq = r.number("Q"), r.number("q"), r.number("I"), 0
    elif kind == "R":
        oid, schema, name = r.number("I"), r.text(), r.text()
        r.number("B")
        columns = []
        for _ in range(r.number("H")):
            key = bool(r.number("B") & 1)
            columns.append((r.text(), r.number("I"), key))
            r.number("i")
        state.relations[oid] = Relation(schema, name, [(c, o, k) for c, o, k in columns])
    elif kind in "IUD":
        oid = r.number("I")
        if oid not in state.relations:
            raise ParseError(f"unknown relation {oid}")
        rel = state.relations[oid]
        before = after = None
        while r.at < len(raw):
            mark = chr(r.number("B"))
            if mark in "KO":
                before = r.row(rel)
            else:
                after = r.row(rel)
        return [_event(state, kind, rel, before, after)]
    elif kind == "T":
        n = r.number("I")
        r.number("B")
        return [_event(state, "T", state.relations[oid], None, None) for oid in [r.number("I") for _ in range(n)] if oid in state.relations]
    return []


def _event(state: State, op: str, rel: Relation, before: dict | None, after: dict | None) -> dict:
    state.seq += 1
    return {"op": op, "schema_name": rel.schema, "table_name": rel.name, "lsn": f"{state.lsn >> 32:X}/{state.lsn & 0xFFFFFFFF:X}", "xid": state.xid, "seq": state.seq - 1, "before": before, "after": after, "key_columns": [c for c, _, k in rel.columns if k]}
