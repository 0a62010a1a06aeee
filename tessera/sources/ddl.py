"""Table definitions of four dialects (postgres, mysql, oracle, mongodb) as Spark schemas and metadata."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

#: Type names of each dialect under one vocabulary of tags.
TAGS = {
    "postgres": {"INTEGER": "smallint int2 integer int int4 bigint int8 serial bigserial smallserial", "DECIMAL": "numeric decimal money", "FLOAT": "real float4 float8 float|double precision", "STRING": "varchar|character varying|character|char|bpchar|text|citext|inet|cidr|macaddr|name", "BYTES": "bytea", "DATE": "date", "TIME": "time|timetz|time without time zone|time with time zone", "TIMESTAMP": "timestamp|timestamp without time zone", "TIMESTAMP_TZ": "timestamptz|timestamp with time zone", "INTERVAL": "interval", "BOOLEAN": "boolean bool", "UUID": "uuid", "XML": "xml", "JSON": "json jsonb"},
    "mysql": {"INTEGER": "tinyint smallint mediumint int integer bigint year bit", "DECIMAL": "decimal numeric dec", "FLOAT": "float double real|double precision", "STRING": "char varchar tinytext text mediumtext longtext enum set", "BYTES": "binary varbinary tinyblob blob mediumblob longblob", "DATE": "date", "TIME": "time", "TIMESTAMP": "datetime timestamp", "BOOLEAN": "boolean bool", "JSON": "json"},
    "oracle": {"INTEGER": "integer int smallint", "DECIMAL": "number numeric decimal", "FLOAT": "float binary_float binary_double real", "STRING": "varchar2 nvarchar2 varchar char nchar clob nclob long rowid urowid", "BYTES": "blob raw bfile|long raw", "TIMESTAMP": "date timestamp", "TIMESTAMP_TZ": "timestamp with time zone|timestamp with local time zone", "INTERVAL": "interval|interval year to month|interval day to second", "XML": "xmltype", "JSON": "json"},
    "mongodb": {"INTEGER": "int long", "DECIMAL": "decimal", "FLOAT": "double", "STRING": "string objectId symbol regex javascript", "BYTES": "binData", "TIMESTAMP": "date timestamp", "BOOLEAN": "bool", "JSON": "object array"},
}


def _names(text: str) -> list[str]:
    return [n for part in text.split("|") for n in ([part] if "|" in text and (" " in part and any(w in part for w in ("zone", "varying", "precision", "to ", "raw"))) else part.split())]


TYPES = {d: {n: tag for tag, text in tags.items() for n in _names(text)} for d, tags in TAGS.items()}
SPARK = {"INTEGER": T.LongType(), "FLOAT": T.DoubleType(), "STRING": T.StringType(), "BYTES": T.BinaryType(), "DATE": T.DateType(), "TIME": T.StringType(), "TIMESTAMP": T.TimestampNTZType(), "TIMESTAMP_TZ": T.TimestampType(), "INTERVAL": T.StringType(), "BOOLEAN": T.BooleanType(), "UUID": T.StringType(), "XML": T.StringType(), "JSON": T.StringType(), "UNKNOWN": T.StringType()}


@dataclass
class Column:
    name: str
    raw_type: str
    tag: str
    nullable: bool = True
    primary_key: bool = False
    unique: bool = False
    default: str | None = None
    precision: int | None = None
    scale: int | None = None
    comment: str | None = None

    @property
    def effective_nullable(self) -> bool:
        return self.nullable and not self.primary_key

    def spark_type(self) -> T.DataType:
        if self.tag == "DECIMAL":
            p = self.precision or 38
            return T.DecimalType(min(38, p), self.scale if self.scale is not None else (0 if self.precision else 18))
        return SPARK[self.tag]


@dataclass
class ForeignKey:
    columns: list[str]
    table: str
    parents: list[str]
    on_delete: str | None = None
    on_update: str | None = None


@dataclass
class Table:
    name: str
    columns: list[Column] = field(default_factory=list)
    primary_key: list[str] = field(default_factory=list)
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    indexes: list[tuple[str, list[str], bool]] = field(default_factory=list)

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark_type(), c.effective_nullable) for c in self.columns])


@dataclass
class ParseFailure:
    reason: str


@dataclass
class Schema:
    tables: dict[str, Table]
    warnings: list[str] = field(default_factory=list)


_HEAD = re.compile(r"create\s+(?:(?:unlogged|global\s+temporary|private\s+temporary|temporary|temp)\s+)?table\s+(?:if\s+not\s+exists\s+)?([\w\"`.]+)\s*\(", re.I)
_INDEX = re.compile(r"create\s+(unique\s+)?index\s+(?:if\s+not\s+exists\s+)?([\w\"]+)\s+on\s+([\w\".]+)\s*(?:using\s+\w+\s*)?\(([^)]*)\)", re.I)
_COMMENT = re.compile(r"comment\s+on\s+column\s+([\w\".]+)\.([\w\"]+)\s+is\s+'((?:[^']|'')*)'", re.I)
_ALTER = re.compile(r"alter\s+table\s+([\w\"`.]+)\s+add\s+(constraint\s+[\w\"`]+\s+.*?|primary\s+key.*?|foreign\s+key.*?);", re.I | re.S)
_FK = re.compile(r"foreign\s+key\s*\(([^)]*)\)\s*references\s+([\w\"`.]+)\s*\(([^)]*)\)(.*)", re.I | re.S)
_STOP = re.compile(r"\b(not\s+null|null|primary\s+key|unique|default|references|check|constraint|collate|generated|auto_increment|comment|character\s+set|charset|on\s+update)\b", re.I)


def _plain(name: str) -> str:
    return name.split(".")[-1].strip().strip('"`')


def _list(text: str) -> list[str]:
    return [_plain(x) for x in text.split(",") if x.strip()]


def _parts(body: str) -> list[str]:
    out, depth, at, quote = [], 0, 0, ""
    for i, c in enumerate(body):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "," and not depth:
            out.append(body[at:i])
            at = i + 1
    return [x.strip() for x in [*out, body[at:]] if x.strip()]


def _constraint(table: Table, text: str) -> bool:
    text = re.sub(r"^constraint\s+[\w\"`]+\s+", "", text, flags=re.I)
    if m := re.match(r"primary\s+key\s*\(([^)]*)\)", text, re.I):
        table.primary_key = _list(m[1])
    elif m := _FK.match(text):
        rest = {k.lower(): v for k, v in re.findall(r"on\s+(delete|update)\s+(cascade|restrict|set\s+null|set\s+default|no\s+action)", m[4], re.I)}
        table.foreign_keys.append(ForeignKey(_list(m[1]), _plain(m[2]), _list(m[3]), rest.get("delete"), rest.get("update")))
    elif m := re.match(r"(?:unique)\s*(?:key|index)?\s*[\w\"`]*\s*\(([^)]*)\)", text, re.I):
        table.indexes.append(("", _list(m[1]), True))
    elif not re.match(r"(check|exclude|key|index|fulltext)\b", text, re.I):
        return False
    return True


def _column(table: Table, text: str, dialect: str) -> Column | None:
    m = re.match(r"([\"`][^\"`]+[\"`]|\w+)\s+(.+)", text, re.S)
    if not m:
        return None
    rest = m[2]
    stop = _STOP.search(rest)
    raw = (rest[: stop.start()] if stop else rest).strip()
    tail = rest[stop.start() :] if stop else ""
    size = re.search(r"\(\s*(\d+)\s*(?:,\s*(-?\d+))?", raw)
    name = re.sub(r"\s+", " ", re.sub(r"\([^)]*\)", "", raw)).strip().lower()
    name = re.sub(r"\s*\bunsigned\b|\[\]", "", name).strip()
    tag = TYPES[dialect].get(name, TYPES[dialect].get(name.split(" ")[0] if name else "", "UNKNOWN"))
    c = Column(_plain(m[1]), raw, tag)
    if size and tag == "DECIMAL":
        c.precision, c.scale = int(size[1]), int(size[2] or 0)
    c.nullable = not re.search(r"\bnot\s+null\b", tail, re.I)
    c.primary_key = bool(re.search(r"\bprimary\s+key\b", tail, re.I))
    c.unique = bool(re.search(r"\bunique\b", tail, re.I))
    if d := re.search(r"\bdefault\s+(?:on\s+null\s+)?('(?:[^']|'')*'|[\w.]+(?:\([^)]*\))?)", tail, re.I):
        c.default = d[1]
    if r := re.search(r"\breferences\s+([\w\"`.]+)\s*\(([^)]*)\)(.*)", tail, re.I | re.S):
        rest = {k.lower(): v for k, v in re.findall(r"on\s+(delete|update)\s+(cascade|restrict|set\s+null|set\s+default|no\s+action)", r[3], re.I)}
        table.foreign_keys.append(ForeignKey([c.name], _plain(r[1]), _list(r[2]), rest.get("delete"), rest.get("update")))
    return c


def _mongo(text: str) -> Schema | ParseFailure:
    try:
        doc = json.loads(text)
    except ValueError as e:
        return ParseFailure(f"bad JSON: {e}")
    found = doc.get("collections", doc) if isinstance(doc, dict) else {}
    out = Schema({})
    for name, spec in found.items():
        if not isinstance(spec, dict):
            continue
        spec = spec.get("$jsonSchema", spec.get("validator", {}).get("$jsonSchema", spec))
        table = Table(name)

        def walk(props: dict, required: list, prefix: str, table=table) -> None:
            for key, p in props.items():
                kind = p.get("bsonType", "UNKNOWN")
                kinds = kind if isinstance(kind, list) else [kind]
                first = next((k for k in kinds if k != "null"), "UNKNOWN")
                c = Column(prefix + key, first, TYPES["mongodb"].get(first, "UNKNOWN"), key not in required or "null" in kinds, not prefix and key == "_id", comment=p.get("description"))
                table.columns.append(c)
                if first == "object":
                    walk(p.get("properties", {}), p.get("required", []), f"{prefix}{key}.")

        walk(spec.get("properties", {}), spec.get("required", []), "")
        table.primary_key = ["_id"] if any(c.name == "_id" for c in table.columns) else []
        if table.columns:
            out.tables[name] = table
    return out if out.tables else ParseFailure("no collections found")


def parse_ddl(text: str, dialect: str) -> Schema | ParseFailure:
    """A whole schema or a failure, never a part of one; what is skipped is in ``warnings``."""
    if dialect not in TYPES:
        return ParseFailure(f"unknown dialect {dialect}")
    if not text.strip():
        return ParseFailure("empty definition")
    if dialect == "mongodb":
        return _mongo(text)
    text = re.sub(r"/\*.*?\*/", " ", re.sub(r"--[^\n]*", "", text), flags=re.S)
    out = Schema({})
    for m in _HEAD.finditer(text):
        depth, i = 1, m.end()
        while i < len(text) and depth:
            depth += {"(": 1, ")": -1}.get(text[i], 0)
            i += 1
        table = Table(_plain(m[1]))
        if depth:
            out.warnings.append(f"{table.name}: the definition does not end")
            continue
        for part in _parts(text[m.end() : i - 1]):
            if re.match(r"(constraint|primary\s+key|foreign\s+key|unique\s*(key|index)?\s*[\w`\"]*\s*\(|check|key|index|fulltext|exclude)\b", part, re.I) and _constraint(table, part):
                continue
            c = _column(table, part, dialect)
            if c is None:
                out.warnings.append(f"{table.name}: cannot read {part!r}")
            else:
                table.columns.append(c)
        out.tables[table.name] = table
    for m in _ALTER.finditer(text):
        if t := out.tables.get(_plain(m[1])):
            _constraint(t, m[2].strip())
    for m in _INDEX.finditer(text):
        if t := out.tables.get(_plain(m[3])):
            t.indexes.append((_plain(m[2]), _list(m[4]), bool(m[1])))
    for m in _COMMENT.finditer(text):
        for c in getattr(out.tables.get(_plain(m[1])), "columns", ()):
            if c.name == _plain(m[2]):
                c.comment = m[3].replace("''", "'")
    for kind in re.findall(r"create\s+(?:or\s+replace\s+)?(sequence|trigger)\b", text, re.I):
        out.warnings.append(f"{kind.lower()} skipped")
    for t in out.tables.values():
        t.primary_key = t.primary_key or [c.name for c in t.columns if c.primary_key]
        for c in t.columns:
            c.primary_key = c.name in t.primary_key
    return out if out.tables else ParseFailure("no tables found")
