"""Redaction and credential recognition as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, in the order they are applied; ``(?U)`` gives ``\\w``, ``\\d`` and ``\\b`` their Unicode meaning.
PATTERNS = (
    ("<email>", r"(?U)\b[\w.\-]+@[\w.\-]+\.\w+\b"),
    ("<ssn>", r"(?U)\b\d{3}-\d{2}-\d{4}\b"),
    ("<pan>", r"(?U)\b(?:\d[ -]?){13,19}\b"),
    ("<ipv4>", r"(?U)\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
)
#: What a text must hold to match at all: cheap to test, so that most texts skip the patterns.
GUARDS = {"<email>": "@", "<ssn>": "-", "<ipv4>": "."}
#: Credential formats in the order they are tried.
CREDENTIALS = (
    ("anthropic", r"^sk-ant-(api03|sid01|admin01)-[A-Za-z0-9_-]{20,}$"),
    ("google", r"^AIza[A-Za-z0-9_-]{30,}$"),
    ("openai", r"^sk-(?!ant-)(proj-)?[A-Za-z0-9_-]{20,}$"),
)


def redact(text: Column) -> Column:
    """Marks in place of e-mail, social security, card and IPv4 numbers, in this order."""
    for mark, pattern in PATTERNS:
        done = F.regexp_replace(text, pattern, mark)
        guard = F.contains(text, F.lit(GUARDS[mark])) if mark in GUARDS else text.rlike("[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]")
        text = F.when(guard, done).otherwise(text)
    return text


def redacted_kinds(text: Column) -> Column:
    return F.filter(F.array(*[F.when(text.rlike(p), m) for m, p in PATTERNS]), lambda x: x.isNotNull())


def credential(value: Column) -> Column:
    value, out = F.trim(value), None
    for name, pattern in CREDENTIALS:
        out = F.when(value.rlike(pattern), name) if out is None else out.when(value.rlike(pattern), name)
    return out


def masked(value: Column) -> Column:
    n = F.length(value)
    last = F.substring(value, -4, 4)
    return F.when(n < 4, "****").when(n <= 8, F.concat(F.substring(value, 1, 1), F.lit("****"), last)).otherwise(F.concat(F.substring(value, 1, 12), F.lit("****..."), last))


def unquote(raw: Column) -> Column:
    """A dotenv value without its quotes."""
    s = F.rtrim(raw)
    quoted = (F.length(s) >= 2) & F.substring(s, 1, 1).isin('"', "'") & (F.substring(s, 1, 1) == F.substring(s, -1, 1))
    return F.when(quoted, F.substring(s, F.lit(2), F.length(s) - 2)).otherwise(F.ltrim(s))
