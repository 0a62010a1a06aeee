"""Which texts hold which of very many names, and which match which of many patterns.

All names become one automaton (Aho and Corasick), so a text is passed once, however many names there are, and a
regular expression is tried only on the texts that hold the name it needs.  Where the names are too large to be sent to
every task, they are dealt to groups by their first characters, and each group meets the texts in tasks of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import positions

#: Characters of names in an automaton (some hundred bytes each), and texts that go to one task of a group.
LIMIT, TEXTS = 1 << 19, 1 << 15
#: What a file that reads its environment says, and extensions of files that are looked through.
ENVIRONMENT = ("os.environ", "os.getenv", "process.env.", "settings.", "config.")
EXTENSIONS = (".py", ".ts", ".tsx")
#: Variables of an environment file that are looked for, callers of a function that are read.
VARIABLES, CALLERS = 20, 120


class Automaton:
    """Finds names, each with the rules (rule, pattern or None) that ask for it."""

    def __init__(self, rows: Sequence[tuple[str, object, str | None]]) -> None:
        rules: dict[str, list[tuple[object, str | None]]] = {}
        for name, rule, pattern in rows:
            if name:
                rules.setdefault(name, []).append((rule, pattern))
        self.tree = ahocorasick.Automaton()
        for name, own in rules.items():
            self.tree.add_word(name, own)
        self.empty = not rules
        if rules:
            self.tree.make_automaton()

    def rules(self, text: str) -> list[object]:
        """The rules that the text meets; a pattern is searched once its name is found."""
        if self.empty:
            return []
        own = {id(rules): rules for _, rules in self.tree.iter(text)}
        return [rule for rules in own.values() for rule, pattern in rules if pattern is None or re.search(pattern, text)]


def _deal(rules: DataFrame, limit: int) -> tuple[Column, int]:
    """A group for each name by its first character, of about ``limit`` characters; the number of groups."""
    sizes = rules.groupBy(F.substring("name", 1, 1).alias("c")).agg(F.sum(F.length("name")).alias("n")).orderBy("c").collect()  # a row for each character
    first, parts, group, filled = {}, {}, 0, 0
    for c, n in sizes:
        if filled and filled + n > limit:
            group, filled = group + 1, 0
        first[c], parts[c] = group, max(1, -(-n // limit))
        if parts[c] > 1:
            group, filled = group + parts[c], 0
        else:
            filled += n
    if not first:
        return F.lit(0), 1
    flat = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    c = F.substring("name", 1, 1)
    return flat(first)[c] + F.pmod(F.xxhash64("name"), flat(parts)[c]).cast("int"), max(first[c] + parts[c] for c in first)


def matches(rules: DataFrame, texts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(rule, path), once each: texts (path, text) that hold the name of a rule (rule, name, pattern) and, where it has one,
    match its pattern, a regular expression of Python's.

    Names and texts are compared as they are.  An empty or null name is in no text; ``rule`` and ``path`` may be of any type that
    Arrow takes.
    """
    r = rules.select("rule", F.col("name").cast("string").alias("name"), F.col("pattern").cast("string").alias("pattern")).where("name <> ''")
    own = texts.select("path", F.col("text").cast("string").alias("text")).where("text is not null")
    kinds = {c: d.schema[c].dataType.simpleString() for c, d in (("rule", r), ("path", own))}
    out = f"rule {kinds['rule']}, path {kinds['path']}"
    size = r.agg(F.sum(F.length("name") + F.coalesce(F.length("pattern"), F.lit(0)) + 16).alias("n")).first().n or 0
    if size <= limit:
        shared = rules.sparkSession.sparkContext.broadcast([(x.name, x.rule, x.pattern) for x in r.collect()])  # at most ``limit`` characters

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = Automaton(shared.value)
            for batch in batches:
                yield _hits(automaton, batch.column(0), batch.column(1).to_pylist(), kind)

        kind = _arrow(r, "rule")
        return own.mapInArrow(search, out).distinct()
    group, n = _deal(r, limit)
    slots = max(1, -(-own.count() // TEXTS))
    every = F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))
    names = r.withColumn("g", group).withColumn("slot", every).select("g", "slot", F.lit(0).alias("kind"), "rule", "name", "pattern", F.lit(None).cast(kinds["path"]).alias("path"))
    copies = own.withColumn("slot", F.pmod(F.xxhash64("path", "text"), F.lit(slots)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    copies = copies.select("g", "slot", F.lit(1).alias("kind"), F.lit(None).cast(kinds["rule"]).alias("rule"), F.col("text").alias("name"), F.lit(None).cast("string").alias("pattern"), "path")
    both = names.union(copies).repartition(n * slots, "g", "slot").sortWithinPartitions("g", "slot", "kind")
    kind = _arrow(r, "rule")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, automaton = None, [], None
        for batch in batches:
            g, slot, mark, rule, name, pattern = (batch.column(i).to_pylist() for i in range(6))
            texts_at, held = [], []
            for i, key in enumerate(zip(g, slot, strict=True)):
                if key != at:
                    if held:
                        yield _hits(automaton, batch.column(6).take(pa.array(texts_at)), held, kind)
                        texts_at, held = [], []
                    at, rows, automaton = key, [], None
                if mark[i] == 0:
                    rows.append((name[i], rule[i], pattern[i]))
                    continue
                if automaton is None:
                    automaton, rows = Automaton(rows), []
                texts_at.append(i)
                held.append(name[i])
            if held:
                yield _hits(automaton, batch.column(6).take(pa.array(texts_at)), held, kind)

    return both.mapInArrow(stream, out).distinct()


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _hits(automaton: Automaton, paths: pa.Array, texts: list[str], kind: pa.DataType) -> pa.RecordBatch:
    found = [automaton.rules(t) for t in texts]
    at = [i for i, rules in enumerate(found) for _ in rules]
    return pa.RecordBatch.from_arrays([pa.array([x for rules in found for x in rules], kind), paths.take(pa.array(at, pa.int64()))], ["rule", "path"])


def contained_names(names: DataFrame, texts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(owner, name, path): the first name of each owner that a text holds, in lower case.

    ``names``: owner, name, place; ``texts``: path, text.
    """
    n = names.select("owner", "name", "place", F.lower("name").alias("low"))
    hits = matches(n.select(F.col("low").alias("rule"), F.col("low").alias("name"), F.lit(None).cast("string").alias("pattern")).distinct(), texts.select("path", F.lower("text").alias("text")), limit)
    first = F.min_by("name", F.struct("place", "name"))
    return n.join(hits, n.low == hits.rule).groupBy("owner", "path").agg(first.alias("name"))


def source_files(files: DataFrame, extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """Files (path, text) of the extensions."""
    path = F.col("path")
    ends = path.endswith(extensions[0])
    for e in extensions[1:]:
        ends = ends | path.endswith(e)
    return files.where(ends)


def environment_consumers(variables: DataFrame, files: DataFrame, most: int = VARIABLES, limit: int = LIMIT) -> DataFrame:
    """(owner, path): source files that read an environment or name one of the first ``most`` variables of an owner.

    ``variables``: owner, name, place (their order in the owner's file).  What reads an environment at all belongs to every owner
    that has variables.
    """
    named = variables.where("name <> ''")
    first = F.slice(F.array_sort(F.collect_list(F.struct("place", "name"))), 1, most)
    own = named.groupBy("owner").agg(first.alias("v")).select("owner", F.explode("v.name").alias("name")).distinct()  # a file's variables are few
    fixed = named.select("owner").distinct().select("owner", F.explode(F.array(*map(F.lit, ENVIRONMENT))).alias("name"))
    wanted = own.union(fixed)
    rules = wanted.select(F.col("name").alias("rule"), "name", F.lit(None).cast("string").alias("pattern")).distinct()
    hits = matches(rules, source_files(files), limit)
    return wanted.join(hits, wanted.name == hits.rule).select("owner", "path").distinct()


def import_consumers(configs: DataFrame, files: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(owner, path): source files that import an owner's configuration file (owner, file)."""
    base = F.regexp_replace("file", r"\.[^.]*$", "")
    safe = F.regexp_replace(base, r"([^A-Za-z0-9_])", r"\\$1")
    pattern = F.concat(F.lit(r"from\s+.*"), safe, F.lit(r"\s+import|import\s+.*"), safe, F.lit(r"\b|require\s*\(\s*['\"].*"), safe)
    rules = configs.select(F.col("owner").alias("rule"), base.alias("name"), pattern.alias("pattern"))
    return matches(rules, source_files(files), limit).select(F.col("rule").alias("owner"), "path")


def middleware_consumers(owners: DataFrame, files: DataFrame) -> DataFrame:
    """(owner, path): every Python file of routes or an interface, for each owner; owners are few."""
    path = F.col("path")
    name = F.regexp_extract(path, r"[^/]*$", 0)
    routes = files.where(path.endswith(".py") & (path.contains("api/") | path.contains("routes/") | F.lower(name).contains("router"))).select("path")
    return routes.crossJoin(F.broadcast(owners.select("owner").distinct())).select("owner", "path")


def caller_literals(calls: DataFrame, literals: DataFrame, most: int = CALLERS) -> DataFrame:
    """(target, place, kind, n): kinds of the literals at each argument place of a function, over its first ``most`` callers.

    ``calls``: source, target, at (their order); ``literals``: caller, callee, place, kind, a row for each literal argument of a call.
    """
    read = positions(calls.select("source", "target", "at"), ["target"], ["at", "source"], "_i").where(F.col("_i") < most).select("source", "target").distinct()
    own = literals.select(F.col("caller").alias("source"), F.col("callee").alias("target"), "place", F.coalesce("kind", F.lit("None")).alias("kind"))
    return own.join(read, ["source", "target"]).groupBy("target", "place", "kind").agg(F.count(F.lit(1)).alias("n"))
