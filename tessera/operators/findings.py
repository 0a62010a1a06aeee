"""Findings of a scan: rules, classes, ranks, gates, routing and small summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window



def rule_id(kind: Column, dimension: Column, runner: Column, function: Column) -> Column:
    base = F.when(kind == "memory_pathology", "find_bugs.memory_pathology").when(dimension == "filesystem_hygiene", "find_bugs.filesystem_hygiene").when(runner != "", F.concat(F.lit("find_bugs.layer6."), runner)).when(kind != "", F.concat(F.lit("find_bugs."), kind)).otherwise("find_bugs.pbt_failure")
    return F.concat(base, F.lit("#"), F.coalesce(function, F.lit("")))


def bug_class(kind: Column, dimension: Column) -> Column:
    return F.when(dimension == "filesystem_hygiene", dimension).when(kind != "", kind).otherwise("pbt_failure")


def ranked(findings: DataFrame, most: int) -> DataFrame:
    """The first findings by falling score, then file and function."""
    return findings.orderBy(F.desc("score"), "file", "function").limit(most)


def synthetic_name(name: Column) -> Column:
    t = F.trim(F.coalesce(name, F.lit("")))
    return (t == "") | F.startswith(t, F.lit("anonymous_")) | t.rlike(r"^node_\d+$")


def gate_results(checks: DataFrame, keys: list[str]) -> DataFrame:
    """Every gate gives a result: passes if it has no error.  ``checks``: keys, gate, error (null if none)."""
    g = checks.groupBy(*keys, "gate").agg(F.count("error").alias("errors"), F.min("error").alias("first_error"))
    return g.withColumn("passed", F.col("errors") == 0)


def type_class(name: Column) -> Column:
    n = F.lower(name)
    return F.when((n == "int") | n.contains("int") & ~name.contains("point"), "int").when((n == "str") | n.contains("str") & ~n.contains("list"), "str").when(n.contains("none"), "none")


def type_preferences(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, preference): classes of type names (name, n), each where its most frequent name stands; ties go by name."""
    c = counts.withColumn("cls", type_class(F.col("name"))).where("cls is not null")
    top = c.groupBy(*keys, "cls").agg(F.min(F.struct((-F.col("n")).alias("d"), "name")).alias("at"))
    order = F.array_sort(F.collect_list(F.struct("at", "cls")))
    return top.groupBy(*keys).agg(F.transform(order, lambda x: x["cls"]).alias("preference"))


def routing_chain(agent: Column, task: Column, default: Column, override: Column, valid: list[str], healthy: Column) -> Column:
    """(chain, skipped): the agent's chain, else the task's, else the default one, or the override alone; known
    providers in order, without those that ``healthy`` (a map) says are not."""
    known = F.array(*map(F.lit, valid))
    chain = F.when(F.array_contains(known, override), F.array(override)).otherwise(F.filter(F.coalesce(agent, task, default), lambda p: F.array_contains(known, p)))
    up = lambda p: F.coalesce(F.try_element_at(healthy, p), F.lit(True))
    return F.struct(F.filter(chain, up).alias("chain"), F.filter(chain, lambda p: ~up(p)).alias("skipped"))


def recent(opened: DataFrame, keys: list[str], item: str, at: str, most: int = 10) -> DataFrame:
    """The last opened items of each key, each once, newest first."""
    last = opened.groupBy(*keys, item).agg(F.max(at).alias(at))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(at), item))
    return last.withColumn("place", place).where(F.col("place") <= most)


def first_seen(events: DataFrame, keys: list[str], item: str, order: str) -> DataFrame:
    """The growing set of items as its additions: an item is in the set of a key from ``since`` on."""
    return events.where(F.col(item).isNotNull()).groupBy(*keys, item).agg(F.min(order).alias("since"))


def timeline(changes: DataFrame, commits: DataFrame, points: int = 100) -> DataFrame:
    """(commit, directory, files, lines, authors) after every k-th commit and the last one.

    ``commits``: commit, at (from 0); ``changes``: at, path, lines (after the change), author (the first of the
    path).  A file counts where it has lines.  Each change holds from its commit to the path's next one, so
    a snapshot takes one row of each path.
    """
    n = commits.count()
    # at most twice as many as points, and the last
    picked = commits.where((F.col("at") % max(1, n // points) == 0) | (F.col("at") == n - 1)).select("commit", "at")
    until = F.lead("at").over(Window.partitionBy("path").orderBy("at"))
    spans = changes.withColumn("until", F.coalesce(until, F.lit(1 << 62))).where("lines > 0")
    folder = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(".")
    at = spans.join(F.broadcast(picked.withColumnRenamed("at", "now")), (F.col("at") <= F.col("now")) & (F.col("now") < F.col("until")))
    return at.groupBy("commit", folder.alias("directory")).agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"), F.array_sort(F.collect_set("author")).alias("authors"))


def grammar_status(profile: DataFrame, patterns: DataFrame, mutations: DataFrame, since: Column) -> DataFrame:
    """A row for each grammar: average quality, patterns, mutations since a time, and the receipt of the last one."""
    p = patterns.groupBy("grammar").agg(F.count(F.lit(1)).alias("active_patterns"))
    m = mutations.groupBy("grammar").agg(F.count_if(F.col("observed_at") >= since).alias("recent_mutations"), F.max_by("receipt", F.struct("observed_at", "receipt")).alias("last_receipt"))
    average = F.when(F.col("files") > 0, F.round(F.col("quality") / F.col("files"), 3)).otherwise(0.0)
    out = profile.join(p, "grammar", "left").join(m, "grammar", "left")
    return out.select("grammar", F.col("files").alias("files_parsed"), average.alias("avg_quality"), F.coalesce("active_patterns", F.lit(0)).alias("active_patterns"), F.coalesce("recent_mutations", F.lit(0)).alias("recent_mutations"), F.when(F.trim("last_receipt") != "", F.trim("last_receipt")).alias("last_receipt"))


def accumulate_profile(profile: DataFrame, parsed: DataFrame) -> DataFrame:
    """(grammar, files, quality) with the files just parsed (grammar, quality) added."""
    more = parsed.select("grammar", F.lit(1).cast("long").alias("files"), "quality")
    return profile.select("grammar", "files", "quality").unionByName(more).groupBy("grammar").agg(F.sum("files").alias("files"), F.sum("quality").alias("quality"))
