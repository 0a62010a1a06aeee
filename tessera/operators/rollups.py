"""Roll-ups with totals, scores of parsed files, JSON leaves and dependency checks."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def spend(calls: DataFrame, caps: DataFrame, today: Column) -> DataFrame:
    """A row for each provider of ``caps`` (provider, cap), and ``total``: calls, tokens and cost of today and the month.

    Calls: provider, day, status, tokens_in, tokens_out, usd, at.  Tokens and cost count where the status is ok.
    """
    now, ok = F.col("day") == today, F.col("status") == "ok"
    add = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    g = calls.groupBy("provider").agg(F.count_if(now).alias("today_calls"), add(now & ok, "tokens_in").alias("today_tokens_in"), add(now & ok, "tokens_out").alias("today_tokens_out"), add(now & ok, "usd").alias("today_usd"), add(ok, "usd").alias("month_usd"), F.count(F.lit(1)).alias("month_calls"), F.max("at").alias("last_call_at"))
    names = ["today_calls", "today_tokens_in", "today_tokens_out", "today_usd", "month_usd", "month_calls"]
    each = caps.join(g, "provider", "left").select("provider", *[F.coalesce(c, F.lit(0)).alias(c) for c in names], "last_call_at", (F.greatest(F.lit(0.0), F.col("cap") - F.coalesce("today_usd", F.lit(0.0)))).alias("remaining_today"))
    total = each.agg(*[F.sum(c).alias(c) for c in names]).select(F.lit("total").alias("provider"), *names, F.lit(None).cast(each.schema["last_call_at"].dataType).alias("last_call_at"), F.lit(None).cast("double").alias("remaining_today"))
    out = each.unionByName(total)
    return out.select("provider", *[F.round(c, 6).alias(c) if c.endswith("usd") else c for c in names], "last_call_at", F.round("remaining_today", 6).alias("remaining_today"))


def skip_banner(skips: DataFrame, k: int = 5) -> DataFrame:
    """(ext, files, loc, reasons): the k extensions of most estimated lines with all their reasons, and the rest as one row."""
    g = skips.groupBy("ext").agg(F.count(F.lit(1)).alias("files"), F.sum("loc").alias("loc"), F.collect_set("reason").alias("reasons"))
    top = g.orderBy(F.desc("loc"), "ext").limit(k).select(F.col("ext").alias("_e"))
    named = g.join(F.broadcast(top), F.col("ext").eqNullSafe(F.col("_e")), "left").withColumn("name", F.when(F.col("_e").isNull() & F.col("ext").isNotNull(), "(rest)").otherwise(F.col("ext")))
    out = named.groupBy(F.col("name").alias("ext")).agg(F.sum("files").alias("files"), F.sum("loc").alias("loc"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"))
    return out


def skip_verdict(skipped: DataFrame, parsed: DataFrame, threshold: float) -> DataFrame:
    """One row: the share of lines left out, and return code 2 if it is above the threshold."""
    both = skipped.select(F.col("loc").alias("s"), F.lit(0).cast("long").alias("p")).union(parsed.select(F.lit(0).cast("long"), "loc"))
    g = both.agg(F.sum("s").alias("s"), F.sum("p").alias("p"))
    ratio = F.when(F.col("s") + F.col("p") > 0, F.col("s") / (F.col("s") + F.col("p"))).otherwise(0.0)
    return g.select(F.round(ratio, 6).alias("ratio"), F.when(ratio > threshold, 2).otherwise(0).alias("rc"))


def mapping_counts(mappings: DataFrame) -> DataFrame:
    """Mappings by status, and whether a person must look."""
    names = ("ok", "low_confidence", "ambiguous", "no_match")
    g = mappings.agg(*[F.count_if(F.col("status") == n).alias(f"n_{n}") for n in names])
    return g.withColumn("requires_review", F.col("n_low_confidence") + F.col("n_ambiguous") + F.col("n_no_match") > 0)


def precision_bounds(df: DataFrame, column: str, precision: int, source_scale: int, target_scale: int) -> DataFrame:
    """One row: the least and greatest magnitudes, and what they mean for the target's precision and scale."""
    g = df.agg(F.max(F.abs(column)).alias("max_abs"), F.min(F.abs(column)).alias("min_abs"))
    beyond = F.when(F.col("max_abs") > float(10**precision - 1), "blocker").otherwise("ok")
    return g.withColumn("exceeds_precision", beyond).withColumn("scale_truncation", F.lit("warn" if source_scale > target_scale else "ok"))


def manifest_counts(findings: DataFrame) -> DataFrame:
    """Findings by severity (with timeouts and errors), and whether a person must look: a blocker, or any that says so."""
    names = ("blocker", "warn", "info", "timeout", "error")
    g = findings.agg(*[F.count_if(F.col("severity") == n).alias(f"n_{n}") for n in names], F.coalesce(F.bool_or("human"), F.lit(False)).alias("human"))
    return g.withColumn("requires_review", (F.col("n_blocker") > 0) | F.col("human")).drop("human")


def targets(nodes: DataFrame) -> DataFrame:
    """Functions and methods of the files that are not Python."""
    return nodes.where(F.col("file_path").isNotNull() & ~F.lower("file_path").endswith(".py") & F.col("type").isin("function", "method")).select("file_path", "name", F.coalesce("start_line", F.lit(0)).alias("start_line"))


#: Weights of what a parsed file of each language holds (statistic, least value, weight).
SCORES = {
    "cobol": (("has_identification_division", 1, 0.20), ("has_data_division", 1, 0.20), ("has_procedure_division", 1, 0.30), ("n_paragraphs_in_procedure", 1, 0.15), ("n_perform_or_call", 1, 0.10), ("has_linkage_or_copybook", 1, 0.05)),
    "hlasm": (("n_csect_or_rsect", 1, 0.30), ("n_dsect_or_ltorg", 1, 0.20), ("n_instruction_statements", 5, 0.20), ("n_macro_invocation", 1, 0.15), ("has_comments", 1, 0.10), ("n_using_or_drop", 1, 0.05)),
    "fortran": (("n_program_or_module_or_sub_or_function", 1, 0.25), ("n_use", 1, 0.20), ("n_procedure_bodies", 1, 0.20), ("has_implicit_none", 1, 0.15), ("n_contains_or_interface", 1, 0.10), ("n_lines", 11, 0.10)),
}


def language_score(language: str, stats: Column) -> Column:
    """Of a map of statistics: the weights of those that reach their least value."""
    out = F.lit(0.0)
    for name, least, weight in SCORES[language]:
        out = out + F.when(F.coalesce(F.try_element_at(stats, F.lit(name)), F.lit(0)) >= least, weight).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), out), 4)


def json_leaves(text: Column) -> Column:
    """(path, value) of the leaves of a JSON text, paths as ``a.b[0]`` and ``$`` for a bare value; values as JSON.  Empty containers have no leaf."""

    def leaves(raw: str | None) -> list[dict] | None:
        if raw is None:
            return None
        try:
            todo, out = [("", json.loads(raw))], []
        except ValueError:
            return None
        while todo:
            path, x = todo.pop()
            if isinstance(x, dict):
                todo += [(f"{path}.{k}" if path else k, v) for k, v in reversed(x.items())]
            elif isinstance(x, list):
                todo += [(f"{path}[{i}]", v) for i, v in reversed(list(enumerate(x)))]
            else:
                out.append({"path": path or "$", "value": json.dumps(x)})
        return out

    @F.pandas_udf("array<struct<path: string, value: string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(leaves)

    return run(text)


#: Words before a bracket that are no calls.
NOISE = ("if", "for", "while", "switch", "return", "new", "super", "this", "catch", "synchronized", "assert")


def dependency_report(sources: DataFrame, declared: DataFrame) -> DataFrame:
    """(unit, name, status): declared targets that a source does not refer to (missing), and references of three or more
    segments that none of its targets accounts for (extra).

    ``sources``: unit, text; ``declared``: unit, target.  A target is referred to by itself, by its last segment, or by
    a reference that ends in it; a reference with a target's last segment is accounted for.
    """
    imports = F.regexp_extract_all("text", F.lit(r"import\s+(?:static\s+)?([A-Za-z_][\w.]*)"), F.lit(1))
    calls = F.regexp_extract_all("text", F.lit(r"([A-Za-z_][\w.]*)\s*\("), F.lit(1))
    refs = sources.select("unit", F.explode(F.array_distinct(F.concat(imports, calls))).alias("ref"))
    refs = refs.where(~F.col("ref").isin(*NOISE)).withColumn("last", F.regexp_extract("ref", r"([^.]*)$", 1))
    want = declared.select("unit", "target").distinct().withColumn("last", F.regexp_extract("target", r"([^.]*)$", 1))
    seen = refs.select("unit", "last").distinct()
    missing = want.join(seen, ["unit", "last"], "left_anti").select("unit", F.col("target").alias("name"), F.lit("missing").alias("status"))
    extra = refs.where(F.size(F.split("ref", r"\.")) >= 3).join(want.select("unit", "last").distinct(), ["unit", "last"], "left_anti")
    return missing.union(extra.select("unit", F.col("ref"), F.lit("extra")).distinct())


def retry_history(attempts: DataFrame) -> DataFrame:
    """(node, final, history): the first passing attempt of each node; the history of those that never pass."""
    w = Window.partitionBy("node")
    g = attempts.withColumn("final", F.min(F.when(F.col("passed"), F.col("n"))).over(w))
    history = F.array_sort(F.collect_list(F.when(F.col("final").isNull(), F.struct("n", "error"))))
    return g.groupBy("node").agg(F.max("final").alias("final"), history.alias("history"))
