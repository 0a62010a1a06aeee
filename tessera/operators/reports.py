"""Reports and small joins over findings, jobs and grammars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the form of a migration id.
MIGRATION_ID = "^[a-z0-9][a-z0-9-]*$"


def finding_lines(findings: DataFrame, order: list[Column], most: int) -> DataFrame:
    """(place, line): a text report of the first ``most`` findings, two lines each where the first failure is known.

    ``findings``: severity_score, file, function, caller_count, reachable (from an entry), failures (array of struct
    exception_type, message).  ``order`` ranks them.  The head and the end count all findings.
    """
    top = findings.orderBy(*order).limit(most)
    # one row for each finding of the report, numbered in its order
    listed = top.agg(F.collect_list(F.struct("severity_score", "file", "function", "caller_count", "reachable", "failures")).alias("f"))
    total = findings.agg(F.count(F.lit(1)).alias("total"))
    both = listed.crossJoin(total)  # one row each

    def lines(f: Column) -> Column:
        head = F.format_string("  [%s] %s:%s (caller_count=%s, %s)", f["severity_score"].cast("string"), f["file"], f["function"], F.coalesce(f["caller_count"], F.lit(0)).cast("string"), F.when(f["reachable"], "entry-reachable").otherwise("not entry-reached"))
        first = F.get(f["failures"], F.lit(0))
        cause = F.format_string("    %s: %s", F.coalesce(first["exception_type"], F.lit("Error")), F.coalesce(first["message"], F.lit("")))
        return F.when(F.size(f["failures"]) > 0, F.array(head, cause)).otherwise(F.array(head))

    begin = F.when(F.col("total") == 0, "No findings.").otherwise(F.format_string("! %s finding(s) (top %s shown):", F.col("total").cast("string"), F.least("total", F.lit(most)).cast("string")))
    end = F.when(F.col("total") == 0, "Exit 0 (no findings).").otherwise("Exit 1 (findings present).")
    text = F.concat(F.array(begin), F.flatten(F.transform("f", lines)), F.array(end))
    return both.select(F.posexplode(text).alias("place", "line"))


def unknown_types(seen: DataFrame, known: DataFrame) -> DataFrame:
    """(grammar, node_type): top-level types that a grammar's files have and its known ones lack, once each."""
    return seen.select("grammar", "node_type").distinct().join(known.select("grammar", "node_type"), ["grammar", "node_type"], "left_anti")


def entry_points(decorated: DataFrame, decorators: list[str], called_in_main: DataFrame, parser_defaults: DataFrame) -> DataFrame:
    """(id): functions with one of the decorators (path, function, decorator: by its last part), called under the main guard or
    given to an argument parser (path, function each), as ``path::function``."""
    last = F.element_at(F.split("decorator", r"\."), -1)
    parts = [decorated.where(last.isin(*decorators)), called_in_main, parser_defaults]
    ids = [p.select(F.concat(F.col("path"), F.lit("::"), F.col("function")).alias("id")) for p in parts]
    return ids[0].union(ids[1]).union(ids[2]).where("id is not null").distinct()


def job_states(jobs: DataFrame, events: DataFrame, states: dict[str, str]) -> DataFrame:
    """(job, state): the state of each job's last event (job, seq, gate) whose gate has one; without any, the job's own."""
    of = F.create_map(*[F.lit(x) for kv in states.items() for x in kv])[F.col("gate")] if states else F.lit(None).cast("string")
    last = events.select("job", "seq", of.alias("to")).where("to is not null").groupBy("job").agg(F.max_by("to", "seq").alias("to"))
    return jobs.join(last, "job", "left").select("job", F.coalesce("to", "state").alias("state"))


def credential_preview(provider: Column, value: Column) -> Column:
    """A preview that shows at most the first 12 and last 4 characters; a local provider without a key needs none."""
    n = F.length(value)
    shown = F.when(n < 4, "****").when(n <= 8, F.concat(F.substring(value, 1, 1), F.lit("****"), F.right(value, F.lit(4)))).otherwise(F.concat(F.substring(value, 1, 12), F.lit("****..."), F.right(value, F.lit(4))))
    return F.when((provider == "ollama") & (F.trim(value) == ""), "local-no-auth-needed").otherwise(shown)


def checked_migration_id(migration: Column) -> Column:
    """The id, or an error that names it: small letters, digits and hyphens, beginning with none of the last."""
    return F.when(migration.rlike(MIGRATION_ID), migration).otherwise(F.raise_error(F.concat(F.lit("migration id must match " + MIGRATION_ID + ", got "), F.coalesce(migration, F.lit("null")))))
