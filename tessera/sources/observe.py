"""Observation envelopes: JSON lines of several collectors as one stream shape (kind, service, payload)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: What an event of a pod holds, and its kind; the first one there is.
TETRAGON = (("process_kprobe", "syscall"), ("dns", "dns_lookup"), ("process_exec", "process_exec"), ("http_request", "http_request"), ("sql", "sql_query"))


def json_lines(df: DataFrame, column: str = "value") -> DataFrame:
    """Adds ``v`` (VARIANT); blank and malformed lines go."""
    return df.withColumn("v", F.try_parse_json(column)).where(F.col("v").isNotNull())


def _at(path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col("v"), path, kind)


def debezium(lines: DataFrame) -> DataFrame:
    """kind insert, update or delete; service ``db://database.table``; other operations go."""
    op = F.coalesce(_at("$.payload.op"), _at("$.op"))
    kind = F.when(op == "c", "insert").when(op == "u", "update").when(op == "d", "delete")
    db = F.coalesce(_at("$.payload.source.db"), _at("$.source.db"))
    tab = F.coalesce(_at("$.payload.source.table"), _at("$.source.table"))
    return lines.select(kind.alias("kind"), F.concat(F.lit("db://"), db, F.lit("."), tab).alias("service"), "v").where("kind is not null")


def tetragon(lines: DataFrame, label: str = "observe") -> DataFrame:
    """Events of pods that carry the label, by the first of kprobe, dns, exec, http and sql that they hold."""
    kind = F.coalesce(*[F.when(_at(f"$.{k}", "variant").isNotNull(), n) for k, n in TETRAGON])
    gate = F.coalesce(_at(f"$.pod.labels['{label}']"), _at(f"$.process.pod.labels['{label}']")) == "true"
    return lines.where(gate).select(kind.alias("kind"), _at("$.pod.name").alias("service"), "v").where("kind is not null")


def mainframe(lines: DataFrame) -> DataFrame:
    smf = _at("$.smf_type")
    kind = F.when(smf == "30.4", "smf_step_end").when(smf.isNotNull(), None).when(_at("$.transaction_id").isNotNull(), "cics_transaction").when(_at("$.dataset").isNotNull(), "vsam_access")
    service = F.coalesce(F.concat_ws("/", _at("$.region"), _at("$.system_id")), F.lit(""))
    return lines.select(kind.alias("kind"), service.alias("service"), "v").where("kind is not null")


def smf_header(raw: Column) -> Column:
    """Record type and subtype, bytes 5 and 6 of the 8-byte header."""
    at = [F.conv(F.hex(F.substring(raw, i, 1)), 16, 10).cast("int") for i in (5, 6)]
    return F.concat_ws(".", *at)


def vsam_payload(raw: Column) -> Column:
    return F.substring(raw, F.lit(25), F.length(raw))


def git_numstat(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """Rows of ``git log --numstat`` with ``COMMIT:hash|author|date|subject`` heads: one row for each changed source file."""
    from ..operators.ordered import greatest_before

    is_head = F.startswith("value", F.lit("COMMIT:"))
    head = F.when(is_head, F.struct(F.col(order).alias("at"), F.substring("value", 8, 1 << 20).alias("text")))
    rows = greatest_before(lines, [], [order], head, "_h").where(~is_head).withColumn("_h", F.col("_h.text"))
    f, h = F.split("value", "\t"), F.split("_h", r"\|")
    rows = rows.where(F.size(f) == 3).select(h[0].alias("commit"), h[1].alias("author"), h[2].alias("date"), F.coalesce(f[0].try_cast("int"), F.lit(0)).alias("added"), F.coalesce(f[1].try_cast("int"), F.lit(0)).alias("deleted"), f[2].alias("path"))
    return rows.where(F.col("path").rlike(r"\.(py|tsx?|jsx?)$"))


def counters(lines: DataFrame, label: str = "observe") -> DataFrame:
    """(kind, received, kept, filtered): events of pods by kind, and how many of them the label lets through."""
    kinds = [F.when(_at(f"$.{k}", "variant").isNotNull(), n) for k, n in TETRAGON]
    gate = F.coalesce(F.coalesce(_at(f"$.pod.labels['{label}']"), _at(f"$.process.pod.labels['{label}']")) == "true", F.lit(False))
    own = lines.select(F.coalesce(*kinds).alias("kind"), gate.alias("kept")).where("kind is not null")
    return own.groupBy("kind").agg(F.count(F.lit(1)).alias("received"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("filtered"))
