"""Folders of receipts and manifests as tables, publishers of mismatches, and the store of diagnoses with its feedback."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Receipts of a listing unless given.
MOST = 200


def receipt_files(spark: SparkSession, folder: str, since: datetime.datetime | None = None, until: datetime.datetime | None = None) -> DataFrame:
    """(path, receipt_id, modified, body, hash_prefix, has_signature) of the JSON files of a folder, changed between two times.

    ``body`` is null where a file is no JSON object, and ``hash_prefix`` the first 12 digits of its bytes' digest.  A
    signature is a file of the same name with ``.sig``; it is not checked.  Files are read side by side, and the times prune
    them before they are read.
    """

    def files(pattern: str) -> DataFrame:
        return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)

    own = files("*.json")
    if since is not None:
        own = own.where(F.col("modificationTime") >= F.lit(since))
    if until is not None:
        own = own.where(F.col("modificationTime") <= F.lit(until))
    stem = F.regexp_replace("path", r"\.(json|sig)$", "")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    body = F.when(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), text)
    signed = files("*.sig").select(stem.alias("stem"), F.lit(True).alias("signed"))
    out = own.select("path", stem.alias("stem"), F.col("modificationTime").alias("modified"), body.alias("body"), F.substring(F.sha2("content", 256), 1, 12).alias("hash_prefix")).join(signed, "stem", "left")
    return out.select("path", F.regexp_extract("stem", "[^/]*$", 0).alias("receipt_id"), "modified", "body", "hash_prefix", F.coalesce("signed", F.lit(False)).alias("has_signature"))


def newest(receipts: DataFrame, most: int = MOST) -> DataFrame:
    """The last ones by time of change; equal times by path."""
    return receipts.orderBy(F.desc("modified"), "path").limit(most)


def scan_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """(scan_id, scan_started_at, scan_finished_at, finding_count, manifest_kind, directory) of ``<folder>/*/scan_manifest.json``,
    the last scan first.  Files that are no JSON objects are left out; the folder's name stands for a missing id."""
    r = receipt_files(spark, folder).where("body is not null and receipt_id = 'scan_manifest'")
    directory = F.regexp_extract("path", r"([^/]*)/[^/]*$", 1)
    field = lambda c: F.get_json_object("body", f"$.{c}")
    rows = r.select(F.coalesce(F.nullif(field("scan_id"), F.lit("")), directory).alias("scan_id"), field("scan_started_at").alias("scan_started_at"), field("scan_finished_at").alias("scan_finished_at"), F.coalesce(field("finding_count").try_cast("int"), F.lit(0)).alias("finding_count"), field("manifest_kind").alias("manifest_kind"), directory.alias("directory"))
    return rows.orderBy(F.desc(F.coalesce("scan_started_at", F.lit(""))), "directory")


def publish_json(mismatches: DataFrame, path: str, epoch: int | None = None) -> None:
    """Appends mismatches (experiment, context, control, candidate) as JSON lines; of a stream, each epoch to a folder of its own,
    so that one that is retried replaces what it wrote."""
    rows = mismatches.select("experiment", "context", "control", "candidate")
    if epoch is None:
        rows.write.mode("append").option("ignoreNullFields", "false").json(path)
    else:
        rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/epoch={epoch}")


def published(mismatches: DataFrame, most: int) -> list[dict]:
    """The first ``most`` mismatches as plain values, for a list in a program."""
    return [r.asDict(recursive=True) for r in mismatches.select("experiment", "context", "control", "candidate").limit(most).collect()]


def stored_diagnoses(known: DataFrame, new: DataFrame) -> DataFrame:
    """Diagnoses (id, codebase, issue_type, root_cause, fix, confidence, at, was_correct) with new ones, which replace those of their id."""
    both = known.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in known.columns if c != "id"]
    last = F.max_by(F.struct(*rest), F.struct("_new", "at"))
    return both.groupBy("id").agg(last.alias("r")).select("id", "r.*").select(*known.columns)


def with_feedback(diagnoses: DataFrame, feedback: DataFrame) -> DataFrame:
    """``was_correct`` as the last feedback (id, correct, at) says; without feedback it stays."""
    last = feedback.groupBy("id").agg(F.max_by(F.struct("correct"), "at").alias("f"))
    names = [F.coalesce("f.correct", "was_correct").alias(c) if c == "was_correct" else F.col(c) for c in diagnoses.columns]
    return diagnoses.join(last, "id", "left").select(*names)


def similar_diagnoses(diagnoses: DataFrame, codebase: str, issue_type: str, most: int = 5) -> DataFrame:
    """Earlier diagnoses of a codebase and kind of issue, the last first."""
    own = diagnoses.where((F.col("codebase") == codebase) & (F.col("issue_type") == issue_type))
    return own.orderBy(F.desc("at"), "id").limit(most).select("root_cause", "fix", "confidence", "was_correct")


def canonical_receipts(rows: DataFrame, kind: str, fields: list[str]) -> DataFrame:
    """(kind, receipt, receipt_hash): canonical JSON (keys in order, no spaces, nulls kept) of rows such as applied changes, lag ticks or
    cutover proposals, and its digest."""
    receipt = F.to_json(F.struct(*[F.col(c) for c in sorted(fields)]), {"ignoreNullFields": "false"})
    return rows.select(F.lit(kind).alias("kind"), receipt.alias("receipt"), F.sha2(receipt, 256).alias("receipt_hash"))
