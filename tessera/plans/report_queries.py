"""Reports over the tables: documents stand for findings and parsed files, events for the events of jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as R
from .base import query


@query("""
WITH f AS (SELECT n_chars % 10 AS s, 'f' || doc_id AS file, coalesce(source, '') AS fn, doc_id % 4 AS c, doc_id % 3 = 0 AS r, lang, doc_id FROM documents),
n AS (SELECT count(*) AS total FROM f), k AS (SELECT *, row_number() OVER (ORDER BY s DESC, doc_id) AS i FROM f QUALIFY i <= 20),
l AS (SELECT 0 AS i, 0 AS j, CASE WHEN total = 0 THEN 'No findings.' ELSE '! ' || total || ' finding(s) (top ' || least(total, 20) || ' shown):' END AS line FROM n
  UNION ALL SELECT i, 0, '  [' || s || '] ' || file || ':' || fn || ' (caller_count=' || c || ', ' || CASE WHEN r THEN 'entry-reachable' ELSE 'not entry-reached' END || ')' FROM k
  UNION ALL SELECT i, 1, '    Error: ' || lang FROM k WHERE lang IS NOT NULL
  UNION ALL SELECT 999, 0, CASE WHEN total = 0 THEN 'Exit 0 (no findings).' ELSE 'Exit 1 (findings present).' END FROM n)
SELECT CAST(row_number() OVER (ORDER BY i, j) - 1 AS INTEGER) AS place, line FROM l""")
def finding_report(t):
    """A report of the twenty gravest findings of all documents."""
    failures = F.when(F.col("lang").isNotNull(), F.array(F.struct(F.lit(None).cast("string").alias("exception_type"), F.col("lang").alias("message"))))
    d = t.documents.select("doc_id", (F.col("n_chars") % 10).alias("severity_score"), F.concat(F.lit("f"), "doc_id").alias("file"), F.coalesce("source", F.lit("")).alias("function"), (F.col("doc_id") % 4).alias("caller_count"), (F.col("doc_id") % 3 == 0).alias("reachable"), failures.alias("failures"))
    return R.finding_lines(d, [F.desc("severity_score"), F.col("doc_id")], 20)


@query("""SELECT c_custkey AS job, coalesce(arg_max(CASE event_type WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'done' END, event_id) FILTER (WHERE event_type IN ('signup', 'click', 'purchase')), 'new') AS state
FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY c_custkey""")
def job_gate_states(t):
    """The state of each customer's job after all events, by those that move it."""
    jobs = t.customer.select(F.col("c_custkey").alias("job"), F.lit("new").alias("state"))
    events = t.events.select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.col("event_type").alias("gate"))
    return R.job_states(jobs, events, {"signup": "queued", "click": "running", "purchase": "done"})


@query("SELECT lang AS grammar, source AS node_type FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL EXCEPT SELECT lang, source FROM documents WHERE n_chars > 6000")
def unknown_node_types(t):
    """Sources of each language that none of its long documents has."""
    d = t.documents.where("lang is not null and source is not null").select(F.col("lang").alias("grammar"), F.col("source").alias("node_type"), "n_chars")
    return R.unknown_types(d, d.where("n_chars > 6000"))
