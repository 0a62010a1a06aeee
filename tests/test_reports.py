"""Reports, receipt folders, publishers and feedback on small inputs."""

import datetime
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import reports as R
from tessera.sources import receipts as S


def test_receipt_folders(spark, tmp_path):
    for k, body in (("a", b'{"kind": "x"}'), ("b", b"not json"), ("c", b"[1]"), ("old", b'{"kind": "y"}')):
        (tmp_path / f"{k}.json").write_bytes(body)
    (tmp_path / "a.sig").write_text("s")
    (tmp_path / "skip.txt").write_text("t")
    os.utime(tmp_path / "old.json", (1_000_000, 1_000_000))
    rows = {r.receipt_id: r for r in S.receipt_files(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a", "b", "c", "old"} and [k for k in rows if rows[k].has_signature] == ["a"]
    assert rows["a"].body == '{"kind": "x"}' and rows["b"].body is None and rows["c"].body is None
    assert rows["a"].hash_prefix == hashlib.sha256(b'{"kind": "x"}').hexdigest()[:12]
    since = datetime.datetime(2000, 1, 1)
    assert {r.receipt_id for r in S.receipt_files(spark, str(tmp_path), since=since).collect()} == {"a", "b", "c"}
    assert [r.receipt_id for r in S.receipt_files(spark, str(tmp_path), until=since).collect()] == ["old"]
    assert [r.receipt_id for r in S.newest(S.receipt_files(spark, str(tmp_path)), 4).collect()][-1] == "old"


def test_scan_manifests(spark, tmp_path):
    for k, m in (("s1", {"scan_id": "one", "scan_started_at": "2024-01-01", "finding_count": 3}), ("s2", {"scan_started_at": "2024-02-01"}), ("s3", "bad")):
        (tmp_path / k).mkdir()
        (tmp_path / k / "scan_manifest.json").write_text(json.dumps(m))
    (tmp_path / "s1" / "other.json").write_text("{}")
    assert [(r.scan_id, r.finding_count, r.directory) for r in S.scan_manifests(spark, str(tmp_path)).collect()] == [("s2", 0, "s2"), ("one", 3, "s1")]


def test_publishers(spark, tmp_path):
    df = spark.createDataFrame([("e", {"k": "v"}, (1, None), (2, "x"))], "experiment string, context map<string,string>, control struct<value: int, error: string>, candidate struct<value: int, error: string>")
    for _ in range(2):
        S.publish_json(df, str(tmp_path / "log"))
        S.publish_json(df, str(tmp_path / "stream"), epoch=4)
    lines = [json.loads(x) for f in (tmp_path / "log").glob("*.json") for x in f.read_text().splitlines()]
    assert lines == [{"experiment": "e", "context": {"k": "v"}, "control": {"value": 1, "error": None}, "candidate": {"value": 2, "error": "x"}}] * 2
    assert len([x for f in (tmp_path / "stream" / "epoch=4").glob("*.json") for x in f.read_text().splitlines()]) == 1
    assert S.published(df, 5)[0]["candidate"] == {"value": 2, "error": "x"}


def test_diagnoses(spark):
    schema = "id string, codebase string, issue_type string, root_cause string, fix string, confidence double, at long, was_correct boolean"
    known = spark.createDataFrame([("d1", "c", "t", "old", "f", 0.5, 1, None), ("d2", "c", "t", "r2", "f", 0.5, 2, None)], schema)
    new = spark.createDataFrame([("d1", "c", "t", "new", "f", 0.9, 0, None), ("d3", "x", "t", "r3", "f", 0.1, 3, None)], schema)
    rows = S.stored_diagnoses(known, new)
    assert {r.id: r.root_cause for r in rows.collect()} == {"d1": "new", "d2": "r2", "d3": "r3"} and rows.columns == known.columns
    marked = S.with_feedback(rows, spark.createDataFrame([("d2", True, 1), ("d2", False, 2), ("none", True, 3)], "id string, correct boolean, at long"))
    assert [(r.root_cause, r.was_correct) for r in S.similar_diagnoses(marked, "c", "t").collect()] == [("r2", False), ("new", None)]


def test_canonical_receipts(spark):
    df = spark.createDataFrame([("0/1", 3, None)], "lsn string, b int, a string")
    (r,) = S.canonical_receipts(df, "cdc_event", ["lsn", "b", "a"]).collect()
    assert r.receipt == '{"a":null,"b":3,"lsn":"0/1"}' and r.receipt_hash == hashlib.sha256(r.receipt.encode()).hexdigest()


def test_finding_lines(spark):
    schema = "severity_score int, file string, function string, caller_count int, reachable boolean, failures array<struct<exception_type: string, message: string>>"
    df = spark.createDataFrame([(5, "a.py", "f", 2, True, [("ValueError", "bad"), ("X", "y")]), (9, "b.py", "g", None, False, []), (1, "c.py", "h", 0, False, None)], schema)
    lines = [r.line for r in R.finding_lines(df, [F.desc("severity_score")], 2).orderBy("place").collect()]
    assert lines == ["! 3 finding(s) (top 2 shown):", "  [9] b.py:g (caller_count=0, not entry-reached)", "  [5] a.py:f (caller_count=2, entry-reachable)", "    ValueError: bad", "Exit 1 (findings present)."]
    assert [r.line for r in R.finding_lines(df.limit(0), [F.desc("severity_score")], 2).orderBy("place").collect()] == ["No findings.", "Exit 0 (no findings)."]


def test_small_joins(spark):
    seen = spark.createDataFrame([("py", "a"), ("py", "b"), ("py", "b"), ("go", "a")], "grammar string, node_type string")
    known = spark.createDataFrame([("py", "a"), ("go", "b")], "grammar string, node_type string")
    assert sorted(map(tuple, R.unknown_types(seen, known).collect())) == [("go", "a"), ("py", "b")]
    decorated = spark.createDataFrame([("p.py", "f", "app.route"), ("p.py", "g", "cached"), ("p.py", "h", "route")], "path string, function string, decorator string")
    plain = spark.createDataFrame([("p.py", "main"), ("p.py", "f")], "path string, function string")
    assert sorted(r.id for r in R.entry_points(decorated, ["route", "command"], plain, plain.limit(0)).collect()) == ["p.py::f", "p.py::h", "p.py::main"]
    jobs = spark.createDataFrame([("j", "new"), ("k", "new")], "job string, state string")
    events = spark.createDataFrame([("j", 1, "g1"), ("j", 2, "g2"), ("j", 3, "other"), ("k", 1, None)], "job string, seq int, gate string")
    assert sorted(map(tuple, R.job_states(jobs, events, {"g1": "running", "g2": "done"}).collect())) == [("j", "done"), ("k", "new")]
    previews = spark.createDataFrame([("ollama", "  "), ("x", "abc"), ("x", "abcdefgh"), ("x", "abcdefghijklmnop")], "p string, v string")
    assert [r[0] for r in previews.select(R.credential_preview(F.col("p"), F.col("v"))).collect()] == ["local-no-auth-needed", "****", "a****efgh", "abcdefghijkl****...mnop"]
    assert spark.range(1).select(R.checked_migration_id(F.lit("m-1"))).first()[0] == "m-1"
    with pytest.raises(Exception, match="migration id must match"):
        spark.range(1).select(R.checked_migration_id(F.lit("-m"))).collect()
