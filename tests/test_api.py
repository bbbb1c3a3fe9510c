"""Scans of one file, limits, rules that users add, the command line, and the queue's waiting and recovery."""

import pandas as pd
import pytest

from plumbline.errors import LimitError, PlumblineError, RuleError, ScanError
from plumbline.limits import Limits
from plumbline.operators.detectors import DETECTORS, Detector
from plumbline.operators.registry import Registry
from plumbline.plans import api

from .fixtures_make import CSV, attachment, multipart
from .streams import drained


def test_one_file(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("words with a mark​ in them\n".encode())
    (tmp_path / "b.md").write_bytes(b"plain words and nothing more\n")
    r = api.scan_file(spark, str(tmp_path / "a.md"))
    assert [f["mechanism"] for f in r.findings] == ["zero_width_chars"] and r.exit_code == 1 and r.report["n_findings"] == 1
    assert api.scan_file(spark, str(tmp_path / "b.md")).exit_code == 0
    for path in (tmp_path, tmp_path / "nowhere.md"):
        with pytest.raises(ScanError):
            api.scan_file(spark, str(path))
    with pytest.raises(PlumblineError):
        api.scan_file(spark, str(tmp_path / "a.md"), "fast")


def test_limits():
    from plumbline.plans.scan import units_of

    limited = lambda raw, name, **k: [(u[1], u[2]) for u in units_of(raw, name, limits=Limits(**k))[2] if u[0] == "scan_limited"]
    table = CSV.encode()
    assert limited(table, "a.csv", csv_rows=3) and not limited(table, "a.csv", csv_rows=7) and not limited(table, "a.csv", csv_rows=0)
    assert limited(table, "a.csv", field_chars=4) and not limited(table, "a.csv", field_chars=0)
    assert limited(table, "a.csv", file_bytes=10) == [("a.csv", "file size")]
    mail = multipart("Content-Type: text/plain\r\n\r\nHi", *(attachment(f"{i}.exe") for i in range(3)))
    assert limited(mail, "a.eml", attachments=2) and not limited(mail, "a.eml", attachments=3) and not limited(mail, "a.eml", attachments=0)
    inner = "Content-Type: message/rfc822\r\n\r\nFrom: a@b.example\r\nSubject: x\r\n\r\nInner"
    assert limited(multipart(inner), "a.eml", depth=1) and not limited(multipart(inner), "a.eml", depth=2) and not limited(multipart(inner), "a.eml", depth=0)
    for wrong in ({"file_bytes": 0}, {"csv_rows": -1}):
        with pytest.raises(LimitError):
            Limits(**wrong)


def test_rules_of_users(spark, tmp_path):
    from plumbline.plans.scan import scan

    rules = Registry()
    rules.describe("secret_word", "inner", 0.4, 1)
    mine = rules.register(Detector("secret_word", "line", "text rlike 'xyzzy'", "0.9"))
    assert rules.get("secret_word") == [mine] and "secret_word" in rules and len(rules) == len(DETECTORS) + 1
    files = spark.createDataFrame([("a.md", b"say xyzzy twice\n"), ("b.md", b"plain words here\n")], "file_id string, content binary")
    s = scan(files, rules=rules)
    assert [(r["file_id"], r["mechanism"], r["severity"], r["tier"]) for r in s.findings.collect()] == [("a.md", "secret_word", 0.4, 1)]
    assert {r["file_id"]: r["score"] for r in s.reports.collect()} == {"a.md": 0.64, "b.md": 1.0}
    s.release()
    rules.unregister("secret_word")
    assert "secret_word" not in rules.names()
    for wrong in (mine.__class__("never_described", "line", "true"), DETECTORS[0], Detector("tag_chars", "", "true"), Detector("tag_chars", "line", "text rlike ("), Detector("tag_chars", "line", "no_such_column")):
        with pytest.raises(RuleError):
            rules.register(wrong)
    for wrong in (("secret_word", "inner", 0.1, 1), ("new", "middle", 0.1, 1), ("new", "inner", 2.0, 1), ("new", "inner", 0.1, 9)):
        with pytest.raises(RuleError):
            rules.describe(*wrong)
    with pytest.raises(KeyError):
        rules.get("secret_word")
    rules.clear()
    assert len(rules) == 0 and scan(files, rules=rules).findings.count() == 0


def test_command_line(spark, tmp_path, capsys):
    from plumbline.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_bytes("words with a mark​ in them\n".encode())
    assert main([str(tmp_path / "in")], spark) == 1 and "zero_width_chars" in capsys.readouterr().out
    assert main([str(tmp_path / "in"), "--summary", "--max-file-bytes", "5"], spark) == 2 and "any_incomplete=True" in capsys.readouterr().out
    assert main([str(tmp_path / "in"), "--format", "json", "--out", str(tmp_path / "out")], spark) == 1
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    assert main([str(tmp_path / "nowhere")], spark) == 2 and main([str(tmp_path), "--max-csv-rows", "-1"], spark) == 2


def test_more_stem_rules(spark):
    from pyspark.sql import functions as F

    from plumbline.operators import scoring

    files = spark.createDataFrame([("a.mp3", "mp3"), ("b.md", "markdown")], "file_id string, kind string")
    found = spark.createDataFrame([("a.mp3", "audio_lyrics_prompt_injection", "USLT", "x")], "file_id string, mechanism string, location string, concealed string")
    mine = lambda s: s.where("lyric > 0").select("file_id", "kind", F.lit("sung").alias("mechanism"), F.lit(0.5).alias("confidence"), F.lit("").alias("concealed"))
    got = sorted((r["file_id"], r["mechanism"]) for r in scoring.stem_findings(files, found, more=[mine]).collect())
    assert got == [("a.mp3", "cross_stem_inventory"), ("a.mp3", "cross_stem_undeclared_text"), ("a.mp3", "sung"), ("b.md", "cross_stem_inventory")]


def test_queue_waits_and_recent_changes(spark):
    from plumbline.streaming import queue as Q

    t = lambda s: pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s)
    attempts = pd.DataFrame([(j, t(10 * j + k), 503 if k < 1 or j == 2 else 200) for j in (1, 2, 3) for k in (0, 1)], columns=["job_id", "at", "code"])
    changes = Q.replay(spark.createDataFrame(attempts, "job_id long, at timestamp, code int"))
    assert [(r["job_id"], r["attempt"]) for r in Q.recent(changes, 3).collect()] == [(3, 2), (3, 1), (2, 2)]
    assert Q.next_due(changes).collect()[0]["next_at"] == t(23).to_pydatetime()
    assert Q.next_due(changes.where("job_id <> 2")).collect()[0]["next_at"] is None


def test_queue_recovers_from_its_checkpoint(spark, tmp_path):
    """Jobs that were under way when the stream stopped go on from where they were."""
    from plumbline.streaming import queue as Q

    t = pd.Timestamp("2024-01-01")
    rows = [(j, t + pd.Timedelta(seconds=100 * k + j), 200 if k == 3 else 503) for k in range(4) for j in range(5)]
    jobs = spark.createDataFrame(pd.DataFrame(rows, columns=["job_id", "at", "code"]), "job_id long, at timestamp, code int")
    for half in (jobs.where("at < timestamp'2024-01-01 00:03:00'"), jobs.where("at >= timestamp'2024-01-01 00:03:00'")):
        half.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(jobs.schema).parquet(str(tmp_path / "in"))
        q = Q.transitions(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).start()
        drained(q, half.count())
    key = lambda d: sorted((r["job_id"], r["attempt"], r["status"], str(r["next_at"])) for r in d.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(Q.replay(jobs))
