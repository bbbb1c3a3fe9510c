"""Query catalogue against SQL, and streams against replays of the same rows."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from .streams import drained

SF = "/root/testdata/sf0.001"
NAMES = ["q_unicode_units", "q_homoglyph_words", "q_score_verdict", "q_rollup", "q_html_meta", "q_html_external_refs", "q_corr_cross", "q_csv_type_drift", "q_csv_adjacent", "q_delim_infer", "q_overlap_pairs", "q_jaccard_divergence", "q_claim", "q_session", "q_routing", "q_scan_documents", "q_scan_pages", "q_scan_json", "q_scan_mail", "q_json_depth", "q_json_dup"]


def plain(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    from plumbline.plans import queries as Q

    con = duckdb.connect()
    for t in glob.glob(SF + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(t)[:-8]} AS SELECT * FROM '{t}'")
    df = Q.QUERIES[name](spark, SF)
    r = con.execute(Q.SQL[name])
    cols = [d[0] for d in r.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(tuple(plain(v) for v in x) for x in df.select(*cols).collect()) == sorted(tuple(plain(v) for v in x) for x in r.fetchall())


def test_claim_equals_sql_on_fractions_ties_and_nulls(spark, tmp_path):
    """Due times of halves of a second, before 1970, of nulls and ties, one table each: the first job due is SQL's."""
    from plumbline.plans import queries as Q

    half, more, none = ("2024-01-01 00:00:00.5", "2024-01-01 00:00:01.5", "1969-12-31 23:59:57.5"), ("2024-01-01 00:00:00.500001", "2024-01-01 00:00:00.9", "2024-01-01 00:00:00.499999"), None
    tables = [[(1, ts, 7)] for ts in half + more] + [
        [(2, more[1], 7), (3, half[1], 5), (1, half[0], 9)],  # ties in due after rounding
        [(1, none, 7), (2, more[0], 8)], [(1, more[0], 8), (2, none, 8), (1, none, 8)], [(1, none, None), (2, half[0], None), (4, half[0], 8)],
    ]
    for i, rows in enumerate(tables):
        sf = str(tmp_path / str(i))
        os.mkdir(sf)
        at = [f"({e}, {f"'{ts}'" if ts else 'NULL'}::TIMESTAMP, {'NULL' if u is None else u}::BIGINT, 'view', 1.0, '{{}}')" for e, ts, u in rows]
        con = duckdb.connect()
        con.execute(f"CREATE TABLE events AS SELECT * FROM (VALUES {', '.join(at)}) v(event_id, ts, user_id, event_type, value, props)")
        con.execute(f"COPY events TO '{sf}/events.parquet'")
        want = con.execute(Q.SQL["q_claim"]).fetchall()
        assert len(want) == 1 and [tuple(r) for r in Q.q_claim(spark, sf).collect()] == want, rows


def test_entry_module():
    import subprocess
    import sys

    import __spark_entry__ as e

    root = os.path.dirname(os.path.abspath(e.__file__))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr  # no session is needed to list the queries

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 50


def test_queue_stream_equals_replay(spark, tmp_path):
    from plumbline.plans import seeded as S
    from plumbline.streaming import queue as Q

    jobs = S.jobs(spark, SF).select("job_id", "at", "code")
    jobs.repartition(1).sortWithinPartitions("at").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(jobs.schema).parquet(str(tmp_path / "in"))
    q = Q.transitions(stream).writeStream.format("memory").queryName("moves").option("checkpointLocation", str(tmp_path / "ck")).start()
    drained(q, jobs.count())
    key = lambda rows: sorted((r["job_id"], r["attempt"], r["status"], str(r["next_at"])) for r in rows)
    want = Q.replay(jobs)
    assert key(spark.table("moves").collect()) == key(want.collect())
    assert {r["status"] for r in Q.state_counts(want).collect()} <= {"queued", "delivered", "failed_permanent"}
    assert Q.claimable(want, pd.Timestamp("2100-01-01")).count() <= 1


def test_backoff_and_cutoff():
    from plumbline.streaming.queue import step

    t, state, waits = pd.Timestamp("2024-01-01"), None, []
    for i in range(9):
        state, row = step(state, t + pd.Timedelta(minutes=i), 503)
        waits.append((row["next_at"] - row["at"]).total_seconds())
    assert waits == [1, 2, 4, 8, 16, 32, 60, 60, 60]
    state, row = step(state, t + pd.Timedelta(days=1), 503)
    assert row["status"] == "failed_permanent" and step(state, t + pd.Timedelta(days=2), 200)[1] is None


def test_windows_stream_equals_batch(spark, tmp_path):
    from plumbline.streaming import tally as W

    events = spark.read.parquet(f"{SF}/events.parquet")
    late = events.limit(1).withColumn("ts", events["ts"] + pd.Timedelta(days=400))
    events.unionByName(late).repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = W.activity(stream).writeStream.format("memory").queryName("acts").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda rows: sorted((str(r["start"]), r["event_type"], r["n"]) for r in rows)
    assert key(spark.table("acts").collect()) == key(W.activity(events).collect())


def test_reports(spark):
    from plumbline.plans import report as R
    from plumbline.plans.scan import scan

    s = scan(spark.createDataFrame([("a.md", "words with a mark​ in them".encode()), ("b.md", b"nothing to see in this one")], "file_id string, content binary"))
    assert sorted(R.FORMATTERS) == ["counts", "json", "text"]
    texts = {r["file_id"]: r["report"] for r in R.as_text(s.reports, s.findings).collect()}
    assert "zero_width_chars" in texts["a.md"] and texts["b.md"].startswith("b.md: sound")
    assert R.as_json(s.reports, s.findings).count() == 2
    assert R.batch_summary(s.reports, s.findings, s.cross).collect()[0]["total_findings"] == 1
    with pytest.raises(ValueError):
        R.formatter("json")(None)
