"""The delivery queue as a keyed state machine over a stream of attempts.

A job is queued, then delivered, failed for good, or queued again after a wait that grows with
its attempts; it fails for good a day after it was first seen.  One state a job, dropped when
the job ends or its timer runs out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Waits in seconds by attempt, statuses that are tried again, and the time after which a job is given up.
WAITS, AGAIN, GIVE_UP_S = (1, 2, 4, 8, 16, 32, 60), (408, 425, 429), 86_400
OUT = "job_id long, at timestamp, attempt int, status string, next_at timestamp"
STATE = "first double, attempt int, status string"


def outcome(code: int, age_s: float) -> str:
    if code == 200:
        return "delivered"
    if code in AGAIN or code >= 500:
        return "failed_permanent" if age_s >= GIVE_UP_S else "queued"
    return "failed_permanent"


def step(state: tuple | None, at: pd.Timestamp, code: int) -> tuple[tuple, dict | None]:
    """One attempt; attempts of a job that has ended are ignored."""
    first, attempt, status = state or (at.timestamp(), 0, "queued")
    if status != "queued":
        return (first, attempt, status), None
    attempt += 1
    status = outcome(code, at.timestamp() - first)
    wait = pd.Timedelta(seconds=WAITS[min(attempt, len(WAITS)) - 1])
    return (first, attempt, status), {"at": at, "attempt": attempt, "status": status, "next_at": at + wait if status == "queued" else pd.NaT}


def transitions(attempts: DataFrame) -> DataFrame:
    """Stream of attempts(job_id, at, code) -> its state changes, in order of time within a batch."""

    def run(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        old = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        out = []
        for at, code in zip(rows["at"], rows["code"], strict=True):
            old, row = step(old, at, int(code))
            if row:
                out.append({"job_id": key[0]} | row)
        state.update(old)
        state.setTimeoutDuration(60_000 if old[2] != "queued" else GIVE_UP_S * 1000)
        yield pd.DataFrame(out, columns=["job_id", "at", "attempt", "status", "next_at"])

    return attempts.groupBy("job_id").applyInPandasWithState(run, OUT, STATE, "append", "ProcessingTimeTimeout")


def replay(attempts: DataFrame) -> DataFrame:
    """The same over a table: what a stream of all its rows would give."""

    def run(key, rows):
        state, out = None, []
        for at, code in zip(*(rows.sort_values("at", kind="stable")[c] for c in ("at", "code")), strict=True):
            state, row = step(state, at, int(code))
            if row:
                out.append({"job_id": key[0]} | row)
        return pd.DataFrame(out, columns=["job_id", "at", "attempt", "status", "next_at"])

    return attempts.groupBy("job_id").applyInPandas(run, OUT)


def state_counts(changes: DataFrame) -> DataFrame:
    last = changes.groupBy("job_id").agg(F.max_by("status", "attempt").alias("status"))
    return last.groupBy("status").agg(F.count("*").alias("n"))


def claimable(changes: DataFrame, now) -> DataFrame:
    """The queued job that is due soonest at ``now``: one row or none."""
    last = changes.groupBy("job_id").agg(F.max_by(F.struct("status", "next_at"), "attempt").alias("s"))
    return last.where((F.col("s.status") == "queued") & (F.col("s.next_at") <= F.lit(now))).orderBy("s.next_at", "job_id").limit(1).select("job_id", F.col("s.next_at").alias("next_at"))


def recent(changes: DataFrame, n: int = 20) -> DataFrame:
    """The latest ``n`` changes of all jobs, newest first: a top-k, each task keeps n rows."""
    return changes.orderBy(F.desc("at"), F.desc("job_id"), F.desc("attempt")).limit(n)


def next_due(changes: DataFrame) -> DataFrame:
    """next_at: when the soonest of the queued jobs is due, for one who waits; null where none is queued."""
    last = changes.groupBy("job_id").agg(F.max_by(F.struct("status", "next_at"), "attempt").alias("s"))
    return last.agg(F.min(F.when(F.col("s.status") == "queued", F.col("s.next_at"))).alias("next_at"))
