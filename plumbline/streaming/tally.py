"""Event-time tallies of scans: windows with a watermark, daily visitors, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Event time as a timestamp (watermarks take no other kind), with a watermark on streams."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", late) if events.isStreaming else e


def activity(events: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """events(ts, event_type, value) -> start, event_type, n, value; the same on streams and on tables."""
    e = _timed(events, late)
    g = e.groupBy(F.window("ts", window, slide or window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "value")


def visitors(events: DataFrame, salt: str, late: str = "1 day") -> DataFrame:
    """Estimated distinct visitors of each day, by a sketch: state stays small however many there are."""
    day = F.window("ts", "1 day")
    who = F.sha2(F.concat_ws("/", F.lit(salt), F.col("user_id").cast("string")), 256)
    e = _timed(events, late)
    g = e.groupBy(day.alias("d")).agg(F.count("*").alias("n"), F.approx_count_distinct(who).alias("n_visitors"))
    return g.select(F.to_date("d.start").alias("day"), "n", "n_visitors")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "2 hours") -> DataFrame:
    e = _timed(events, late)
    g = e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), "n")


def once_a_day(events: DataFrame, late: str = "1 day") -> DataFrame:
    """The first scan of each visitor and day; state is dropped with the watermark."""
    e = _timed(events, late).withColumn("day", F.to_date("ts"))
    return e.dropDuplicatesWithinWatermark(["day", "user_id"]) if e.isStreaming else e.dropDuplicates(["day", "user_id"])
