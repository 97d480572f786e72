"""Event-time operators; each takes a batch or a streaming DataFrame of events (event_id, ts, user_id, event_type, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def on_time(events: DataFrame, lateness: str | None) -> DataFrame:
    """A stream with its watermark; a batch as it is."""
    return events.withWatermark("ts", lateness) if lateness and events.isStreaming else events


def tumbling(events: DataFrame, width: str, lateness: str | None = "10 minutes") -> DataFrame:
    """T5: events and their values by window and type."""
    out = on_time(events, lateness).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str, lateness: str | None = "10 minutes") -> DataFrame:
    out = on_time(events, lateness).groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "event_type", "n")


def sessions(events: DataFrame, gap: str, lateness: str | None = "10 minutes") -> DataFrame:
    """T5: each user's sessions; one ends when nothing comes for the gap."""
    out = on_time(events, lateness).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def once(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Each event_id once; a stream remembers ids for as long as an event may be late."""
    return on_time(events, lateness).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def last_status(events: DataFrame) -> DataFrame:
    """T4: the last event of each user, and how many there were."""
    out = events.groupBy(F.col("user_id").alias("commit_id")).agg(F.max(F.struct("ts", "event_id", "event_type")).alias("l"), F.count("*").alias("changes"))
    return out.select("commit_id", F.col("l.event_type").alias("status"), "changes")
