"""Windows over event streams; the same functions serve batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(events: DataFrame, delay: str | None) -> DataFrame:
    return events.withWatermark("ts", delay) if delay and events.isStreaming else events


def tumbling(events: DataFrame, size: str, delay: str | None = "1 hour") -> DataFrame:
    """(start, end, event_type, n, total) per window; a stream drops events later than the delay."""
    return sliding(events, size, size, delay)


def sliding(events: DataFrame, size: str, slide: str, delay: str | None = "1 hour") -> DataFrame:
    out = _late(events, delay).groupBy(F.window("ts", size, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select("w.start", "w.end", "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, delay: str | None = "1 hour") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events with less than `gap` between neighbours."""
    out = _late(events, delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", "w.start", "w.end", "n")
