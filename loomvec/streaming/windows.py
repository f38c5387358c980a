"""Windowed aggregates that run the same on a table and on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    """Event times without zone count as UTC's on a stream, where watermarks need a zone."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events


def tumbling(events: DataFrame, ts: str, width: str, value: str, *keys: str, late: str = "10 minutes") -> DataFrame:
    """Count and sum by window and keys; on a stream, events later than ``late`` are dropped."""
    source = _timed(events, ts, late)
    out = source.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, *keys: str, late: str = "10 minutes") -> DataFrame:
    """Session windows: events of a key less than ``gap`` apart belong together."""
    source = _timed(events, ts, late)
    out = source.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")
