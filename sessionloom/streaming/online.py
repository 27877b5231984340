"""Streaming forms of the log operators (beyond the batch ones): they run on any streaming DataFrame with an event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_searches(events: DataFrame, time: str = "time", late: str = "1 hour") -> DataFrame:
    """The first event of each search id within the watermark; the state is bounded by it."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(["search_id"])


def gap_sessions(events: DataFrame, time: str = "time", gap: str = "5400 seconds", late: str = "1 hour") -> DataFrame:
    """uid, start, end, n of time-gap sessions, written when the watermark has passed them."""
    w = F.session_window(time, gap)
    return events.withWatermark(time, late).groupBy("uid", w).agg(F.count(F.lit(1)).alias("n")).select("uid", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def event_counts(events: DataFrame, time: str = "time", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, width), "type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "type", "n")
