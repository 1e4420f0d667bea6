"""Streaming counterparts (an extension): tumbling chunk counts and session merges with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunk_counts(events: DataFrame, time: str, keys: list[str], size: str, late: str) -> DataFrame:
    """keys, start, end, n: events in each tumbling chunk; events later than `late` behind the newest go."""
    counts = events.withWatermark(time, late).groupBy(*keys, F.window(time, size).alias("_w")).agg(F.count("*").alias("n"))
    return counts.select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n")


def sessions(events: DataFrame, time: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """keys, start, end, n: runs of events with less than `gap` between them."""
    found = events.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap).alias("_w")).agg(F.count("*").alias("n"))
    return found.select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n")
