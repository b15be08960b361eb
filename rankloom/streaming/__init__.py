"""Windowed popularity of a stream (an extension: the batch operator counts a log)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_popularity(events: DataFrame, item: str, ts: str = "ts", length: str = "90 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """(window_start, window_end, item, score): events of an item in sliding windows; `late` bounds the state kept."""
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, length, slide).alias("w"), F.col(item)).agg(F.count("*").alias("score"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), item, "score")
