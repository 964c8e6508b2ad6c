"""Structured Streaming over trace events (ts a timestamp): windowed timings, repeats dropped, sessions of threads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_timing(events: DataFrame, *, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """window, name, n, total, least, greatest of durations (column dur) by window of event time; events later than the watermark are dropped."""
    agg = events.withWatermark("ts", late).groupBy(F.window("ts", width), "name").agg(F.count(F.lit(1)).alias("n"), F.sum("dur").alias("total"), F.min("dur").alias("least"), F.max("dur").alias("greatest"))
    return agg.select(F.col("window.start").alias("start"), "name", "n", "total", "least", "greatest")


def without_repeats(events: DataFrame, *, key: str = "seq", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def session_counts(events: DataFrame, *, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """start, end, tid, n of sessions without a pause of over ``gap``."""
    agg = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "tid").agg(F.count(F.lit(1)).alias("n"))
    return agg.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "tid", "n")
