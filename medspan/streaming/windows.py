"""Streaming forms of Collapse and Expand: merged intervals and fixed windows over append-only events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def collapse_stream(events: DataFrame, time: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """Merged runs of events less than gap apart, by key: start, end of the last event and count, once the watermark has passed them."""
    session = F.session_window(F.col(time), gap)
    grouped = events.withWatermark(time, late).groupBy(*keys, session)
    return grouped.agg(F.max(time).alias("high"), F.count("*").alias("n")).select(*keys, F.col("session_window.start").alias("low"), "high", "n")


def expand_stream(events: DataFrame, time: str, keys: list[str], width: str, late: str, slide: str | None = None, **aggregates: Column) -> DataFrame:
    """Aggregates of fixed windows, by key."""
    window = F.window(F.col(time), width, slide) if slide else F.window(F.col(time), width)
    aggregated = events.withWatermark(time, late).groupBy(*keys, window).agg(*[c.alias(n) for n, c in (aggregates or {"n": F.count("*")}).items()])
    return aggregated.select(*keys, F.col("window.start").alias("low"), F.col("window.end").alias("high"), *(aggregates or {"n": None}))
