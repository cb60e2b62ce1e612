"""Windowed event aggregates with late data, over a table or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET = "1 hour"


def event_buckets(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Count and sum of values by event type and hour; the same code runs on a table or a stream."""
    rows = events.select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    out = rows.groupBy("event_type", F.window("ts", BUCKET)).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("bucket"), "n", F.round("total", 4).alias("total"))
