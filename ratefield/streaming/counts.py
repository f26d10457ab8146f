"""Audited counts over a stream of point records: what the batch counts give, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, time: str, key: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Rows per window and key; rows later than the watermark, or without a key, don't count."""
    seen = stream.filter(F.col(key).isNotNull()).withWatermark(time, late)
    counts = seen.groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("events"))
    return counts.select(F.col("w.start").alias("window_start"), key, "events")
