"""Structured Streaming forms of batch operators over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, ts: str, key: str, every: str = "6 hours", late: str = "1 day") -> DataFrame:
    """start, key, n: counts by window and key; on a stream, late rows beyond the watermark are dropped."""
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("__ts", late)
    return timed.groupBy(F.window("__ts", every).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")
