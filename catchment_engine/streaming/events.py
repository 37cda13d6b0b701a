"""Windowed aggregates over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """A stream of Parquet files of the given table's schema."""
    return spark.readStream.schema(like.schema).parquet(folder)


def windowed_value(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window_start, event_type, n, value): tumbling windows, late events up to a watermark.
    On a static table the same plan gives the same rows."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("window_start"), "event_type", "n", "value")
