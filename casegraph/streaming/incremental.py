"""Structured Streaming fronts: weekly counts with late data, sessions, and batches of changed records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 1970-01-05 was a Monday: weeks begin four days after the epoch's.
MONDAY = "4 days"


def read_records(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def weekly_counts(events: DataFrame, at: str, by: str, late: str = "14 days") -> DataFrame:
    """Counts by Monday week; rows later than ``late`` behind the newest are left out."""
    seen = events.withWatermark(at, late) if events.isStreaming else events
    return seen.groupBy(F.window(at, "7 days", startTime=MONDAY), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast("date").alias("week"), by, "n")


def sessions(events: DataFrame, at: str, by: str, gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Sessions that end after ``gap`` without an event."""
    seen = events.withWatermark(at, late) if events.isStreaming else events
    return seen.groupBy(F.session_window(at, gap), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


def each_batch(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Run a function on each batch of new records, to the end of what is there now."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
