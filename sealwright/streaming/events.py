"""Structured Streaming over event tables. An addition: the specification has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, time: str = "ts", keys: list[str] = (), width: str = "10 minutes", late: str | None = "1 hour") -> DataFrame:
    """Counts and sums for each tumbling window; state is dropped once the watermark has passed a window.

    ``late=None`` keeps the watermark that the events have already.
    """
    marked = events if late is None else events.withWatermark(time, late)
    return marked.groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, time: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))


def deduplicated(events: DataFrame, ident: str = "event_id", time: str = "ts", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([ident])
