"""Structured Streaming forms: incremental ingestion, first-seen deduplication, windowed disclosure counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Counts by window and key; rows later than the watermark are left out."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))  # watermarks need a zone
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def first_seen(events: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Exact deduplication with bounded state: repeats within the watermark are dropped."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def ingest_stream(stream: DataFrame, ingest: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs the batch ingestion on whatever is new, once; the checkpoint makes it resumable."""
    stream.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
