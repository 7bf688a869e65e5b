"""Windows over streams of events: the same plan for batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LATE = "2 hours"


def windowed(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """(hour_start, event_type, events, total) for each window of event time."""
    by = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    return by.select(F.col("w.start").alias("hour_start"), "event_type", "events", "total")


def read_events(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """A stream of parquet files; late rows count up to LATE, repeats of an event within it once."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    # Watermarks need an instant; a time without a zone is read as UTC, the zone of the session.
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"])
