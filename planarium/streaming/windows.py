"""Windowed counts of events, the same function for tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import fixed


def counts(events: DataFrame, size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) by window of event time; late: how long a stream waits for late events."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if late else timed
    grouped = timed.groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n"), fixed(F.sum("value"), 2).alias("total"))
    return grouped.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """(user_id, start, end, n): runs of a user's events with no gap of that length."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if late else timed
    grouped = timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def arriving(spark: SparkSession, folder: str, schema, per_trigger: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream, so many at each trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def arriving_files(spark: SparkSession, folder: str, pattern: str = "*.jpg", per_trigger: int = 1000) -> DataFrame:
    """New panorama files below a folder as a stream of (path, modificationTime, length, content)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_trigger)
    return reader.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
