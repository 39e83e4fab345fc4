"""Event streams: windows with late data, sessions, and the state that changes leave. Times without a zone are read as the session's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, folder: str, pattern: str = "*.parquet", files: int = 1) -> DataFrame:
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def counts(events: DataFrame, width: str = "1 hour", late: str | None = "2 hours") -> DataFrame:
    """Events and their value by window and type, final once the watermark has passed; late is None where there is one already."""
    events = events.withWatermark("ts", late) if late else events
    return events.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, pause: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", pause), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event id once, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
