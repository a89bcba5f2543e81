"""Structured Streaming over the event log: windowed counts, sessions, latest job state (beyond the reference)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, files_a_trigger: int = 4) -> DataFrame:
    """A stream of the parquet files that land in `folder`; ts as a timestamp for watermarks."""
    raw = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and value per type and tumbling window; rows later than `late` are dropped."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "events", "value")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Activity sessions per user: a session ends after `gap` without an event."""
    s = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def latest_state(stream: DataFrame) -> DataFrame:
    """The latest status of each job, as an update-mode aggregate."""
    return stream.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("r")).select("user_id", F.col("r.event_type").alias("status"), F.col("r.ts").alias("ts"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; exactly once by the checkpoint folder."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
