"""Audit events as a stream: window counts and the latest decision of each key.

The same functions work on batch and streaming DataFrames.  The streaming form
is an addition; late events are dropped after the watermark as usual.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of new Parquet files in a folder."""
    return spark.readStream.schema(EVENTS).parquet(path)


def window_counts(events: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """(event, start, n): events by kind in tumbling windows."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    counts = timed.groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("event")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("event", F.col("w.start").alias("start"), "n")


def latest(events: DataFrame, key: str = "user_id") -> DataFrame:
    """The last event of each key, by time and id; as a stream in update or complete mode."""
    return events.groupBy(key).agg(F.max_by(F.struct("event_type", "ts"), F.struct("ts", "event_id")).alias("e")).select(key, "e.*")


def start(counts: DataFrame, name: str, checkpoint: str, mode: str = "complete"):
    return counts.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
