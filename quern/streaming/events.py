"""Structured Streaming: counters, windows, sessions, tailing. State by key is in ``keyed``.

Batches are written below their number, so a batch that is tried again replaces what it wrote before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet", files: int = 1) -> DataFrame:
    """The events of the files in a folder, as they come; ts becomes a timestamp, so that watermarks work."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def counts(events: DataFrame) -> DataFrame:
    """Running counts by type; use with update or complete mode."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts by event-time window and type; state older than the watermark is dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(s, "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def unique(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def tail(events: DataFrame, level: list[str]) -> DataFrame:
    return events.where(F.col("event_type").isin(level))


def run_to_table(stream: DataFrame, checkpoint: str, mode: str, write: Callable[[DataFrame, int], None]) -> None:
    """Process what is there now, then stop; the checkpoint lets the next run go on."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()


def appended(out: str) -> Callable[[DataFrame, int], None]:
    """A writer of batches below their numbers."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    return write
