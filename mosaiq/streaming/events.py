"""Streams of dated events: windows, sessions and late data.  The same functions take a table or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, length: str, slide: str | None = None, late: str = "0 seconds") -> DataFrame:
    """event_type, start, n, total per window.  On a stream, events later than `late` are dropped and their window is closed."""
    # window() of a time without zone keeps it as it is.
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return (rows.groupBy("event_type", w.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
            .select("event_type", F.col("w.start").alias("start"), "n", "total"))


def sessions(events: DataFrame, gap: str, late: str = "0 seconds") -> DataFrame:
    """user_id, start, end, n of each stretch of a user's events without a pause of `gap`."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return (rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
            .select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n"))


def first_seen(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """events without repeats of the keys; a stream remembers keys as long as `late`."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder, as event tables have them.

    Watermarks need a moment in time: ts, which has no zone, is read as the session's zone, which should be UTC."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def write_counts(counts: DataFrame, path: str, checkpoint: str):
    """Appends closed windows as Parquet; with the checkpoint, a restart neither loses nor repeats any."""
    return counts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
