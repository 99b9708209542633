"""Structured Streaming over event tables: windows, sessions and running label counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 day", ts: str = "ts", label: str = "event_type") -> DataFrame:
    """(start, label, n, value): counts and sums per window; works on streams and on tables."""
    base = events.withWatermark(ts, late) if events.isStreaming else events
    win = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = base.groupBy(win.alias("w"), label).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("w.start").alias("start"), label, "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day", ts: str = "ts", user: str = "user_id") -> DataFrame:
    """(user, start, end, n): runs of events with gaps below ``gap``."""
    base = events.withWatermark(ts, late) if events.isStreaming else events
    out = base.groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count(F.lit(1)).alias("n"))
    return out.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_to_end(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drive a stream over what is there and read its in-memory result."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
