"""Incremental ingest: new files only, by a checkpoint, into a Parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest(spark: SparkSession, source: str, schema: str, table: str, checkpoint: str) -> None:
    """Files that came since the last call are appended to the table once; the call returns when all are in."""
    rows = spark.readStream.schema(schema).parquet(source)
    rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", table).trigger(availableNow=True).start().awaitTermination()


def windowed(rows: DataFrame, at: str, length: str, late: str, *by: str, slide: str | None = None) -> DataFrame:
    """(start, by, n): counts of event-time windows, of a stream or a table. A stream's state of a window goes once the watermark passes it, so rows
    that are later than `late` are left out; a table has no late rows."""
    source = rows.withWatermark(at, late) if rows.isStreaming else rows
    window = F.window(at, length, slide) if slide else F.window(at, length)
    return source.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(rows: DataFrame, at: str, gap: str, late: str, by: str) -> DataFrame:
    """(by, start, end, n): events that follow each other within a gap, of a stream or a table."""
    source = rows.withWatermark(at, late) if rows.isStreaming else rows
    return source.groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once_each(rows: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """Rows of a stream, each key once within the watermark; of a table, each key once."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key]) if rows.isStreaming else rows.dropDuplicates([key])
