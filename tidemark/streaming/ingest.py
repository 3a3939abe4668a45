"""Streaming landing of levels and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.ingest import LEVELS


def level_stream(spark: SparkSession, folder: str, late: str = "7 days") -> DataFrame:
    """Level files as they arrive; a (series, date) that has come before within the watermark is dropped."""
    rows = spark.readStream.schema(LEVELS).parquet(folder).withColumn("ts", F.col("date").cast("timestamp"))
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["series_id", "date"]).drop("ts")


def land_stream(levels: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append what is new to a level table; the checkpoint makes a restarted run go on where it stopped."""
    return levels.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and sums per window and type; works on streams and on tables."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
