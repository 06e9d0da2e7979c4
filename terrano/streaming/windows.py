"""Structured Streaming form of the trailing window: late rows beyond the watermark are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily_means(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Mean and count of value by type and day; works on a stream and on a table alike."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    x = e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
    return x.select(F.col("w.start").alias("day"), "event_type", "mean", "n")


def run_once(spark: SparkSession, path: str, out: str, checkpoint: str) -> None:
    """Reads new files of a folder of events, appends finished days to a Parquet folder, and stops."""
    schema = spark.read.parquet(path).schema
    q = daily_means(spark.readStream.schema(schema).parquet(path)).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
    q.awaitTermination()
