"""Continuous statistics with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def windowed_stats(items: DataFrame, every: str = "5 seconds", late: str = "1 minute", ts: str = "ts", key: str = "engine", value: str = "latency") -> DataFrame:
    """Items, sum and maximum by tumbling window and key; works on batch and streaming frames."""
    if items.isStreaming:
        items = items.withWatermark(ts, late)
    return items.groupBy(F.window(ts, every).alias("w"), key).agg(F.count("*").alias("items"), F.sum(value).alias("total"), F.max(value).alias("highest")).select(F.col("w.start").alias("window_start"), key, "items", "total", "highest")


def run_available(spark: SparkSession, folder: str, schema: StructType, sink: str, checkpoint: str, every: str = "5 seconds", files_per_trigger: int = 8) -> StreamingQuery:
    """Works through the files that are there, a bounded number at a time, and ends; a restart goes on where it stopped."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_stats(stream, every).writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
