"""Streams: claims from a folder of relations (claims.py), and mention counts by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events (ts, event_type, value) per window and type; in a stream, windows close `late` after the newest event."""
    if events.isStreaming:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def pattern(path: str) -> str:
    """A path as a pattern: a plain path of a stream can't be a single file."""
    return f"{path[:-1]}[{path[-1]}]"


def counted_stream(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """windowed_counts() of all events that are in a table now, read as a stream; folder keeps its state and each batch's result."""
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(pattern(path))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")

    query = windowed_counts(stream).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    counts = spark.read.parquet(f"{folder}/counts")
    return counts.where(F.col("batch") == counts.agg(F.max("batch")).first()[0]).drop("batch")
