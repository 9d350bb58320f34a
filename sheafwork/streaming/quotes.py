"""Structured Streaming over landing tables: tumbling and session windows with watermarks. An addition of this engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sheafwork.session import shared_path


def landing(spark: SparkSession, sf_dir: str, name: str, time: str) -> DataFrame:
    """A table as a stream of files, its time column as UTC timestamp (watermarks reject zoneless ones)."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    glob = f"{sf_dir}/{name}.parque[t]"  # a pattern, as a stream's source may be a file or a folder of parts
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(glob).withColumn(time, F.col(time).cast("timestamp"))


def run(stream: DataFrame, label: str) -> DataFrame:
    """Process all that has landed, append to a table in the shared folder, and read it."""
    spark = stream.sparkSession
    out, state = shared_path(spark, label), shared_path(spark, f"{label}-state")
    stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def tumbling(events: DataFrame, time: str, key: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events by window and key; windows the watermark has not passed stay open."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("events"))
    return counted.select(F.col("w.start").alias("start"), key, "events")


def sessions(events: DataFrame, time: str, key: str, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Events by session of a key: a session ends after `gap` without an event."""
    counted = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("events"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), key, "events")
