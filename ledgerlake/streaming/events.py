"""Event streams. The same transformation runs on a batch and on a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hourly_totals(events: DataFrame, watermark: str | None = None) -> DataFrame:
    """Totals of value by event_type and hour: (event_type, hour, n, total). With ``watermark``, late events beyond it are dropped."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", watermark) if watermark else rows
    sums = rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))
    return sums.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("hour"), "n", "total")


def session_totals(events: DataFrame, gap: str = "30 minutes", watermark: str | None = None) -> DataFrame:
    """Totals by user and session: (user_id, started, ended, n, total). A session ends where ``gap`` passes without an event; the reference has no such windows."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", watermark) if watermark else rows
    sums = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"), F.max("ts").alias("last"))
    return sums.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), F.col("last").cast("timestamp_ntz").alias("ended"), "n", "total")


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """A folder of Parquet files as a stream; new files are new events."""
    return spark.readStream.schema(schema).parquet(path)


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Writes what ``stream`` has finished to Parquet at ``path``, once; ``checkpoint`` makes a rerun continue."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path).awaitTermination()


def replay_uploads(uploads: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hands each batch of uploads to ``apply``(batch, number); replacing by period makes a replayed batch harmless."""
    uploads.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
