"""Streaming extensions over event files: windowed counts with a watermark, sessions, and keyed merges by batch.

The batch forms of the same aggregations are what the tests hold the streams against.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def events_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, n, value) by tumbling windows; as a stream, events later than the watermark are dropped."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, session_start, session_end, n): a user's events with less than ``gap`` between neighbours."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def merge_batches(stream: DataFrame, target: str, keys: list[str], order: str, checkpoint: str):
    """A query that keeps in ``target`` one version folder per batch with the latest row of each key; replays overwrite."""
    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch if number == 0 else batch.unionByName(spark.read.parquet(f"{target}/version={number - 1}"))
        best = Window.partitionBy(*keys).orderBy(F.desc(order), *[F.desc(c) for c in batch.columns if c not in (*keys, order)])
        rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n").write.mode("overwrite").parquet(f"{target}/version={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
