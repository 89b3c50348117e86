"""Bars from a stream of events, and their upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def bars(stream: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """One bar for each type and window. Events later than the watermark are left out, and closed windows leave the state."""
    at = F.struct("ts", "event_id", "value")
    rows = stream.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), F.col("event_type").alias("ticker"))
    out = rows.agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").cast("double").alias("volume"))
    return out.select("ticker", F.col("w.start").alias("date"), "open", "high", "low", "close", "volume")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """A user's events with no gap longer than `gap`."""
    rows = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return rows.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value")


def first_writes(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """The first event of each id counts."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def upsert(path: str, partition: str = "ticker"):
    """A foreachBatch function that replaces the partitions of the tickers in a batch, so that a repeated batch changes nothing.

    rows: the complete new rows of those tickers."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)

    return write
