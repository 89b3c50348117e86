"""The master dataset: every ticker's features, bucketed and sorted by ticker, so that windows and joins by ticker need no exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import indicators
from ..operators.validate import long_enough


def features(bars: DataFrame, least: int = 50) -> DataFrame:
    """Indicators and label of tickers with enough bars, rows without all of them left out."""
    return long_enough(indicators.classic(bars), least).dropna()


def write(rows: DataFrame, path: str, table: str, buckets: int = 8, key: str = "ticker", order: str = "date") -> None:
    """One file a bucket: the shuffle before the write deals rows as the buckets do. An earlier table of that name is replaced."""
    spark = rows.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    rows.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key, order).option("path", path).saveAsTable(table)


def register(spark: SparkSession, path: str, table: str, schema: str, buckets: int = 8, key: str = "ticker", order: str = "date") -> DataFrame:
    """A dataset that another session wrote, under a name in this one."""
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.sql(f"CREATE TABLE {table} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({order}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)
