"""Bars and the tables around them, derived from the star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OTHER_SECTOR = "Lainnya"
#: Rows of a partition of bars that grow with the tables, on average at most.
ROWS = 250_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ohlcv(ticks: DataFrame, key: Column, day: Column, price: str, volume: Column, order: list[str]) -> DataFrame:
    """One bar for each key and day: first, highest, lowest and last price, and the volume. order: total up to equal prices."""
    at = F.struct(*order, price)
    return ticks.groupBy(key.alias("ticker"), day.alias("date")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), volume.alias("volume")
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every parts row has one brand, so the join adds a column; the small side is for Spark to choose by size."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    lines = read(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    return lines.join(part, lines["l_partkey"] == part["p_partkey"])


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_trunc("week", "l_shipdate").cast("date")
    return ohlcv(trades(spark, sf_dir), F.col("p_brand"), day, "l_extendedprice", F.sum("l_quantity"), ["l_shipdate", "l_orderkey", "l_linenumber"])


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ohlcv(trades(spark, sf_dir), F.col("p_brand"), F.col("l_shipdate").cast("date"), "l_extendedprice", F.sum("l_quantity"), ["l_shipdate", "l_orderkey", "l_linenumber"])


def by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars with a supplier as ticker: a panel that grows with the tables, in tickers as well as in days. Placed by ticker, in as many partitions as
    bound the rows of one, since plans over a series sort wide rows several times in a task."""
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    parts = max(spark.sparkContext.defaultParallelism, -(-lines.count() // ROWS))  # counted from the files' footers
    lines = lines.withColumns({"ticker": F.col("l_suppkey").cast("string"), "date": F.col("l_shipdate").cast("date")}).repartition(parts, "ticker", "date")
    b = ohlcv(lines, F.col("ticker"), F.col("date"), "l_extendedprice", F.sum("l_quantity"), ["l_shipdate", "l_orderkey", "l_linenumber"])
    return b.repartition(parts, "ticker")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of event values by the hour; date is the hour."""
    return ohlcv(read(spark, sf_dir, "events"), F.col("event_type"), F.date_trunc("hour", "ts"), "value", F.count("*").cast("double"), ["ts", "event_id"])


def market_index(bars: DataFrame) -> DataFrame:
    """Mean close of all tickers by date; one row for each date."""
    return bars.groupBy("date").agg(F.avg("close").alias("close"), F.sum("volume").alias("volume")).withColumn("symbol", F.lit("ALL"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dividend events: ticker, date, event_type, dividend_yield."""
    lines = read(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select("l_orderkey", "l_partkey", "l_discount")
    orders = read(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_orderdate")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(part, lines["l_partkey"] == part["p_partkey"])
    return rows.groupBy(F.col("p_brand").alias("ticker"), F.col("o_orderdate").cast("date").alias("date")).agg(F.lit("DIVIDEND").alias("event_type"), (100 * F.max("l_discount")).alias("dividend_yield"))


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, sector: the brand's most frequent type, the first in order on ties."""
    n = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("ticker"), F.col("p_type").alias("sector")).agg(F.count("*").alias("n"))
    first = Window.partitionBy("ticker").orderBy(F.desc("n"), "sector")
    return n.withColumn("_r", F.row_number().over(first)).filter("_r = 1").select("ticker", "sector")
