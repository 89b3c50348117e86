"""Candle checks, gates and data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series as S


def note() -> Column:
    """The first check that a candle fails; null if it passes. A null volume passes."""
    o, h, l, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    missing = o.isNull() | h.isNull() | l.isNull() | c.isNull()
    return (
        F.when(missing, F.lit("missing price"))
        .when(h < l, F.format_string("high (%.2f) < low (%.2f)", h, l))
        .when((c <= 0) | (o <= 0), F.lit("price not positive"))
        .when(v == 0, F.lit("zero volume"))
    )


def checked(bars: DataFrame) -> DataFrame:
    return bars.withColumn("validation_note", note()).withColumn("is_valid", F.col("validation_note").isNull())


def valid(bars: DataFrame) -> DataFrame:
    """Bad candles go before any window, so that lags skip them."""
    return bars.filter(note().isNull())


def long_enough(df: DataFrame, rows: int, key: str = S.KEY) -> DataFrame:
    return df.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(key))).filter(F.col("_rows") >= rows).drop("_rows")


def prices(bars: DataFrame, ticker: str | None = None, start: str | None = None, end: str | None = None, valid_only: bool = True) -> DataFrame:
    """The price scan: every filter is optional and reaches the source."""
    for given, test in ((ticker, F.col("ticker") == ticker), (start, F.col("date") >= F.lit(start).cast("date")), (end, F.col("date") <= F.lit(end).cast("date"))):
        bars = bars.filter(test) if given is not None else bars
    return valid(bars) if valid_only else bars


def liquid(bars: DataFrame, least: float, days: int = 5) -> DataFrame:
    """Tickers whose mean turnover over the last days is enough."""
    recent = Window.partitionBy("ticker").orderBy(F.desc("date"))
    rows = bars.withColumn("_r", F.row_number().over(recent)).filter(F.col("_r") <= days)
    return rows.groupBy("ticker").agg(F.avg(F.col("close") * F.col("volume")).alias("turnover")).filter(F.col("turnover") >= least)


def profile(rows: DataFrame) -> DataFrame:
    """One row of data-quality counts over bars with relative volume."""
    v, r = F.col("volume"), F.col("volume_ratio_20d")
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(v == 0).alias("zero_volume"), F.count_if(v.isNull()).alias("null_volume"), F.count(r).alias("valid_rvol"), F.count_if(r == 0).alias("zero_rvol"), F.count_if(r < 1).alias("rvol_below_1"))
