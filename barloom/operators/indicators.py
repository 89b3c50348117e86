"""Technical indicators, as one plan over all tickers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import series as S
from .validate import long_enough


def true_range() -> Column:
    c = S.lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - c), F.abs(F.col("low") - c))


def averages(df: DataFrame, spans: tuple[int, ...], value: str = "close", prefix: str = "ema_") -> DataFrame:
    n = F.col("_n")
    return S.exponential(df, {f"{prefix}{s}": (F.col(value), 2 / (s + 1), n == 1, n >= s) for s in spans})


def compute(bars: DataFrame, least: int = 50, placed: bool = False) -> DataFrame:
    """rsi_14, ema_9/21/50, macd with signal and difference, Bollinger bands and width, atr_14 and volume_ratio_20d for
    every bar of tickers with at least `least` bars. Bars are valid ones (`validate.valid`), one for each ticker and date. placed: they are
    partitioned by ticker already, as a bucketed table is."""
    df = long_enough(bars if placed else S.by_series(bars), least).withColumn("_n", S.row())
    n, c = F.col("_n"), F.col("close")
    move = F.coalesce(c - S.lag("close"), F.lit(0.0))
    df = df.withColumn("_up", F.greatest(move, F.lit(0.0))).withColumn("_down", F.greatest(-move, F.lit(0.0))).withColumn("_tr", true_range())
    # Wilder's range starts from the mean of the first 14
    df = df.withColumn("_tr14", F.when(n == 14, F.avg("_tr").over(S.last(14))).when(n > 14, F.col("_tr")))
    df = S.exponential(df, {
        **{f"ema_{s}": (c, 2 / (s + 1), n == 1, n >= s) for s in (9, 21, 50)},
        **{f"_fast{s}": (c, 2 / (s + 1), n == 1, n >= s) for s in (12, 26)},
        "_gain": (F.col("_up"), 1 / 14, n == 1, n >= 14), "_loss": (F.col("_down"), 1 / 14, n == 1, n >= 14),
        "atr_14": (F.col("_tr14"), 1 / 14, n == 14, n >= 14),
    })
    df = df.withColumn("rsi_14", F.when(F.col("_loss") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("_gain") / F.col("_loss")))).withColumn("macd", F.col("_fast12") - F.col("_fast26"))
    df = S.exponential(df, {"macd_signal": (F.col("macd"), 0.2, n == 26, n >= 34)})
    mid, dev = S.rolling(F.avg, c, 20), S.rolling(F.stddev_pop, c, 20)
    df = df.withColumns({"macd_diff": F.col("macd") - F.col("macd_signal"), "_mid": mid, "_dev": dev, "_sma": S.rolling(F.avg, F.col("volume"), 20)})
    df = df.withColumns({"bb_upper": F.col("_mid") + 2 * F.col("_dev"), "bb_lower": F.col("_mid") - 2 * F.col("_dev")})
    width = (F.col("bb_upper") - F.col("bb_lower")) / F.nullif(F.col("_mid"), F.lit(0.0))
    df = df.withColumns({"bb_width": width, "volume_ratio_20d": F.col("volume") / F.nullif(F.col("_sma"), F.lit(0.0))})
    return df.drop("_n", "_up", "_down", "_tr", "_tr14", "_fast12", "_fast26", "_gain", "_loss", "_mid", "_dev", "_sma")


def classic(bars: DataFrame) -> DataFrame:
    """The first generation's indicators and its label: a rise of 5 % to the next high."""
    df = S.by_series(bars).withColumn("_n", S.row())
    df = averages(df, (20, 50, 200))
    c, v = F.col("close"), F.col("volume")
    df = df.withColumns({"true_range": true_range(), "gap_up": (F.col("open") > S.lag("high")).cast("int"), "pct_change": S.change("close"), "vol_sma_20": S.rolling(F.avg, v, 20)})
    df = df.withColumns({"rvol": v / F.nullif(F.col("vol_sma_20"), F.lit(0.0)), "atr_simple": S.rolling(F.avg, F.col("true_range"), 14)})
    df = df.withColumn("volatility_ratio", F.col("true_range") / F.nullif(F.col("atr_simple"), F.lit(0.0)))
    up = S.lead("high") / c - 1
    return df.withColumn("target_momentum", F.when(up.isNotNull(), (up >= 0.05).cast("int"))).drop("_n")


def index_trend(index: DataFrame) -> DataFrame:
    """ret_5d, ret_20d, ma_20 and slope_20d, over the whole history. index: symbol, date, close."""
    df = index.withColumnRenamed("symbol", "ticker")
    df = df.withColumns({"ret_5d": S.change("close", 5), "ret_20d": S.change("close", 20), "ma_20": S.rolling(F.avg, F.col("close"), 20)})
    old = S.lag("ma_20", 5)
    return df.withColumn("slope_20d", (F.col("ma_20") - old) / (old + 1e-8)).withColumnRenamed("ticker", "symbol")


def turnover(least: int = 5) -> Column:
    return S.rolling(F.avg, F.col("close") * F.col("volume"), 5, least)


def context(bars: DataFrame, trend: DataFrame) -> DataFrame:
    """Strength against the index and money flow, ranked over each date. trend: index_trend (one row for each date, joined)."""
    c, h, l, v = (F.col(x) for x in ("close", "high", "low", "volume"))
    df = S.by_series(bars).withColumn("_flow", ((c - l) - (h - c)) / (h - l + 1e-8) * v)
    df = df.withColumns({"ret_5d": S.change("close", 5), "turnover_5d": turnover(5), "vol_accum_5d": S.rolling(F.sum, F.col("_flow"), 5) / (S.rolling(F.sum, v, 5) + 1e-8)})
    df = df.join(trend.select("date", F.col("ret_5d").alias("index_ret_5d")), "date", "left")
    df = df.withColumn("rel_strength_5d", F.col("ret_5d") - F.col("index_ret_5d"))
    df = df.withColumns({f"{x}_rank": 100 * S.percent_rank(x, ["date"]) for x in ("rel_strength_5d", "vol_accum_5d")})
    return df.drop("_flow").filter("rel_strength_5d is not null and vol_accum_5d is not null")
