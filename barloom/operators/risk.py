"""Stops, position sizes and liquidity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import series as S
from ..params import RiskParams
from .indicators import true_range


def assess(rows: DataFrame, p: RiskParams = RiskParams()) -> DataFrame:
    """Adds stop, atr, risk_percent, position and shares, and the liquidity of the last 20 rows."""
    c = F.col("close")
    df = rows.withColumn("_tr", true_range())
    df = df.withColumn("_atr", F.coalesce("atr_14", S.rolling(F.avg, F.col("_tr"), 14))).withColumn("_atr", F.when(F.col("_atr") > 0, F.col("_atr")))
    stop = F.bround(c - F.col("_atr") * p.atr_multiplier, 2)
    df = df.withColumns({"stop_loss": stop, "atr": F.bround("_atr", 2), "risk_percent": F.bround(F.col("_atr") * p.atr_multiplier / c * 100, 2)})
    amount = p.capital * p.risk_percent / 100
    sized = (F.col("stop_loss") > 0) & (c > F.col("stop_loss"))
    value = amount / (c - F.col("stop_loss")) * c
    value = F.when(sized, F.least(value, F.lit(p.capital * p.most_percent / 100)))
    recent = S.last(20)
    df = df.withColumns({"position_value": F.bround(value), "position_percent": F.bround(value / p.capital * 100, 1), "shares": F.bround(value / c), "avg_volume": F.avg("volume").over(recent), "avg_turnover": F.avg(F.col("volume") * c).over(recent)})
    return df.withColumn("liquid", (F.col("avg_volume") >= p.min_volume) & (F.col("avg_turnover") >= p.min_turnover)).drop("_tr", "_atr")
