"""Rule scorers: every one maps a row and its past to points, for all rows at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series as S
from ..params import ScoreParams


def part(most: int, f: float) -> Column:
    return F.lit(int(most * f))


def rsi(most: int, p: ScoreParams) -> Column:
    now, old = F.col("rsi_14"), S.lag("rsi_14")
    return (
        F.when(now.isNull() | old.isNull(), 0).when(now >= p.rsi_overbought, 0).when((old <= p.rsi_oversold) & (now > old), most)
        .when((now >= p.rsi_mid) & (now > old), part(most, 0.6)).when(now >= p.rsi_mid, part(most, 0.3)).otherwise(0)
    )


def ema(most: int, p: ScoreParams) -> Column:
    a, b, c = F.col("ema_9"), F.col("ema_21"), F.col("ema_50")
    return F.when(c.isNull(), 0).when((a > b) & (b > c), most).when((a > b) & (b < c), part(most, 0.5)).when((a < b) & (b < c), 0).otherwise(part(most, 0.1))


def macd(most: int, p: ScoreParams) -> Column:
    """Days since the cross are the rows just before this one whose difference is above zero."""
    d, d1, d2 = F.col("macd_diff"), S.lag("macd_diff"), S.lag("macd_diff", 2)
    crossed = F.coalesce(F.max(F.when(F.col("macd_diff").isNull() | (F.col("macd_diff") <= 0), F.col("_n"))).over(S.series().rowsBetween(-(1 << 31), -1)), F.lit(0))
    days, faster = F.col("_n") - crossed - 1, (d - d1 > d1 - d2) & (d - d1 > 0)
    fresh = days <= p.macd_cross_window
    return (
        F.when(d2.isNull() | (d <= 0), 0).when(fresh & faster, most).when(fresh, part(most, 0.7)).when(faster, part(most, 0.6)).otherwise(part(most, 0.2))
    )


def volume(most: int, p: ScoreParams) -> Column:
    v = F.col("volume_ratio_20d")
    between = (most * 0.5 + most * 0.5 * (v - p.rvol_moderate) / (p.rvol_spike - p.rvol_moderate)).cast("int")
    return F.when(v.isNull(), 0).when(v >= p.rvol_spike, most).when(v >= p.rvol_moderate, between).when(v >= 1, part(most, 0.1)).otherwise(0)


def bollinger(most: int, p: ScoreParams) -> Column:
    c, up, low, w = (F.col(x) for x in ("close", "bb_upper", "bb_lower", "bb_width"))
    tight = F.coalesce((F.count("bb_width").over(S.last(50)) >= 10) & (w < F.percentile("bb_width", 0.2).over(S.last(50))), F.lit(False))
    at = (c - low) / F.nullif(up - low, F.lit(0.0))
    return (
        F.when(w.isNull(), 0).when((c < low) & tight, most).when(c < low, part(most, 0.8)).when(tight, part(most, 0.6))
        .when(at < 0.3, part(most, 0.4)).when(at < 0.5, part(most, 0.2)).when(c > up, 0).otherwise(part(most, 0.1))
    )


def support_resistance(most: int, p: ScoreParams) -> Column:
    c = F.col("close")
    top, floor_, far = F.max("high").over(S.before(p.sr_short)), F.min("low").over(S.before(p.sr_short)), F.max("high").over(S.before(p.sr_long))
    up, down = (top - c) / c, (c - floor_) / c
    return (
        F.when(F.col("_n") < 20, 0).when((c > top) & (c > far), most).when(c > top, part(most, 0.8)).when(up <= 0.02, part(most, 0.4))
        .when((c > S.lag("close")) & (down <= 0.03), part(most, 0.6)).when(down <= 0.05, part(most, 0.3)).otherwise(part(most, 0.1))
    )


def candle(most: int, p: ScoreParams) -> Column:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    po, pc = S.lag("open"), S.lag("close")
    body, span = F.abs(c - o), F.when(h - l > 0, h - l).otherwise(1.0)
    engulfs = (c > o) & (pc < po) & (o < pc) & (c > po)
    hammer = (body > 0) & (F.least(o, c) - l >= 2 * body) & (h - F.greatest(o, c) <= 0.3 * body) & (c >= o)
    return F.when(F.col("_n") < 2, 0).when(engulfs, most).when(hammer, part(most, 0.8)).when(body / span < 0.1, part(most, 0.3)).otherwise(0)


#: A scorer takes its weight and the parameters and returns a column of points; more may be registered.
SCORERS: dict[str, Callable[[int, ScoreParams], Column]] = {"ema": ema, "volume": volume, "rsi": rsi, "macd": macd, "sr": support_resistance, "bollinger": bollinger, "candle": candle}


def points(indicators: DataFrame, p: ScoreParams = ScoreParams()) -> DataFrame:
    """Adds score_<name> for each weight of the parameters, each between 0 and its weight, and score and signal."""
    df = indicators.withColumn("_n", S.row())
    df = df.withColumns({f"score_{k}": F.greatest(F.lit(0), F.least(F.lit(w), SCORERS[k](w, p))).cast("int") for k, w in p.weights})
    total = sum((F.col(f"score_{k}") for k, _ in p.weights), F.lit(0))
    df = df.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int"))
    return df.withColumn("signal", F.when(F.col("score") >= p.bullish, "BULLISH").when(F.col("score") <= p.bearish, "BEARISH").otherwise("NEUTRAL")).drop("_n")


@dataclass(frozen=True)
class Plugin:
    """A scorer of a user's own: its name, its weight among the others, and the share of its points (0 to 1) that a row gets, as a column."""

    name: str
    weight: float
    share: Callable[[ScoreParams], Column]


def plugged(indicators: DataFrame, plugins: list[Plugin], p: ScoreParams = ScoreParams()) -> DataFrame:
    """As `points`, from plugins alone: their weights are scaled to 100; shares beyond 0 to 1 are cut, null ones give nothing. Windows over a ticker's rows may use _n, the row's number."""
    weights = normalised({x.name: x.weight for x in plugins}, plugins[0].name)
    df = indicators.withColumn("_n", S.row())
    share = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x.share(p), F.lit(0.0))))
    df = df.withColumns({f"score_{x.name}": F.floor(F.lit(weights[x.name]) * share(x) + 1e-9).cast("int") for x in plugins})
    df = df.withColumn("score", sum((F.col(f"score_{x.name}") for x in plugins), F.lit(0)))
    return df.withColumn("signal", F.when(F.col("score") >= p.bullish, "BULLISH").when(F.col("score") <= p.bearish, "BEARISH").otherwise("NEUTRAL")).drop("_n")


def normalised(weights: dict[str, float], rest: str = "ema") -> dict[str, int]:
    """Weights scaled to a total of 100 and cut to integers; what is left goes to one of them."""
    total = sum(weights.values())
    out = {k: int(w / total * 100) for k, w in weights.items()}
    return out | {rest: out[rest] + 100 - sum(out.values())}


def normalised_weights(weights: DataFrame, group: list[str], name: str = "name", weight: str = "weight", rest: str = "ema") -> DataFrame:
    """Weights scaled to a total of 100 in each group and cut to integers; what is left goes to one of them. Groups of no weight go; null weights count as none."""
    own = F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    every = Window.partitionBy(*group)
    out = weights.withColumn("_w", own).withColumn("_total", F.sum("_w").over(every)).filter("_total > 0").withColumn("_cut", F.floor(F.col("_w") / F.col("_total") * 100).cast("int"))
    left = F.when(F.col(name) == rest, 100 - F.sum("_cut").over(every)).otherwise(0)
    return out.select(*group, name, (F.col("_cut") + left).cast("int").alias("weight"))


def contextual(context: DataFrame, rank: str, most: float, least_turnover: float) -> DataFrame:
    """Low rank among liquid rows is bullish, other ranks bearish, rows without rank or turnover neutral."""
    good = F.coalesce(F.col("turnover_5d") >= least_turnover, F.lit(False)) & F.col(rank).isNotNull()
    hit = F.col(rank) <= most
    return context.withColumn("score", F.when(good & hit, 100).otherwise(0)).withColumn("signal", F.when(~good, "NEUTRAL").when(hit, "BULLISH").otherwise("BEARISH"))


def both_ranks(context: DataFrame, strength: float, volume_: float, least_turnover: float) -> DataFrame:
    good = (F.col("turnover_5d") >= least_turnover) & (F.col("rel_strength_5d_rank") <= strength) & (F.col("vol_accum_5d_rank") <= volume_)
    good = F.coalesce(good, F.lit(False))
    return context.withColumn("score", F.when(good, 100).otherwise(0)).withColumn("signal", F.when(good, "BULLISH").otherwise("NEUTRAL"))


def event_score(least_turnover: float, least_yield: float, most_rank: float) -> Column:
    ok = F.coalesce((F.col("turnover_5d") >= least_turnover) & (F.col("dividend_yield") >= least_yield), F.lit(False))
    return F.when(~ok, 0).when(F.col("vol_accum_5d_rank") <= most_rank, 100).otherwise(80)
