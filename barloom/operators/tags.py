"""Descriptive observations: tags, how rare they are, how long they last, who else shows them, and a verdict.

Tag ids are fixed values; a tag's number (`value`) is kept beside it, and texts are made from the numbers at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series as S
from ..params import TagParams

#: All tags, in the order in which they are listed. The first two aren't unusual.
TREND = ("TREND_ALIGNMENT_UP", "TREND_ALIGNMENT_DOWN")
TAGS = (
    "VOLUME_SPIKE", "TREND_ALIGNMENT_UP", "TREND_ALIGNMENT_DOWN", "RESISTANCE_BREAKOUT", "SUPPORT_BREAKDOWN", "HIGH_RSI_RELATIVE", "LOW_RSI_RELATIVE",
    "BB_SQUEEZE", "MACD_BULLISH_CROSS", "MACD_BEARISH_CROSS", "EMA50_FAR_ABOVE", "EMA50_FAR_BELOW", "ATR_EXPANSION", "GAP_UP", "GAP_DOWN",
)


def with_history(rows: DataFrame, placed: bool = False) -> DataFrame:
    """Adds `_n`, the row number in its series. placed: rows are partitioned by ticker already."""
    return (rows if placed else S.by_series(rows)).withColumn("_n", S.row())


def evaluate(rows: DataFrame, p: TagParams = TagParams(), placed: bool = False) -> DataFrame:
    """Adds t_<tag> (the tag's number where it applies, else null), all_tags, unusual_tags and unusual_count.

    rows: bars with indicators. Tags need `lookback` rows; percentiles are shares strictly below, over `lookback` rows.
    """
    df = with_history(rows, placed)
    df = df.withColumns({f"_p_{c}": S.share_below(c, p.lookback, 10) for c in ("volume_ratio_20d", "rsi_14", "bb_width")})
    df = df.withColumns({"_top": F.max("high").over(S.before(20)), "_floor": F.min("low").over(S.before(20)), "_ph": S.lag("high"), "_pl": S.lag("low"), "_atrs": S.rolling(F.avg, F.col("atr_14"), 20)})
    c, up, mid, slow = F.col("close"), F.col("ema_9"), F.col("ema_21"), F.col("ema_50")
    m, s = F.col("macd"), F.col("macd_signal")
    # the nearest of the last three rows on the other side decides; on a tie of sides the rise is tested first
    bull, bear = F.lit(None).cast("int"), F.lit(None).cast("int")
    for k in (3, 2, 1):
        pm, ps = S.lag("macd", k), S.lag("macd_signal", k)
        rise, fall = (pm <= ps) & (m > s), (pm >= ps) & (m < s)
        bull, bear = F.when(rise, k).when(fall, None).otherwise(bull), F.when(rise, None).when(fall, k).otherwise(bear)
    far, ratio = (c - slow) / F.nullif(slow, F.lit(0.0)) * 100, F.col("atr_14") / F.nullif(F.col("_atrs"), F.lit(0.0))
    gap_up, gap_down = (F.col("open") - F.col("_ph")) / F.nullif(F.col("_ph"), F.lit(0.0)) * 100, (F.col("open") - F.col("_pl")) / F.nullif(F.col("_pl"), F.lit(0.0)) * 100
    number = {
        "VOLUME_SPIKE": (F.col("_p_volume_ratio_20d") >= p.high, F.col("volume_ratio_20d")),
        "TREND_ALIGNMENT_UP": ((up > mid) & (mid > slow), F.lit(1.0)), "TREND_ALIGNMENT_DOWN": ((up < mid) & (mid < slow), F.lit(1.0)),
        "RESISTANCE_BREAKOUT": (c > F.col("_top"), F.col("_top")), "SUPPORT_BREAKDOWN": (~F.coalesce(c > F.col("_top"), F.lit(False)) & (c < F.col("_floor")), F.col("_floor")),
        "HIGH_RSI_RELATIVE": (F.col("_p_rsi_14") >= p.high, F.col("rsi_14")), "LOW_RSI_RELATIVE": (F.col("_p_rsi_14") <= p.low, F.col("rsi_14")),
        "BB_SQUEEZE": (F.col("_p_bb_width") <= p.low, F.col("_p_bb_width")),
        "MACD_BULLISH_CROSS": (bull.isNotNull(), bull.cast("double")), "MACD_BEARISH_CROSS": (bear.isNotNull(), bear.cast("double")),
        "EMA50_FAR_ABOVE": ((slow > 0) & (far > p.far_percent), far), "EMA50_FAR_BELOW": ((slow > 0) & (far < -p.far_percent), far),
        "ATR_EXPANSION": (ratio >= p.atr_ratio, ratio), "GAP_UP": (gap_up >= p.gap_percent, gap_up), "GAP_DOWN": (gap_down <= -p.gap_percent, gap_down),
    }
    enough = F.col("_n") >= p.lookback
    df = df.withColumns({f"t_{t}": F.when(enough & test, value) for t, (test, value) in number.items()})
    named = F.array(*[F.when(F.col(f"t_{t}").isNotNull(), F.struct(F.lit(t).alias("tag_id"), F.col(f"t_{t}").alias("value"), F.lit(t not in TREND).alias("is_unusual"))) for t in TAGS])
    df = df.withColumn("all_tags", F.filter(named, lambda x: x.isNotNull()))
    df = df.withColumn("unusual_tags", F.transform(F.filter("all_tags", lambda x: x["is_unusual"]), lambda x: x["tag_id"]))
    return df.withColumn("unusual_count", F.size("unusual_tags")).drop("_n", "_top", "_floor", "_ph", "_pl", "_atrs", *[f"_p_{x}" for x in ("volume_ratio_20d", "rsi_14", "bb_width")])


def masks(rows: DataFrame, strict: bool = True) -> DataFrame:
    """Adds m_<tag>: whether a row meets the tag's condition by the whole series at hand (quantiles, not shares below).

    strict: a breakdown and the trends have no condition, so that they always count as new; else their plain meaning is used.
    """
    df, w = rows, S.whole()

    def beyond(c: str, q: float, high: bool) -> Column:
        edge = F.percentile(c, q).over(w)
        return (F.count(c).over(w) > 10) & (F.col(c) >= edge if high else F.col(c) <= edge)

    m, s, c = F.col("macd"), F.col("macd_signal"), F.col("close")
    slow, atrs = F.col("ema_50"), S.rolling(F.avg, F.col("atr_14"), 20)
    ph, pl = S.lag("high"), S.lag("low")
    top, floor_ = S.lag("_top20"), S.lag("_floor20")
    df = df.withColumns({"_top20": S.rolling(F.max, F.col("high"), 20), "_floor20": S.rolling(F.min, F.col("low"), 20)})
    none = F.lit(False)
    tests = {
        "VOLUME_SPIKE": beyond("volume_ratio_20d", 0.9, True), "HIGH_RSI_RELATIVE": beyond("rsi_14", 0.9, True),
        "LOW_RSI_RELATIVE": beyond("rsi_14", 0.1, False), "BB_SQUEEZE": beyond("bb_width", 0.1, False), "RESISTANCE_BREAKOUT": c > top,
        "SUPPORT_BREAKDOWN": none if strict else c < floor_,
        "TREND_ALIGNMENT_UP": none if strict else (F.col("ema_9") > F.col("ema_21")) & (F.col("ema_21") > slow),
        "TREND_ALIGNMENT_DOWN": none if strict else (F.col("ema_9") < F.col("ema_21")) & (F.col("ema_21") < slow),
        "MACD_BULLISH_CROSS": (S.lag("macd") <= S.lag("macd_signal")) & (m > s), "MACD_BEARISH_CROSS": (S.lag("macd") >= S.lag("macd_signal")) & (m < s),
        "EMA50_FAR_ABOVE": (c - slow) / slow * 100 > 5, "EMA50_FAR_BELOW": (c - slow) / slow * 100 < -5,
        "ATR_EXPANSION": (F.count("atr_14").over(w) >= 20) & (F.col("atr_14") / F.nullif(atrs, F.lit(0.0)) >= 1.5),
        "GAP_UP": (F.col("open") - ph) / F.nullif(ph, F.lit(0.0)) * 100 >= 1, "GAP_DOWN": (F.col("open") - pl) / F.nullif(pl, F.lit(0.0)) * 100 <= -1,
    }
    return df.withColumns({f"m_{t}": F.coalesce(test, F.lit(False)) for t, test in tests.items()}).drop("_top20", "_floor20")


def long_form(rows: DataFrame, prefix: str, out: str) -> DataFrame:
    """One row for each series row and tag."""
    pairs = F.array(*[F.struct(F.lit(t).alias("tag_id"), F.col(f"{prefix}{t}").alias(out)) for t in TAGS])
    return rows.select("ticker", "date", F.explode(pairs).alias("x")).select("ticker", "date", "x.tag_id", f"x.{out}")


def rarity(rows: DataFrame, p: TagParams = TagParams(), placed: bool = False) -> DataFrame:
    """ticker, tag_id, occurrences, last_occurrence: over the last rows of the series, without the very last. placed: rows are partitioned by ticker already."""
    recent = Window.partitionBy("ticker").orderBy(F.desc("date"))
    df = (rows if placed else S.by_series(rows)).withColumn("_back", F.row_number().over(recent)).filter(F.col("_back") <= p.rarity_rows)
    df = masks(df)
    hit = lambda t: (F.col("_back") > 1) & F.col(f"m_{t}")
    per = df.groupBy("ticker").agg(
        F.count("*").alias("_rows"),
        *[F.struct(F.count_if(hit(t)).alias("n"), F.max(F.when(hit(t), F.col("date"))).alias("last")).alias(t) for t in TAGS],
    )
    pairs = F.array(*[F.struct(F.lit(t).alias("tag_id"), F.col(t)["n"].alias("n"), F.col(t)["last"].alias("last")) for t in TAGS])
    return per.filter("_rows >= 20").select("ticker", F.explode(pairs).alias("x")).select("ticker", "x.tag_id", F.col("x.n").alias("occurrences"), F.col("x.last").alias("last_occurrence"))


def streaks(rows: DataFrame) -> DataFrame:
    """ticker, tag_id, streak: rows up to the last that meet the condition without a break, at least 1; 1 for series under 60 rows."""
    df = masks(with_history(rows))
    per = df.groupBy("ticker").agg(F.max("_n").alias("_rows"), *[F.coalesce(F.max(F.when(~F.col(f"m_{t}"), F.col("_n"))), F.lit(0)).alias(t) for t in TAGS])
    pairs = F.array(*[F.struct(F.lit(t).alias("tag_id"), F.when(F.col("_rows") < 60, 1).otherwise(F.greatest(F.lit(1), F.col("_rows") - F.col(t))).cast("long").alias("streak")) for t in TAGS])
    return per.select("ticker", F.explode(pairs).alias("x")).select("ticker", "x.tag_id", "x.streak")


def liquidity_note(turnover: Column) -> Column:
    """Fixed value: ten billion splits liquid from less liquid."""
    return F.when(turnover.isNull() | (turnover <= 0), "n/a").when(turnover >= 1e10, "liquid").otherwise("less liquid")


def opinion(df: DataFrame) -> DataFrame:
    """Adds attention (points), level and headline, from unusual_tags and all_tags. Rules run in order, later ones look at the points so far."""
    has = lambda t: F.array_contains("unusual_tags", t)
    trend = lambda t: F.exists("all_tags", lambda x: x["tag_id"] == t)
    spike = has("VOLUME_SPIKE")
    s = F.when((has("RESISTANCE_BREAKOUT") | has("SUPPORT_BREAKDOWN") | has("BB_SQUEEZE")) & spike, 3).otherwise(0)
    df = df.withColumn("attention", s + F.when(has("MACD_BULLISH_CROSS") | has("MACD_BEARISH_CROSS"), 2).otherwise(0))
    a, high, above, below = F.col("attention"), has("HIGH_RSI_RELATIVE"), has("EMA50_FAR_ABOVE"), has("EMA50_FAR_BELOW")
    df = df.withColumn("attention", a + F.when(high & above, F.when(a < 4, 2).otherwise(0)).when(high | has("LOW_RSI_RELATIVE"), F.when(a < 3, 1).otherwise(0)).otherwise(0))
    df = df.withColumn("attention", a + F.when((above | below) & (a < 3), 1).otherwise(0))
    df = df.withColumn("attention", a + F.when(has("ATR_EXPANSION") & (a < 3), 2).otherwise(0))
    df = df.withColumn("attention", a + F.when((has("GAP_UP") | has("GAP_DOWN")) & (a < 2), 1).otherwise(0))
    rules = [
        (has("RESISTANCE_BREAKOUT") & spike, "BREAKOUT_VOLUME"), (has("SUPPORT_BREAKDOWN") & spike, "BREAKDOWN_VOLUME"), (has("BB_SQUEEZE") & spike, "SQUEEZE_VOLUME"),
        (has("MACD_BULLISH_CROSS") & trend("TREND_ALIGNMENT_UP"), "MACD_BULLISH_TREND"), (has("MACD_BEARISH_CROSS") & trend("TREND_ALIGNMENT_DOWN"), "MACD_BEARISH_TREND"),
    ]
    order = ("RESISTANCE_BREAKOUT", "SUPPORT_BREAKDOWN", "VOLUME_SPIKE", "MACD_BULLISH_CROSS", "MACD_BEARISH_CROSS", "HIGH_RSI_RELATIVE", "LOW_RSI_RELATIVE", "BB_SQUEEZE", "ATR_EXPANSION", "EMA50_FAR_ABOVE", "EMA50_FAR_BELOW", "GAP_UP", "GAP_DOWN")
    head = F.lit("NORMAL")
    for test, name in reversed(rules + [(has(t), t) for t in order]):
        head = F.when(test, name).otherwise(head)
    return df.withColumn("headline", head).withColumn("level", F.when(F.col("attention") >= 5, "HIGH").when(F.col("attention") >= 3, "MEDIUM").otherwise("LOW"))


def breadth(results: DataFrame, universe: int | Column, broad: int = 6) -> DataFrame:
    """tag_id, n, universe, is_broad: how many results carry a tag. results: unusual_tags."""
    n = results.select(F.explode(F.array_distinct("unusual_tags")).alias("tag_id")).groupBy("tag_id").agg(F.count("*").alias("n"))
    return n.withColumns({"universe": universe if isinstance(universe, Column) else F.lit(universe), "is_broad": F.col("n") >= broad})


def sector_peers(results: DataFrame, sectors: DataFrame, other: str) -> DataFrame:
    """ticker, sector, n_peers, peers (the first three in order): other results of the same sector."""
    named = results.select("ticker").join(sectors, "ticker", "left").withColumn("sector", F.coalesce("sector", F.lit(other)))
    w = Window.partitionBy("sector")
    held = named.withColumn("_all", F.array_sort(F.collect_list("ticker").over(w)))
    own = F.filter("_all", lambda t: t != F.col("ticker"))
    known = F.col("sector") != other
    return held.select("ticker", "sector", F.when(known, F.size(own)).otherwise(0).cast("long").alias("n_peers"), F.when(known, F.array_join(F.slice(own, 1, 3), ", ")).otherwise("").alias("peers"))
