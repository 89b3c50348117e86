"""Walk-forward backtests and event studies: the whole history is scored once, folds only label the dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import series as S
from ..operators import folds, indicators, joins, scorers
from ..operators.validate import long_enough, valid
from ..params import BacktestParams, ContextParams, EventParams, ScoreParams


def with_returns(rows: DataFrame, p: BacktestParams, limit: Column | None = None) -> DataFrame:
    """Adds return_n<h>; an exit after the limit doesn't count."""
    out = {}
    for h in p.horizons:
        r = S.forward_return("close", h)
        out[f"return_n{h}"] = r if limit is None else F.when(S.lead("date", h) <= limit, r)
    return rows.withColumns(out)


def in_folds(rows: DataFrame, bars: DataFrame, p: BacktestParams) -> DataFrame:
    """Rows of test dates with their fold and its end. The table of dates is small."""
    per = folds.walk_forward(bars, p.folds, p.warmup)
    per = per.join(folds.ranges(per), "fold")
    return rows.join(F.broadcast(per), "date", "left")


def labelled(rows: DataFrame, bars: DataFrame, p: BacktestParams) -> DataFrame:
    df = S.by_series(in_folds(rows, bars, p)).withColumn("_n", S.row())
    return with_returns(df, p, F.date_add("fold_end", p.exit_days)).filter((F.col("_n") >= p.warmup) & F.col("fold").isNotNull()).drop("_n", "fold_start", "fold_end")


def hits(df: DataFrame, p: BacktestParams) -> DataFrame:
    edge = p.target_percent / 100
    return df.withColumns({"hit_target": F.col("return_n3") >= edge, "hit_target_net": F.col("return_n3") >= edge + p.fee})


def rules(bars: DataFrame, p: BacktestParams = BacktestParams(), s: ScoreParams = ScoreParams()) -> DataFrame:
    """Signals of the rule score: fold, ticker, date, score, signal, close, returns, hits."""
    bars = valid(bars)
    rows = long_enough(scorers.points(indicators.compute(bars), s), p.warmup)
    out = labelled(rows, bars, p).filter(F.col("score") >= p.min_score)
    return hits(out, p).select("fold", "ticker", "date", "score", "signal", "close", *[f"return_n{h}" for h in p.horizons], "hit_target", "hit_target_net")


def contextual(bars: DataFrame, trend: DataFrame, p: BacktestParams = BacktestParams(), c: ContextParams = ContextParams(), both: bool = False) -> DataFrame:
    """Signals of the contextual engines, by one rank or by both."""
    bars = valid(bars)
    ctx = indicators.context(bars, trend).select("ticker", "date", "turnover_5d", "rel_strength_5d_rank", "vol_accum_5d_rank")
    rows = bars.join(ctx, ["ticker", "date"], "left")
    rows = scorers.both_ranks(rows, c.rank_strength, c.rank_volume, c.min_turnover) if both else scorers.contextual(rows, "rel_strength_5d_rank", c.rank, c.min_turnover)
    return hits(labelled(rows, bars, p).filter("signal = 'BULLISH'"), p).select("fold", "ticker", "date", "score", "signal", "close", *[f"return_n{h}" for h in p.horizons], "hit_target", "hit_target_net")


def entries(bars: DataFrame, window: int) -> DataFrame:
    """Bars with the entry row that lies `window` rows before them."""
    df = S.by_series(bars)
    return df.withColumns({f"entry_{c}": S.lag(c, window) for c in ("date", "close", "turnover_5d")})


def dividends(bars: DataFrame, actions: DataFrame, trend: DataFrame, p: EventParams = EventParams(), b: BacktestParams = BacktestParams()) -> DataFrame:
    """The dividend study: enter `window` rows before the last bar before the ex-date, leave at that bar."""
    bars = valid(bars)
    ctx = indicators.context(bars, trend).select("ticker", "date", "turnover_5d", "vol_accum_5d_rank")
    rows = bars.select("ticker", "date", "close").join(ctx, ["ticker", "date"], "left")
    rows = S.by_series(rows).withColumns({f"entry_{c}": S.lag(c, p.window) for c in ("date", "close", "turnover_5d", "vol_accum_5d_rank")})
    events = actions.filter((F.col("event_type") == "DIVIDEND") & (F.col("dividend_yield") >= p.min_yield)).select("ticker", "date", "dividend_yield")
    out = joins.as_of(events, rows, ["close", "entry_date", "entry_close", "entry_turnover_5d", "entry_vol_accum_5d_rank"], strict=True)
    out = out.filter((F.col("bar_entry_turnover_5d") >= p.min_turnover) & (F.col("bar_entry_close") > 0))
    if p.max_volume_rank < 100:
        out = out.filter(F.col("bar_entry_vol_accum_5d_rank") <= p.max_volume_rank)
    level = trend.select(F.col("date").alias("_d"), F.col("close").alias("_c"))  # one row for each date
    out = out.join(F.broadcast(level.withColumnRenamed("_c", "_in")), F.col("bar_entry_date") == F.col("_d"), "left").drop("_d")
    out = out.join(F.broadcast(level.withColumnRenamed("_c", "_out")), F.col("bar_date") == F.col("_d"), "left").drop("_d")
    out = joins.within(out, folds.ranges(folds.walk_forward(bars, b.folds, b.warmup)), F.col("bar_date"))
    gross = F.col("bar_close") / F.col("bar_entry_close") - 1
    return out.select("ticker", F.col("date").alias("ex_date"), F.col("bar_entry_date").alias("entry_date"), F.col("bar_date").alias("exit_date"), gross.alias("ret_gross"), (gross - b.fee).alias("ret_net"), F.coalesce(F.col("_out") / F.col("_in") - 1, F.lit(0.0)).alias("index_ret"), "dividend_yield", "fold")


def upcoming(bars: DataFrame, actions: DataFrame, as_of: Column, p: EventParams = EventParams()) -> DataFrame:
    """Events on or after a day, with their entry and last day before the ex-date. For ex-dates beyond the last bar that day
    is the last bar known, and is_projected says so."""
    rows = entries(S.by_series(valid(bars)).withColumn("turnover_5d", indicators.turnover(3)), p.window)
    events = actions.filter((F.col("event_type") == "DIVIDEND") & (F.col("dividend_yield") >= p.min_yield) & (F.col("date") >= as_of)).select("ticker", "date", "dividend_yield")
    out = joins.as_of(events, rows, ["close", "entry_date", "entry_close", "entry_turnover_5d"], strict=True)
    last = rows.groupBy("ticker").agg(F.max("date").alias("_last"))
    out = out.filter(F.col("bar_entry_turnover_5d") >= p.min_turnover).join(last, "ticker")
    entry, cum = F.col("bar_entry_date"), F.col("bar_date")
    return out.select("ticker", entry.alias("entry_date"), cum.alias("cum_date"), F.col("date").alias("ex_date"), "dividend_yield", F.col("bar_entry_close").alias("entry_price"), (entry == as_of).alias("is_entry_today"), ((entry <= as_of) & (as_of <= cum)).alias("is_active"), (F.col("date") > F.col("_last")).alias("is_projected"))
