"""The market scan: indicators, tags, rarity, streaks and context in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import indicators, tags
from ..operators.validate import valid
from ..params import TagParams
from ..sources import files
from ..sources.bars import OTHER_SECTOR


def latest(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy(F.desc("date"))
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def recent(rows: DataFrame, n: int) -> DataFrame:
    """The last n rows of each ticker: indicators need the history, tags of the last row don't look farther back."""
    row, every = Window.partitionBy("ticker").orderBy("date"), Window.partitionBy("ticker")
    return rows.withColumns({"_i": F.row_number().over(row), "_all": F.count(F.lit(1)).over(every)}).filter(F.col("_i") > F.col("_all") - n).drop("_i", "_all")


def observed(bars: DataFrame, p: TagParams = TagParams()) -> DataFrame:
    """Tags of every row of the panel."""
    rows = indicators.compute(valid(bars)).withColumn("turnover_5d", indicators.turnover(3))
    return tags.evaluate(rows, p)


def unusual(bars: DataFrame, as_of: str | None = None, p: TagParams = TagParams(), placed: bool = False) -> DataFrame:
    """Last rows with at least one unusual tag: the most unusual `results` tickers, ties by ticker. placed: bars are partitioned by ticker already, and stay so."""
    bars = bars if as_of is None else bars.filter(F.col("date") <= F.lit(as_of).cast("date"))
    rows = indicators.compute(valid(bars), placed=placed).withColumn("turnover_5d", indicators.turnover(3))
    last = latest(tags.evaluate(recent(rows, p.lookback + 3), p, placed)).filter("unusual_count > 0")
    last = tags.opinion(last).withColumn("liquidity_note", tags.liquidity_note(F.col("turnover_5d")))
    keep = ["ticker", "date", "close", "turnover_5d", "liquidity_note", "unusual_count", "unusual_tags", "all_tags", "attention", "level", "headline"]
    return last.select(*keep).orderBy(F.desc("unusual_count"), "ticker").limit(p.results)


def with_fetches(tickers: DataFrame, have: DataFrame, fetch: Callable[[DataFrame], DataFrame], day: str, most_gap_days: int = 3, most: int = 25) -> DataFrame:
    """The bars at hand and those that one distributed fetch adds for the most stale tickers, `most` a scan. fetch: from a table of tickers to their bars."""
    wanted = files.stale(tickers, have, day, most_gap_days, most)
    new = fetch(wanted).join(wanted, "ticker").filter(F.col("last").isNull() | (F.col("date") > F.col("last"))).filter(F.col("date") <= F.lit(day).cast("date"))
    return have.unionByName(new.drop("last"))


def report(bars: DataFrame, sectors: DataFrame, as_of: str | None = None, p: TagParams = TagParams()) -> DataFrame:
    """The scan with the rarity and streak of each result's first unusual tag, market breadth and sector context."""
    bars = bars if as_of is None else bars.filter(F.col("date") <= F.lit(as_of).cast("date"))
    rows = indicators.compute(valid(bars))
    top = unusual(bars, None, p).withColumn("primary_tag", F.element_at("unusual_tags", 1))
    universe = bars.select("ticker").distinct().agg(F.count("*").alias("universe"))
    per = tags.breadth(top, F.lit(0), p.broad).drop("universe").withColumnRenamed("tag_id", "primary_tag").withColumnRenamed("n", "breadth")
    rare, runs = tags.rarity(rows, p), tags.streaks(rows)
    on = ["ticker", "primary_tag"]
    out = top.join(per, "primary_tag", "left").join(rare.withColumnRenamed("tag_id", "primary_tag"), on, "left").join(runs.withColumnRenamed("tag_id", "primary_tag"), on, "left")
    out = out.join(tags.sector_peers(top, sectors, OTHER_SECTOR), "ticker").withColumn("universe", universe.scalar())
    return out.withColumn("is_rare", F.col("occurrences") <= p.rare)


