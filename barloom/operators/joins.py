"""As-of and interval joins.

An as-of join unions events with the bars of their ticker and carries the last bar forward within the ticker's order: one shuffle,
no pairs of events and bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(events: DataFrame, bars: DataFrame, values: list[str], strict: bool = False, tolerance_days: int | None = None) -> DataFrame:
    """Adds bar_date and the values of the last bar on or before (strict: before) an event's date; nulls if there is none
    or it is more than the tolerance old. events and bars: ticker, date."""
    held = F.struct(F.col("date").alias("bar_date"), *[F.col(v).alias(f"bar_{v}") for v in values])
    e = events.select("ticker", "date", F.lit(0 if strict else 2).alias("_side"), F.struct(*events.columns).alias("_event"))
    b = bars.select("ticker", "date", F.lit(1).alias("_side"), held.alias("_bar"))
    rows = e.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy("ticker").orderBy("date", "_side").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_last", F.last("_bar", ignorenulls=True).over(w)).filter("_event is not null")
    if tolerance_days is not None:
        rows = rows.withColumn("_last", F.when(F.datediff("date", F.col("_last.bar_date")) <= tolerance_days, F.col("_last")))
    return rows.select("_event.*", "_last.bar_date", *[f"_last.bar_{v}" for v in values])


def within(rows: DataFrame, ranges: DataFrame, day: Column, otherwise: int = 1) -> DataFrame:
    """Adds the fold whose range holds the day, else the default. ranges: fold, fold_start, fold_end; one row for each fold."""
    r = F.broadcast(ranges)
    out = rows.withColumn("_day", day).join(r, (F.col("_day") >= r["fold_start"]) & (F.col("_day") <= r["fold_end"]), "left")
    return out.withColumn("fold", F.coalesce("fold", F.lit(otherwise))).drop("_day", "fold_start", "fold_end")
