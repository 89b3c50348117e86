"""Table writes as set operations: which rows the table holds afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def one_each(rows: DataFrame, keys: list[str], order: str | None, last: bool) -> DataFrame:
    """The first or last row of each key in a batch by `order`, a column that goes then; rows without an order count only where a key has no others. Of rows
    with one order, and without an order column, the values of the other columns decide."""
    others = [c for c in rows.columns if c not in keys and c != order]
    if not others:
        return rows.select(*keys).distinct()
    values = F.struct(*others)
    at = values
    if order:
        known = F.col(order).isNotNull() if last else F.col(order).isNull()  # what is unknown loses either way
        at = F.struct(known.alias("known"), F.col(order).alias("at"), values.alias("values"))
    pick = (F.max_by if last else F.min_by)(values, at)
    return rows.groupBy(*keys).agg(pick.alias("_row")).select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns if c != order])


def last_known(rows: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """Of each key and column the last value that isn't null."""
    others = [c for c in rows.columns if c not in keys and c != order]
    at = lambda c: F.struct(F.col(order).isNotNull().alias("known"), F.col(order).alias("at"), F.col(c).alias("value")) if order else F.struct(F.col(c).alias("value"))
    return rows.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at(c))).alias(c) for c in others])


def insert_or_ignore(table: DataFrame, rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """The first write of a key wins, within the batch as well."""
    return table.unionByName(append_new(table, rows, keys, order))


def insert_or_replace(table: DataFrame, rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """The last write of a key wins, within the batch as well."""
    rows = one_each(rows, keys, order, True)
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def merge_known(table: DataFrame, rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Known values of new rows replace old ones; unknown (null) ones leave them. Of a key that repeats in the batch, each column takes its last known
    value by `order`, without one its greatest."""
    rows = last_known(rows, keys, order)
    new = rows.select(*[F.col(c).alias(f"_new_{c}") for c in rows.columns])
    cond = [table[k] == new[f"_new_{k}"] for k in keys]
    for c in cond[1:]:
        cond[0] = cond[0] & c
    out = table.join(new, cond[0], "full_outer")
    return out.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in rows.columns else F.col(c) for c in table.columns])


def latest_version(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(version))
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def record_signals(signals: DataFrame, found: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """New signals (by ticker, date and version) and the outcome rows that belong to them. Ids follow from the key; a signal that repeats in a batch
    is recorded once, with its least values."""
    rows = one_each(found, ["ticker", "date"], None, False).withColumn("scoring_version", F.lit(version)).withColumn("id", F.xxhash64("ticker", "date", "scoring_version"))
    new = rows.join(signals.select("id"), "id", "left_anti")
    outcomes = new.select(F.col("id").alias("signal_id"), "ticker", F.col("date").alias("signal_date"), F.col("close").alias("price_at_signal"), F.lit(0.003).alias("target_threshold"))
    return new.drop("close"), outcomes


def update_outcomes(outcomes: DataFrame, bars: DataFrame, horizons: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Prices and returns some bars after the signal, and whether the target was met."""
    w = Window.partitionBy("ticker").orderBy("date")
    ahead = bars.select("ticker", F.col("date").alias("signal_date"), *[F.lead("close", h).over(w).alias(f"price_n{h}") for h in horizons])
    out = outcomes.join(ahead, ["ticker", "signal_date"], "left")
    out = out.withColumns({f"return_n{h}": F.col(f"price_n{h}") / F.col("price_at_signal") - 1 for h in horizons})
    return out.withColumn("hit_target", F.col("return_n3") >= F.col("target_threshold"))


def append_new(table: DataFrame, rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """The rows of a batch whose key the table doesn't hold yet, one for each key: what an append writes."""
    return one_each(rows, keys, order, False).join(table.select(*keys), keys, "left_anti")
