"""Information coefficients, correlations and sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series as S


def pearson(rows: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r for each pair of columns, from one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[: i + 1]]
    one = rows.agg(*[F.corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def rank_correlation(rows: DataFrame, a: str, b: str, keys: list[str], least: int = 6) -> DataFrame:
    """Spearman's correlation within each key with at least `least` complete rows; null where a side is constant."""
    rows = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    rows = rows.withColumns({"_a": S.average_rank(a, keys), "_b": S.average_rank(b, keys)})
    per = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("_a", "_b").alias("ic"))
    return per.filter(F.col("n") >= least).withColumn("ic", F.when(~F.isnan("ic"), F.col("ic")))


def ranks_by_counts(rows: DataFrame, column: str, keys: list[str], cells: int = 64) -> DataFrame:
    """Adds rank_<column>: average ranks within few large groups (at least one key), without a task for each. The rank of a value is the number of smaller ones, from
    counts of values, summed within cells and over cells. A group's cells lie between quantiles of its own distinct values, so they are even wherever the values lie. Rows
    with a null or NaN there go."""
    per = rows.filter(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).groupBy(*keys, column).agg(F.count("*").alias("_n"))
    per = S.sums_below(per, keys, column, ["_n"], cells).select(*keys, column, (F.col("below__n") + (F.col("_n") + 1) / 2).alias(f"rank_{column}"))
    return rows.join(per, [*keys, column])


def mean_ic(per_date: DataFrame) -> DataFrame:
    ok = per_date.filter("ic is not null")
    return ok.agg(F.count("*").alias("days"), F.avg("ic").alias("mean_ic"), F.median("ic").alias("median_ic"), F.stddev_pop("ic").alias("std_ic"))


def newey_west(per_date: DataFrame, lags: int = 5, value: str = "ic") -> DataFrame:
    """mean, t: t-statistic of the mean with a Bartlett-weighted long-run variance. One row for each date comes in."""
    w = Window.orderBy("date")
    ok = per_date.filter(F.col(value).isNotNull())
    d = ok.withColumn("_d", F.col(value) - F.avg(value).over(Window.partitionBy(F.lit(0))))
    d = d.withColumns({f"_l{k}": F.col("_d") * F.lag("_d", k).over(w) for k in range(1, lags + 1)})
    one = d.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.sum(F.col("_d") * F.col("_d")).alias("_g0"), *[F.sum(f"_l{k}").alias(f"_g{k}") for k in range(1, lags + 1)])
    total = F.col("_g0") + sum((2 * (1 - k / (lags + 1)) * F.coalesce(F.col(f"_g{k}"), F.lit(0.0)) for k in range(1, lags + 1)), F.lit(0.0))
    return one.select("n", "mean", (F.col("mean") / (F.sqrt(total) / F.col("n"))).alias("t"))


def strong_weak(rows: DataFrame, score: str, most: int, r: str, edge: float) -> DataFrame:
    strong = F.col(score) >= most / 2
    return rows.filter(F.col(r).isNotNull()).groupBy(strong.alias("strong")).agg(F.count("*").alias("n"), F.avg((F.col(r) >= edge).cast("int")).alias("win_rate"))


def horizons(rows: DataFrame, hs: tuple[int, ...], fee: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean forward return by horizon, from one pass over the series. rows: ticker, date, close, _pick (which rows count)."""
    df = S.by_series(rows).withColumns({f"_r{h}": S.forward_return("close", h) for h in hs}).filter("_pick")
    pairs = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_r{h}").alias("r")) for h in hs])
    long = df.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.horizon", "x.r").filter("r is not null")
    return long.groupBy(*keys, "horizon").agg(F.count("*").alias("n"), F.avg("r").alias("ev_gross"), (F.avg("r") - fee).alias("ev_net"), F.avg((F.col("r") > 0).cast("int")).alias("win_rate"))


def fee_table(signals: DataFrame, fees: tuple[float, ...], r: str = "return_n3") -> DataFrame:
    """Net value by fee: fees are literals, beside each signal."""
    x = signals.filter(F.col(r).isNotNull()).agg(F.avg(r).alias("ev_gross"))
    return x.select(F.explode(F.array(*map(F.lit, fees))).alias("fee"), "ev_gross").withColumns({"ev_net": F.col("ev_gross") - F.col("fee"), "fee_to_gross": F.col("fee") / F.nullif(F.abs("ev_gross"), F.lit(0.0))})


def daily_counts(signals: DataFrame, dates: DataFrame) -> DataFrame:
    """One row: signals a day over all dates, days without any included."""
    per = dates.select("date").distinct().join(signals.groupBy("date").agg(F.count("*").alias("n")), "date", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return per.agg(F.count("*").alias("days"), F.avg("n").alias("mean"), F.median("n").alias("median"), F.count_if(F.col("n") >= 1).alias("days_with_any"), F.count_if(F.col("n") >= 5).alias("days_with_5"))
