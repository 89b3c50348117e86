"""Kernels over ordered series and cross-sections, all as window expressions.

A series is all rows of a ticker in date order, a cross-section all rows of a date. Plans that use several kernels
are partitioned by ticker once (`by_series`), which all their windows then share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY, ORDER = "ticker", "date"
#: Rows of a block of the exponential kernel: r^-BLOCK stays far from overflow for spans from 5 up, and r^(3 BLOCK) is nothing for spans up to 400.
BLOCK = 2048


def by_series(df: DataFrame, key: str = KEY) -> DataFrame:
    return df.repartition(key)


def series(key: str = KEY, order: str = ORDER):
    return Window.partitionBy(key).orderBy(order)


def so_far(key: str = KEY, order: str = ORDER):
    return series(key, order).rowsBetween(Window.unboundedPreceding, 0)


def last(n: int, key: str = KEY, order: str = ORDER):
    return series(key, order).rowsBetween(-(n - 1), 0)


def before(n: int, key: str = KEY, order: str = ORDER):
    return series(key, order).rowsBetween(-n, -1)


def section(order: str = ORDER):
    return Window.partitionBy(order)


def whole(key: str = KEY):
    return Window.partitionBy(key)


def lag(c: str | Column, k: int = 1) -> Column:
    return F.lag(c, k).over(series())


def lead(c: str | Column, k: int = 1) -> Column:
    return F.lead(c, k).over(series())


def row(key: str = KEY, order: str = ORDER) -> Column:
    return F.row_number().over(series(key, order))


def rolling(fn, c: Column, n: int, least: int | None = None) -> Column:
    """fn over the last n rows; null unless at least `least` (n by default) of them are not null."""
    return F.when(F.count(c).over(last(n)) >= (n if least is None else least), fn(c).over(last(n)))


def change(c: str, p: int = 1) -> Column:
    old = lag(c, p)
    return F.when(old != 0, F.col(c) / old - 1)


def forward_return(c: str, h: int) -> Column:
    return F.when(F.col(c) > 0, (lead(c, h) - F.col(c)) / F.col(c))


def exponential(df: DataFrame, wanted: dict[str, tuple[Column, float, Column, Column]]) -> DataFrame:
    """Adds recursive averages y_k = a x_k + (1 - a) y_(k-1).

    wanted: name -> (x, a, whether the row is the one that starts the series with y = x, whether y is shown).
    x must be null before the start and not null after it. In closed form y_k = r^k * sum(c_i x_i r^-i) with r = 1 - a;
    rows are cut into blocks so that r^-i can't overflow, and the sums of the two blocks before carry over.
    """
    df = df.withColumn("_at", row() - 1).withColumn("_block", F.floor(F.col("_at") / BLOCK)).withColumn("_in", F.col("_at") - F.col("_block") * BLOCK)
    own = Window.partitionBy(KEY, "_block").orderBy(ORDER).rowsBetween(Window.unboundedPreceding, 0)
    blocks = Window.partitionBy(KEY).orderBy("_block")
    terms, out = {}, {}
    for name, (x, a, first, shown) in wanted.items():
        r = 1 - a
        terms[f"_t_{name}"] = F.when(first, x).otherwise(a * x) * F.pow(F.lit(r), -F.col("_in"))
    df = df.withColumns(terms)
    for name, (x, a, first, shown) in wanted.items():
        r, t = 1 - a, F.col(f"_t_{name}")
        total = F.sum(t).over(own) * F.pow(F.lit(r), F.col("_in"))
        for back in (1, 2):
            carried = F.coalesce(F.sum(t).over(blocks.rangeBetween(-back, -back)), F.lit(0.0))
            total = F.coalesce(total, F.lit(0.0)) + carried * F.pow(F.lit(r), F.col("_in") + back * BLOCK)
        out[name] = F.when(shown, total)
    return df.withColumns(out).drop("_at", "_block", "_in", *terms)


def share_below(c: str, n: int, least: int) -> Column:
    """Percentage of the last n rows' values (nulls left out) that are strictly below this row's; null unless more than `least`."""
    held = F.collect_list(c).over(last(n))
    return F.when(F.col(c).isNotNull() & (F.size(held) > least), 100.0 * F.size(F.filter(held, lambda v: v < F.col(c))) / F.size(held))


def percent_rank(c: str, keys: list[str]) -> Column:
    """Average rank from 0 to 1 among the values that are not null."""
    w = Window.partitionBy(*keys)
    ties = F.count(c).over(Window.partitionBy(*keys, c))
    return F.when(F.col(c).isNotNull(), (F.rank().over(w.orderBy(F.col(c).asc_nulls_last())) + (ties - 1) / 2) / F.count(c).over(w))


def average_rank(c: str, keys: list[str]) -> Column:
    w = Window.partitionBy(*keys)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, c))
    return F.rank().over(w.orderBy(c)) + (ties - 1) / 2


def run_length(flag: Column) -> Column:
    """How many rows up to this one have the flag without a break."""
    n = row()
    return n - F.coalesce(F.max(F.when(~F.coalesce(flag, F.lit(False)), F.col("_n"))).over(so_far()), F.lit(0))


def sums_below(per: DataFrame, keys: list[str], column: str, values: list[str], cells: int = 64) -> DataFrame:
    """Adds below_<value>: the sum of a value over the rows of the same keys with a smaller `column`; without a task for each key. per: one row for each of keys (at least
    one) and column, none null. Keys are cut into cells between quantiles of their rows, which are summed within and over cells."""
    edges = per.groupBy(*keys).agg(F.percentile_approx(column, [i / cells for i in range(1, cells)], 10 * cells).alias("_e"))
    per = per.join(edges, keys).withColumn("_b", F.size(F.filter("_e", lambda e: e < F.col(column)))).drop("_e")
    before = Window.unboundedPreceding, -1
    over = Window.partitionBy(*keys).orderBy("_b").rowsBetween(*before)
    totals = per.groupBy(*keys, "_b").agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
    totals = totals.select(*keys, "_b", *[F.coalesce(F.sum(f"_s_{v}").over(over), F.lit(0)).alias(f"_base_{v}") for v in values])
    own = Window.partitionBy(*keys, "_b").orderBy(column).rowsBetween(*before)
    per = per.withColumns({f"_in_{v}": F.coalesce(F.sum(v).over(own), F.lit(0)) for v in values}).join(totals, [*keys, "_b"])
    return per.withColumns({f"below_{v}": F.col(f"_in_{v}") + F.col(f"_base_{v}") for v in values}).drop("_b", *[f"{x}_{v}" for x in ("_in", "_base") for v in values])
