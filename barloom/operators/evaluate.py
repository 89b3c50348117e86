"""Walk-forward evaluation of learned scores: purged folds, scored as one table, and their measures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import series as S
from ..params import BacktestParams, LearnParams
from . import folds, learn, metrics

#: Scores rows: adds p, the probability of the target.
Scorer = Callable[[DataFrame], DataFrame]


def split(panel: DataFrame, p: LearnParams = LearnParams()) -> DataFrame:
    """The panel's rows with fold and part (train or test); a row trains for every later fold. The last dates before a test block are left out, as their
    returns reach into it. The panel is kept, as its dates are read before its rows."""
    panel = panel.persist()
    parts = folds.time_splits(panel, p.splits, p.purge).withColumnRenamed("split", "fold")
    return panel.join(F.broadcast(parts), "date")  # a row for each date and fold


def trees(train: DataFrame) -> Scorer:
    model = learn.classifier().fit(learn.weighted(train))
    return lambda rows: model.transform(rows).withColumn("p", learn.probability())


def binned(feature: str = "rsi_14_cs_rank", bins: int = 10, prior: float = 1.0) -> Callable[[DataFrame], Scorer]:
    """A plain model to hold others against: the target's rate in each of equal bins of a feature from 0 to 1, drawn to the middle by `prior` rows of either class."""
    cell = F.least(F.floor(F.col(feature) * bins), F.lit(bins - 1)).cast("int")

    def fit(train: DataFrame) -> Scorer:
        rates = train.groupBy(cell.alias("_bin")).agg(((F.sum("target") + prior) / (F.count("*") + 2 * prior)).alias("p"))  # `bins` rows
        return lambda rows: rows.withColumn("_bin", cell).join(F.broadcast(rates), "_bin", "left").withColumn("p", F.coalesce("p", F.lit(0.5))).drop("_bin")

    return fit


def cross_validated(rows: DataFrame, fit: Callable[[DataFrame], Scorer] = trees, p: LearnParams = LearnParams()) -> DataFrame:
    """The test rows of every fold with p, each scored by a model of its own fold's training rows. rows: `split`, which every fit reads, so persist it. One
    fit a fold; a fold without both classes to train on scores 0.5."""
    known = {r["fold"]: r["k"] for r in rows.filter("part = 'train'").groupBy("fold").agg(F.count_distinct("target").alias("k")).collect()}  # a row a fold
    out = None
    for k in range(1, p.splits + 1):
        train, test = (rows.filter((F.col("fold") == k) & (F.col("part") == part)).drop("part") for part in ("train", "test"))
        scored = fit(train)(test) if known.get(k, 0) > 1 else test.withColumn("p", F.lit(0.5))
        scored = scored.select(*test.columns, "p")
        out = scored if out is None else out.unionByName(scored)
    return out


def average_precision(rows: DataFrame, label: str, score: str, keys: list[str]) -> DataFrame:
    """keys, ap: the mean precision over the steps in recall, thresholds from the highest score down, equal scores taken together."""
    per = rows.groupBy(*keys, score).agg(F.sum(label).alias("_p"), F.count("*").alias("_c"))
    per = S.sums_below(per.withColumn("_down", -F.col(score)), keys, "_down", ["_p", "_c"])
    hits, seen = F.col("below__p") + F.col("_p"), F.col("below__c") + F.col("_c")
    return per.groupBy(*keys).agg((F.sum(F.col("_p") * hits / seen) / F.nullif(F.sum("_p"), F.lit(0))).alias("ap"))


def by_fold(scored: DataFrame, rows: DataFrame) -> DataFrame:
    """fold, train_size, test_size, auc, ap; with one class only 0.5 and 0. rows: `split`."""
    sizes = rows.groupBy("fold").agg(F.count_if(F.col("part") == "train").alias("train_size"), F.count_if(F.col("part") == "test").alias("test_size"))
    auc, ap = metrics.auc(scored, "target", "p", ["fold"]), average_precision(scored, "target", "p", ["fold"])
    one = F.col("auc").isNull()
    out = sizes.join(auc, "fold", "left").join(ap, "fold", "left")
    return out.select("fold", "train_size", "test_size", F.coalesce("auc", F.lit(0.5)).alias("auc"), F.when(one, 0.0).otherwise(F.col("ap")).alias("ap"))


def sharpe(per_fold: DataFrame) -> DataFrame:
    """One row: mean and spread of the folds' areas, and how far the mean lies above chance in spreads."""
    mean, std = F.avg("auc"), F.stddev_pop("auc")
    return per_fold.agg(F.count("*").alias("folds"), mean.alias("mean_auc"), std.alias("std_auc"), ((mean - 0.5) / (std + 1e-6)).alias("sharpe_auc"), F.avg("ap").alias("mean_ap"))


def backtest(scored: DataFrame, p: LearnParams = LearnParams(), b: BacktestParams = BacktestParams()) -> DataFrame:
    """The measures of each fold's signals, rows whose p reaches the threshold; a fold without signals has a row. A hit is a return of at least 0, after fees of at least the fee."""
    r = F.when(F.col("p") >= p.threshold, F.col("return_n3"))
    n = F.count(r)
    return scored.groupBy("fold").agg(
        F.min("date").alias("test_start"), F.max("date").alias("test_end"), n.alias("signals"), F.when(n >= b.min_wins, F.avg((r >= b.fee).cast("int"))).alias("win_rate_net"),
        F.when(n >= b.min_wins, F.avg((r >= 0).cast("int"))).alias("win_rate"), F.when(n >= b.min_values, F.avg(r) - b.fee).alias("expected_value"), F.min(r).alias("worst"),
    )
