"""Queries of learned scores: evaluation by fold, stored models, search with trials, oversampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as O
from .operators import evaluate, learn, metrics, oversample, tuning
from .operators.models import Models
from .operators.tuning import Integer, Study
from .params import BacktestParams
from .plans import backtest
from .registry import PANEL, bars, ctx, ind, query
from .session import shared_folder

LEARNED = (O.BARS, O.INDICATORS, PANEL)
#: Purged splits of the panel's dates, and test rows scored by the rate of their bin in the training rows.
BINNED = """
pd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM panel)),
sp AS (SELECT fold, date, CASE WHEN pos >= b AND pos < b + n // 6 THEN 'test' WHEN pos < b - 3 THEN 'train' END AS part FROM (SELECT *, n - (6 - fold) * (n // 6) AS b FROM pd, (SELECT unnest(range(1, 6)) AS fold))),
pt AS (SELECT p.*, CAST(fold AS INTEGER) AS fold, part, least(floor(rsi_14_cs_rank * 10), 9) AS bin FROM panel p JOIN sp USING (date) WHERE part IS NOT NULL),
rates AS (SELECT fold, bin, (sum(target) + 1) / (count(*) + 2) AS p FROM pt WHERE part = 'train' GROUP BY 1, 2),
te AS (SELECT fold, target, return_n3, date, CASE WHEN k > 1 THEN coalesce(p, 0.5) ELSE 0.5 END AS p FROM pt LEFT JOIN rates USING (fold, bin) LEFT JOIN (SELECT fold, count(DISTINCT target) AS k FROM pt WHERE part = 'train' GROUP BY 1) USING (fold) WHERE part = 'test'),
g AS (SELECT fold, p, sum(target) AS y, count(*) AS c FROM te GROUP BY 1, 2),
h AS (SELECT *, coalesce(sum(c - y) OVER (PARTITION BY fold ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS less, sum(y) OVER d AS ys, sum(c) OVER d AS cs FROM g WINDOW d AS (PARTITION BY fold ORDER BY p DESC)),
m AS (SELECT fold, sum(y * (less + (c - y) / 2.0::DOUBLE)) / nullif(sum(y) * sum(c - y), 0) AS auc, sum(y * ys / cs) / nullif(sum(y), 0) AS ap FROM h GROUP BY fold),
cv AS (SELECT fold, count(*) FILTER (WHERE part = 'train') AS train_size, count(*) FILTER (WHERE part = 'test') AS test_size, coalesce(any_value(auc), 0.5) AS auc, CASE WHEN any_value(auc) IS NULL THEN 0.0 ELSE any_value(ap) END AS ap FROM pt LEFT JOIN m USING (fold) GROUP BY fold)"""


def _binned(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = evaluate.split(learn.panel(ind(spark, sf))).persist()
    return evaluate.cross_validated(rows, evaluate.binned()), rows


@query("ML-07", O.query("SELECT fold, train_size, test_size, round(auc, 6) AS auc, round(ap, 6) AS ap FROM cv", *LEARNED, BINNED))
def ml07(spark, sf):
    """Purged folds, each scored by the model of its own training rows: areas and average precision."""
    return evaluate.by_fold(*_binned(spark, sf))


@query("ML-07-SHARPE", O.query("SELECT count(*) AS folds, round(avg(auc), 6) AS mean_auc, round(stddev_pop(auc), 6) AS std_auc, round((avg(auc) - 0.5) / (stddev_pop(auc) + 1e-6), 6) AS sharpe_auc, round(avg(ap), 6) AS mean_ap FROM cv", *LEARNED, BINNED))
def ml07_sharpe(spark, sf):
    return evaluate.sharpe(evaluate.by_fold(*_binned(spark, sf)))


@query("ML-07-TREES")
def ml07_trees(spark, sf):
    """The same with boosted trees."""
    rows = evaluate.split(learn.panel(ind(spark, sf))).persist()
    return evaluate.by_fold(evaluate.cross_validated(rows), rows)


@query("ML-12")
def ml12(spark, sf):
    """Signals of boosted trees by fold, from a probability of 0.7 on."""
    return evaluate.backtest(evaluate.cross_validated(evaluate.split(learn.panel(ind(spark, sf))).persist()))


@query("ML-03", O.query("SELECT count(*) FILTER (WHERE k <= n * 4 // 5) AS train, count(*) FILTER (WHERE k > n * 4 // 5) AS test, max(date) FILTER (WHERE k <= n * 4 // 5) AS last_train FROM (SELECT date, row_number() OVER (ORDER BY date, ticker) AS k, count(*) OVER () AS n FROM panel)", *LEARNED))
def ml03(spark, sf):
    """The first four fifths of the rows, in the order of dates and tickers, train."""
    rows = learn.split_rows(learn.panel(ind(spark, sf)))
    return rows.agg(F.count_if("is_train").alias("train"), F.count_if(~F.col("is_train")).alias("test"), F.max(F.when(F.col("is_train"), F.col("date"))).alias("last_train"))


SPACE = {"strength": Integer(5, 60), "volume": Integer(10, 100)}


def ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled rows with both ranks."""
    b = bars(spark, sf)
    return backtest.labelled(b.join(ctx(spark, sf).select("ticker", "date", "rel_strength_5d_rank", "vol_accum_5d_rank"), ["ticker", "date"], "left"), b, BacktestParams())


def objective(rows: DataFrame):
    """For a search: the tuning objective of each trial's thresholds, all in one job. A batch of trials is a few rows."""
    p = BacktestParams()

    def value(asked: DataFrame) -> DataFrame:
        t = F.broadcast(asked)
        picked = rows.join(t, (rows["rel_strength_5d_rank"] <= t["strength"]) & (rows["vol_accum_5d_rank"] <= t["volume"]))
        return metrics.objective(metrics.per_fold(picked, p, keys=("trial", "fold")), p, ["trial"], p.folds).withColumnRenamed("objective", "value")

    return value


def _study(spark: SparkSession, sf: str, trials: int = 60) -> str:
    rows, at = ranks(spark, sf).select("rel_strength_5d_rank", "vol_accum_5d_rank", "fold", "return_n3").persist(), shared_folder(spark, "study")
    Study(spark, at).search(objective(rows), SPACE, trials)
    rows.unpersist()
    return at


@query("ML-14")
def ml14(spark, sf):
    """A search over both thresholds: its trials."""
    return Study(spark, _study(spark, sf)).trials().select("trial", "batch", *[F.col("params")[k].alias(k) for k in SPACE], "value")


@query("SRC-26")
def src26(spark, sf):
    """The trials of a stored study: the best one, and whether it stands on a plateau."""
    study = Study(spark, _study(spark, sf)).trials()
    top = tuning.best(study).select("trial", *[F.col("params")[k].alias(k) for k in SPACE])
    return top.join(F.broadcast(tuning.plateau(study)))  # one row each


@query("SNK-15", O.query("SELECT count(*) AS n, count(*) AS same, CAST(15 AS INTEGER) AS features, CAST(1 AS INTEGER) AS version FROM panel, (SELECT quantile_cont(date - DATE '1970-01-01', 0.8) AS cut FROM (SELECT DISTINCT date FROM panel)) WHERE date - DATE '1970-01-01' >= cut", *LEARNED))
def snk15(spark, sf):
    """A model stored twice and loaded: its scores are those of the model at hand."""
    model, rows = learn.trained(learn.panel(ind(spark, sf)))
    store = Models(spark, shared_folder(spark, "models"))
    store.save(model, rows, learn.FEATURES, trees=10)
    store.save(model, rows, learn.FEATURES, trees=10)
    held = store.load()
    here = model.transform(rows).select("ticker", "date", learn.probability().alias("p"))
    there = held.transform(rows).select("ticker", "date", learn.probability().alias("q"))
    both = here.join(there, ["ticker", "date"])
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("p") == F.col("q")).alias("same")).withColumns({"features": F.lit(len(held.features)), "version": F.lit(held.version)})


@query("ML-04", O.query("SELECT target, max(c) OVER () AS n, max(c) OVER () - c AS made FROM (SELECT target, count(*) AS c FROM panel GROUP BY 1)", *LEARNED))
def ml04(spark, sf):
    """The panel with as many rows of either class: new ones lie between neighbours of the smaller class."""
    rows = oversample.oversampled(learn.panel(ind(spark, sf)), learn.FEATURES, ["ticker", "date"])
    return rows.groupBy("target").agg(F.count("*").alias("n"), F.count_if("synthetic").alias("made"))
