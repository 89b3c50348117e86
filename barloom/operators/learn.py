"""Panels, splits and models for learned scores."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series as S
from ..params import LearnParams
from .validate import long_enough

RANKED = ["rsi_14", "macd_diff", "volume_ratio_20d", "bb_pct_b", "bb_width"]
FEATURES = ["rsi_14", "macd_diff", "macd", "macd_signal", "volume_ratio_20d", "ema_9_dist", "ema_21_dist", "ema_50_dist", "bb_pct_b", "bb_width", *[f"{f}_cs_rank" for f in RANKED]]


#: Columns of the first generation's dataset that no model sees.
NOT_FEATURES = ("ticker", "date", "open", "high", "low", "close", "volume", "target_momentum", "true_range")


def feature_columns(rows: DataFrame) -> list[str]:
    """All columns but keys, prices, the label and the raw range, in order of name."""
    return sorted(c for c in rows.columns if c not in NOT_FEATURES)


def distances(rows: DataFrame) -> DataFrame:
    span = F.col("bb_upper") - F.col("bb_lower")
    out = {f"ema_{s}_dist": F.col("close") / F.col(f"ema_{s}") - 1 for s in (9, 21, 50)}
    return rows.withColumns(out | {"bb_pct_b": F.when(span == 0, 0.0).otherwise((F.col("close") - F.col("bb_lower")) / span)})


def ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumns({f"{f}_cs_rank": S.percent_rank(f, ["date"]) for f in RANKED})


def panel(rows: DataFrame, p: LearnParams = LearnParams()) -> DataFrame:
    """Features and label: the best `top` of each date's forward returns. Rows without a return go first, then thin dates, then ranks
    and labels are made, then rows without a feature go."""
    df = distances(long_enough(S.by_series(rows), p.min_rows)).withColumn("return_n3", S.forward_return("close", p.forward)).filter("return_n3 is not null")
    df = long_enough(df, p.min_stocks, "date")
    df = ranked(df.withColumn("_edge", F.percentile("return_n3", 1 - p.top).over(Window.partitionBy("date"))))
    return df.withColumn("target", (F.col("return_n3") >= F.col("_edge")).cast("int")).drop("_edge").dropna(subset=FEATURES)


def weighted(rows: DataFrame, label: str = "target") -> DataFrame:
    """A weight column that gives both classes the same total."""
    n = rows.groupBy(label).agg(F.count("*").alias("_c"))
    total = n.agg(F.sum("_c").alias("t"))
    return rows.join(F.broadcast(n), label).withColumn("weight", total.scalar() / (2 * F.col("_c"))).drop("_c")  # one row for each class


def classifier(seed: int = 42, trees: int = 10, depth: int = 3) -> Pipeline:
    gbt = GBTClassifier(labelCol="target", featuresCol="features", weightCol="weight", maxIter=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), gbt])


def trained(rows: DataFrame, share: float = 0.8) -> tuple[PipelineModel, DataFrame]:
    """A model of the first dates, and the rows of the others. Rows are kept, as the cut, the weights, each pass of the fit and the scores read them."""
    rows = rows.persist()
    cut = rows.select("date").distinct().agg(F.percentile(F.unix_date("date"), share)).scalar()
    early = F.unix_date("date") < cut
    return classifier().fit(weighted(rows.filter(early))), rows.filter(~early)


def split_rows(rows: DataFrame, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """Adds is_train: the first share of the rows in the order of date and ticker. Rows are counted by date, so that only one date's rows are ranked."""
    per = rows.groupBy("date").agg(F.count("*").alias("_c"))
    per = per.withColumns({"_end": F.sum("_c").over(Window.orderBy("date")), "_all": F.sum("_c").over(Window.partitionBy(F.lit(0)))})  # one row for each date
    cut = F.floor(F.col("_all") * share[0] / share[1])
    left = per.select("date", (cut - (F.col("_end") - F.col("_c"))).alias("_left"))
    rank = F.row_number().over(Window.partitionBy("date").orderBy("ticker"))
    return rows.join(F.broadcast(left), "date").withColumn("is_train", rank <= F.col("_left")).drop("_left")


def probability() -> Column:
    return vector_to_array("probability")[1]


def scored(model: PipelineModel, rows: DataFrame, p: LearnParams = LearnParams()) -> DataFrame:
    """score: the probability in whole percent; signal."""
    out = model.transform(rows).withColumn("score", F.floor(probability() * 100).cast("int"))
    return out.withColumn("signal", F.when(F.col("score") >= p.bullish, "BULLISH").when(F.col("score") <= p.bearish, "BEARISH").otherwise("NEUTRAL"))


def importances(model: PipelineModel) -> list[tuple[str, float]]:
    return sorted(zip(FEATURES, model.stages[-1].featureImportances.toArray()), key=lambda x: -x[1])


def sequences(rows: DataFrame, steps: int = 20) -> DataFrame:
    """steps: the last rows of five normalised channels, padded in front with the first of them."""
    c = F.col("close")
    channels = F.array(c / F.first("close").over(S.last(steps)) - 1, (F.col("high") - F.col("low")) / c, F.log1p("volume"), F.coalesce(F.col("rsi_14") / 100, F.lit(0.5)), F.coalesce("volume_ratio_20d", F.lit(1.0)))
    df = S.by_series(rows).withColumn("_x", channels).withColumn("_h", F.collect_list("_x").over(S.last(steps)))
    return df.withColumn("steps", F.concat(F.array_repeat(F.element_at("_h", 1), steps - F.size("_h")), F.col("_h"))).drop("_x", "_h")


def contributions(model: PipelineModel, rows: DataFrame, background: DataFrame, least: float = 0.01) -> DataFrame:
    """ticker, date, reasons: what each feature adds to a row's probability, against the same row with the feature at its mean
    over the background; small ones left out, the largest first. Every row is scored once for each feature, in one job."""
    means = background.agg(*[F.avg(f).alias(f"_m_{f}") for f in FEATURES])
    wide = rows.select("ticker", "date", *FEATURES).join(F.broadcast(means))  # one row of means
    which = F.explode(F.array(F.lit(""), *map(F.lit, FEATURES)))
    varied = wide.withColumn("_f", which).withColumns({f: F.when(F.col("_f") == f, F.col(f"_m_{f}")).otherwise(F.col(f)) for f in FEATURES})
    scored_ = model.transform(varied).select("ticker", "date", "_f", probability().alias("_p"))
    own = F.max(F.when(F.col("_f") == "", F.col("_p"))).over(Window.partitionBy("ticker", "date"))
    parts = scored_.withColumn("_d", own - F.col("_p")).filter((F.col("_f") != "") & (F.abs("_d") > least))
    pairs = F.array_sort(F.collect_list(F.struct((-F.abs("_d")).alias("k"), F.col("_f").alias("feature"), F.col("_d").alias("adds"))))
    return parts.groupBy("ticker", "date").agg(F.transform(pairs, lambda x: F.struct(x["feature"], x["adds"])).alias("reasons"))


def sequence_classifier(rows: DataFrame, steps: int = 20, hidden: int = 16, seed: int = 42):
    """A small network over flattened sequences (`sequences`), and its rows with features. label: a positive forward return."""
    data = sequences(rows, steps).withColumn("r", S.forward_return("close", 3)).filter("r is not null")
    data = data.select("ticker", "date", array_to_vector(F.flatten("steps")).alias("features"), (F.col("r") > 0).cast("int").alias("label"))
    data = data.persist()  # read by each pass of the fit and by the scores
    return MultilayerPerceptronClassifier(layers=[5 * steps, hidden, 2], maxIter=30, seed=seed).fit(data), data
