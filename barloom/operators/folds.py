"""Chronological folds and splits over distinct dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dates(rows: DataFrame) -> DataFrame:
    """date, at (from 1), n. One row for each date: a small table, ordered in one task."""
    d = rows.select("date").distinct()
    return d.withColumns({"at": F.row_number().over(Window.orderBy("date")), "n": F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))})


def walk_forward(rows: DataFrame, folds: int, warmup: int = 60) -> DataFrame:
    """date, fold: equal blocks after the warm-up; the last takes the rest."""
    d = dates(rows).filter(F.col("at") > warmup)
    size = F.floor((F.col("n") - warmup) / folds)
    return d.select("date", F.least(F.floor((F.col("at") - warmup - 1) / size) + 1, F.lit(folds)).cast("int").alias("fold"))


def ranges(per_date: DataFrame) -> DataFrame:
    """fold, fold_start, fold_end."""
    return per_date.groupBy("fold").agg(F.min("date").alias("fold_start"), F.max("date").alias("fold_end"))


def time_splits(rows: DataFrame, splits: int, purge: int) -> DataFrame:
    """split, date, part: test blocks of n / (splits + 1) dates at the end, all dates before them but the last `purge` train."""
    d = dates(rows).withColumn("split", F.explode(F.sequence(F.lit(1), F.lit(splits))))
    test = F.floor(F.col("n") / (splits + 1))
    begin = F.col("n") - (splits - F.col("split") + 1) * test
    at = F.col("at") - 1
    part = F.when((at >= begin) & (at < begin + test), "test").when(at < begin - purge, "train")
    return d.withColumn("part", part).filter("part is not null").select("split", "date", "part")


def drop_tail(rows: DataFrame, n: int) -> DataFrame:
    """Rows without the last n dates."""
    d = dates(rows).filter(F.col("at") <= F.col("n") - n).select("date")
    return rows.join(d, "date", "left_semi")
