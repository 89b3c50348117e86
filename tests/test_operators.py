import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import series as S
from barloom.functions.chunks import split
from barloom.operators import diagnostics, folds, indicators, joins, metrics, scorers, store, tags, validate
from barloom.params import BacktestParams
from barloom.sources import bars as B

DAY = dt.date(2020, 1, 1)


def day(i):
    return DAY + dt.timedelta(days=i)


def bars_of(spark, closes, ticker="T", volumes=None):
    rows = [(ticker, day(i), float(c), float(c) + 1, float(c) - 1, float(c), float(volumes[i] if volumes else 100)) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double")


def column(df, name):
    return df.orderBy("ticker", "date").toPandas()[name]


@pytest.mark.parametrize("n", [300, 5000])
def test_averages_equal_pandas(spark, n):
    closes = 100 + np.cumsum(np.random.default_rng(1).normal(size=n))
    df = indicators.averages(bars_of(spark, closes).withColumn("_n", S.row()), (9, 50, 200))
    for s in (9, 50, 200):
        want = pd.Series(closes).ewm(span=s, adjust=False, min_periods=s).mean()
        got = column(df, f"ema_{s}")
        assert got.isna().sum() == s - 1
        assert np.allclose(got, want, rtol=1e-9, equal_nan=True)


def test_macd_signal_and_ranges(spark):
    rng = np.random.default_rng(2)
    closes = 100 + np.cumsum(rng.normal(size=120))
    got = indicators.compute(bars_of(spark, closes)).orderBy("date").toPandas()
    c = pd.Series(closes)
    macd = c.ewm(span=12, adjust=False, min_periods=12).mean() - c.ewm(span=26, adjust=False, min_periods=26).mean()
    signal = macd.ewm(span=9, adjust=False, min_periods=9).mean()
    assert np.allclose(got.macd_signal, signal, rtol=1e-9, equal_nan=True) and got.macd_signal.isna().sum() == 33
    assert np.allclose(got.bb_upper, c.rolling(20).mean() + 2 * c.rolling(20).std(ddof=0), equal_nan=True)
    tr = pd.concat([pd.Series([2.0] * 120), (c + 1 - c.shift()).abs(), (c - 1 - c.shift()).abs()], axis=1).max(axis=1)
    atr = [tr[:14].mean()]
    for x in tr[14:]:
        atr.append((13 * atr[-1] + x) / 14)
    assert np.allclose(got.atr_14[13:], atr) and got.atr_14.isna().sum() == 13


def test_strength_at_the_limits(spark):
    rising = indicators.compute(bars_of(spark, range(1, 61)))
    assert set(column(rising, "rsi_14").dropna()) == {100.0}
    flat = indicators.compute(bars_of(spark, [5] * 60)).orderBy("date").toPandas()
    assert set(flat.bb_width.dropna()) == {0.0} and set(flat.macd.dropna().round(12)) == {0.0}
    wave = column(indicators.compute(bars_of(spark, [100 + i % 2 for i in range(400)])), "rsi_14")
    assert abs(wave.iloc[-2:].mean() - 50) < 2


@pytest.mark.parametrize("n,some", [(14, 0), (49, 0), (50, 50), (60, 60)])
def test_minimum_history(spark, n, some):
    assert indicators.compute(bars_of(spark, range(1, n + 1))).count() == some


def test_candle_checks_in_order(spark):
    rows = [("a", None, 2.0, 1.0, 1.0, 1.0), ("b", 1.0, 1.0, 2.0, 0.0, 0.0), ("c", 1.0, 2.0, 1.0, 0.0, 0.0), ("d", 1.0, 2.0, 1.0, 1.0, 0.0), ("e", 1.0, 2.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "ticker string, open double, high double, low double, close double, volume double")
    got = {r["ticker"]: r["validation_note"] for r in validate.checked(df).collect()}
    assert got == {"a": "missing price", "b": "high (1.00) < low (2.00)", "c": "price not positive", "d": "zero volume", "e": None}


def test_rank_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 1.0, 2.0, None, 3.0])], "i int, v double").withColumn("date", F.lit("d"))
    got = [r["x"] for r in df.withColumn("x", S.percent_rank("v", ["date"])).orderBy("i").collect()]
    assert got == [0.375, 0.375, 0.75, None, 1.0]


@pytest.mark.parametrize("flags,want", [("TTFTT", 2), ("TTTT", 4), ("FFFF", 0), ("TTTF", 0)])
def test_run_length(spark, flags, want):
    df = spark.createDataFrame([("T", day(i), f == "T") for i, f in enumerate(flags)], "ticker string, date date, f boolean").withColumn("_n", S.row())
    assert df.withColumn("r", S.run_length(F.col("f"))).orderBy(F.desc("date")).first()["r"] == want


def test_last_fold_takes_the_rest(spark):
    df = spark.createDataFrame([(day(i),) for i in range(13)], "date date")
    got = [r["fold"] for r in folds.walk_forward(df, 5, 0).orderBy("date").collect()]
    assert got == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 5, 5, 5]


def test_as_of(spark):
    bars = spark.createDataFrame([("T", day(i), float(i)) for i in (2, 4, 5, 20)], "ticker string, date date, close double")
    events = spark.createDataFrame([("T", day(i)) for i in (1, 4, 7, 15, 40)] + [("U", day(4))], "ticker string, date date")
    loose = {(r["ticker"], r["date"]): r["bar_close"] for r in joins.as_of(events, bars, ["close"], tolerance_days=7).collect()}
    assert loose == {("T", day(1)): None, ("T", day(4)): 4.0, ("T", day(7)): 5.0, ("T", day(15)): None, ("T", day(40)): None, ("U", day(4)): None}
    strict = {r["date"]: r["bar_close"] for r in joins.as_of(events.filter("ticker = 'T'"), bars, ["close"], strict=True).collect()}
    assert strict == {day(1): None, day(4): 2.0, day(7): 5.0, day(15): 5.0, day(40): 20.0}


def test_day_outside_every_fold(spark):
    ranges = spark.createDataFrame([(2, day(5), day(9))], "fold int, fold_start date, fold_end date")
    rows = spark.createDataFrame([(day(7),), (day(1),)], "d date")
    assert {r["d"]: r["fold"] for r in joins.within(rows, ranges, F.col("d")).collect()} == {day(7): 2, day(1): 1}


def test_small_folds_have_no_measure(spark):
    rows = [(n, 0.05) for n in (1, 4, 5, 9, 10) for _ in range(n)]
    got = {r["fold"]: (r["win_rate"], r["expected_value"]) for r in metrics.per_fold(spark.createDataFrame(rows, "fold int, return_n3 double"), BacktestParams()).collect()}
    assert [got[n][0] for n in (1, 4, 5, 9, 10)] == [None, None, 1.0, 1.0, 1.0]
    assert [got[n][1] is not None for n in (1, 4, 5, 9, 10)] == [False, False, False, False, True]


def test_area_under_the_curve(spark):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 200), rng.integers(0, 20, 200)
    pairs = [(a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]]
    df = spark.createDataFrame([(1, int(a), int(b)) for a, b in zip(y, s)], "k int, y int, s int")
    assert abs(metrics.auc(df, "y", "s", ["k"]).first()["auc"] - np.mean(pairs)) < 1e-12


def test_writes(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(2, "x"), (3, None)], "k int, v string")
    as_dict = lambda df: {r["k"]: r["v"] for r in df.collect()}
    assert as_dict(store.insert_or_ignore(a, b, ["k"])) == {1: "a", 2: "b", 3: None}
    assert as_dict(store.insert_or_replace(a, b, ["k"])) == {1: "a", 2: "x", 3: None}
    assert as_dict(store.merge_known(a, b, ["k"])) == {1: "a", 2: "x", 3: None}
    assert as_dict(store.merge_known(a, spark.createDataFrame([(2, None)], "k int, v string"), ["k"])) == {1: "a", 2: "b"}


def test_signals_are_recorded_once(spark):
    found = spark.createDataFrame([("T", day(1), 10.0)], "ticker string, date date, close double")
    none = spark.createDataFrame([], "id long")
    new, outcomes = store.record_signals(none, found, "v1")
    assert new.count() == outcomes.count() == 1
    assert store.record_signals(new, found, "v1")[0].count() == 0
    bars = spark.createDataFrame([("T", day(i), 10.0 + i) for i in range(1, 9)], "ticker string, date date, close double")
    got = store.update_outcomes(outcomes.withColumn("price_at_signal", F.lit(11.0)), bars).first()
    assert (got["price_n1"], got["price_n5"], got["hit_target"]) == (12.0, 16.0, True)


def test_truncation_changes_no_earlier_row(spark):
    closes = list(100 + np.cumsum(np.random.default_rng(5).normal(size=150)))
    full = tags.evaluate(indicators.compute(bars_of(spark, closes))).filter(F.col("date") <= day(119))
    cut = tags.evaluate(indicators.compute(bars_of(spark, closes[:120])))
    keep = ["date", "rsi_14", "macd_signal", "atr_14", "unusual_tags"]
    a, b = (df.select(*keep).orderBy("date").collect() for df in (full, cut))
    assert [r["unusual_tags"] for r in a] == [r["unusual_tags"] for r in b]
    assert np.allclose([[r[k] or 0 for k in keep[1:4]] for r in a], [[r[k] or 0 for k in keep[1:4]] for r in b])


def test_weights_sum_to_100():
    got = scorers.normalised({"ema": 3, "rsi": 3, "macd": 1})
    assert sum(got.values()) == 100 and got["rsi"] == 42


def test_long_run_variance(spark):
    x = np.random.default_rng(6).normal(0.1, 1, 80)
    df = spark.createDataFrame([(day(i), float(v)) for i, v in enumerate(x)], "date date, ic double")
    d, n = x - x.mean(), len(x)
    total = d @ d + 2 * sum((1 - k / 6) * (d[k:] @ d[:-k]) for k in range(1, 6))
    assert abs(diagnostics.newey_west(df).first()["t"] - x.mean() / (np.sqrt(total) / n)) < 1e-9


def brute_pieces(text, most):
    left = text or ""
    while len(left) > most:
        at = max(left.rfind("\n", 0, most + 1), 0) or max(left.rfind(" ", 0, most + 1), 0) or most
        yield left[:at]
        left = left[at:].lstrip("\n ")
    yield left


def test_pieces(spark):
    rng = random.Random(1)
    texts = [None, "", "     ", "aaaa    ", "a" * 9, "one two three"] + ["".join(rng.choice("ab \n\U0001F600") for _ in range(rng.randrange(40))) for _ in range(500)]
    got = {}
    for r in split(spark.createDataFrame(list(enumerate(texts)), "i long, t string"), "t", 4).orderBy("i", "piece_no").collect():
        got.setdefault(r["i"], []).append(r["piece"])
    assert got == {i: list(brute_pieces(t, 4)) for i, t in enumerate(texts)}


def test_weights_of_each_group_add_up_to_100(spark):
    rows = [("a", "ema", 3.0), ("a", "rsi", 3.0), ("a", "macd", 1.0), ("b", "ema", 0.0), ("b", "rsi", None), ("c", "ema", None), ("c", "rsi", 2.0)]
    got = scorers.normalised_weights(spark.createDataFrame(rows, "ticker string, name string, weight double"), ["ticker"])
    assert {(r["ticker"], r["name"]): r["weight"] for r in got.collect()} == {("a", "ema"): 44, ("a", "rsi"): 42, ("a", "macd"): 14, ("c", "ema"): 0, ("c", "rsi"): 100}


def test_overall_without_signals_knows_no_folds(spark):
    of = lambda rows: metrics.overall(spark.createDataFrame(rows, "fold int, return_n3 double")).first()
    none, few, some = of([]), of([(1, 0.5)]), of([(f, 0.1) for f in (1, 2, 3, 4) for _ in range(10)])
    assert (none["n"], none["folds_with_data"], none["positive_folds"], none["ok_folds"]) == (0, 0, None, None)
    assert (few["n"], few["folds_with_data"], few["positive_folds"], few["ok_folds"]) == (1, 0, 0, False)
    assert (some["n"], some["folds_with_data"], some["positive_folds"], some["ok_folds"]) == (40, 4, 4, True)


def test_supplier_bars_are_placed_once_in_partitions_of_bounded_rows(spark, monkeypatch):
    sf, old = "/root/testdata/sf0.001", B.by_supplier(spark, "/root/testdata/sf0.001")
    key = lambda df: sorted(map(str, df.collect()))
    want = key(tags.rarity(indicators.compute(old, placed=True), placed=True))
    monkeypatch.setattr(B, "ROWS", 100)
    b = B.by_supplier(spark, sf)
    parts = -(-B.read(spark, sf, "lineitem").count() // 100)
    assert b.rdd.getNumPartitions() == parts > 50
    out = tags.rarity(indicators.compute(b, placed=True), placed=True)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    assert key(out) == want == key(tags.rarity(indicators.compute(b)))
