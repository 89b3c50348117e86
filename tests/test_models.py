"""Evaluation by fold against plain formulas, stored models, search with trials."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from barloom.operators import evaluate, learn, tuning
from barloom.operators.models import MissingFeatures, Models
from barloom.operators.tuning import Integer, Study, TpeParams
from barloom.params import LearnParams
from barloom.session import shared_folder

DAY = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def panel(spark):
    """Sixty dates of twelve tickers; the first feature tells the target with some noise."""
    rng = random.Random(3)
    rows = []
    for d in range(60):
        for t in range(12):
            y = int(rng.random() < 0.3)
            x = [rng.gauss(0, 1) for _ in learn.FEATURES]
            x[0] = y * 1.5 + rng.gauss(0, 0.7)
            rows.append((f"T{t}", DAY + dt.timedelta(days=d), y, (2 * y - 1) * rng.random() / 20, *x))
    return spark.createDataFrame(rows, "ticker string, date date, target int, return_n3 double, " + ", ".join(f"{f} double" for f in learn.FEATURES)).persist()


@pytest.fixture(scope="module")
def scored(spark, panel):
    at = shared_folder(spark, "scores")
    rows = evaluate.split(panel).persist()
    evaluate.cross_validated(rows).select("fold", "ticker", "date", "target", "return_n3", F.round("p", 2).alias("p")).write.parquet(f"{at}/s")
    return spark.read.parquet(f"{at}/s"), rows, f"{at}/s/*.parquet"


def test_folds_are_purged(panel):
    rows = evaluate.split(panel).groupBy("fold", "part").agg(F.min("date").alias("a"), F.max("date").alias("b"), F.count("*").alias("n")).collect()
    at = {(r["fold"], r["part"]): r for r in rows}
    for k in range(1, 6):
        assert (at[k, "test"]["a"] - at[k, "train"]["b"]).days == 4 and at[k, "train"]["a"] == DAY and at[k, "test"]["n"] == 120
    assert at[5, "test"]["b"] == DAY + dt.timedelta(days=59)


def test_measures_of_stored_scores_equal_sql(scored):
    rows, parts, path = scored
    sql = f"""WITH s AS (SELECT * FROM '{path.removeprefix("file:")}'),
      pairs AS (SELECT a.fold, avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) AS auc FROM s a JOIN s b ON a.fold = b.fold AND a.target = 1 AND b.target = 0 GROUP BY 1),
      g AS (SELECT fold, p, sum(target) AS y, count(*) AS c FROM s GROUP BY 1, 2),
      c AS (SELECT *, sum(y) OVER w AS ys, sum(c) OVER w AS cs FROM g WINDOW w AS (PARTITION BY fold ORDER BY p DESC)),
      ap AS (SELECT fold, sum(y * ys / cs) / sum(y) AS ap FROM c GROUP BY 1),
      b AS (SELECT fold, count(*) FILTER (WHERE p >= 0.7) AS signals, avg(return_n3) FILTER (WHERE p >= 0.7) - 0.004 AS ev, avg(CAST(return_n3 >= 0.004 AS INTEGER)) FILTER (WHERE p >= 0.7) AS win FROM s GROUP BY 1)
      SELECT fold, auc, ap, signals, CASE WHEN signals >= 10 THEN ev END AS ev, CASE WHEN signals >= 5 THEN win END AS win FROM pairs JOIN ap USING (fold) JOIN b USING (fold) ORDER BY fold"""
    want = duckdb.sql(sql).fetchall()
    got = evaluate.by_fold(rows, parts).join(evaluate.backtest(rows), "fold").orderBy("fold").collect()
    assert len(got) == len(want) == 5
    for r, (fold, auc, ap, signals, ev, win) in zip(got, want):
        assert (r["fold"], r["signals"]) == (fold, signals)
        assert [r["auc"], r["ap"], r["expected_value"], r["win_rate_net"]] == pytest.approx([auc, ap, ev, win])
    one = evaluate.sharpe(evaluate.by_fold(rows, parts)).first()
    aucs = [w[1] for w in want]
    mean = sum(aucs) / 5
    std = (sum((a - mean) ** 2 for a in aucs) / 5) ** 0.5
    assert [one["mean_auc"], one["std_auc"], one["sharpe_auc"]] == pytest.approx([mean, std, (mean - 0.5) / (std + 1e-6)])
    assert mean > 0.85  # held out, and the feature tells


def test_shuffled_labels_teach_nothing(panel):
    rows = evaluate.split(panel.withColumn("target", (F.pmod(F.xxhash64("ticker", "date"), F.lit(10)) < 3).cast("int"))).persist()
    assert abs(evaluate.sharpe(evaluate.by_fold(evaluate.cross_validated(rows), rows)).first()["mean_auc"] - 0.5) < 0.08


def test_one_class_and_empty(panel):
    flat = evaluate.split(panel.withColumn("target", F.lit(0))).persist()
    assert [(r["auc"], r["ap"]) for r in evaluate.by_fold(evaluate.cross_validated(flat), flat).collect()] == [(0.5, 0.0)] * 5
    none = evaluate.split(panel.filter("false"))
    assert evaluate.by_fold(evaluate.cross_validated(none, evaluate.binned("rsi_14")), none).count() == 0


def test_planted_feature_leads_and_contributions_follow(spark, panel):
    model, rows = learn.trained(panel)
    assert learn.importances(model)[0][0] == learn.FEATURES[0]
    first = learn.contributions(model, rows, rows).select(F.element_at("reasons", 1)["feature"].alias("f")).groupBy("f").count().orderBy(F.desc("count")).first()
    assert first["f"] == learn.FEATURES[0]


def test_stored_models(spark, panel):
    store = Models(spark, shared_folder(spark, "models"))
    with pytest.raises(LookupError):
        store.load()
    model, rows = learn.trained(panel)
    assert [store.save(model, rows, learn.FEATURES, note=k) for k in "ab"] == [0, 1]
    held = store.load()
    assert held.version == 1 and held.notes == {"note": "b"} and store.load(0).notes == {"note": "a"}
    p = lambda m: [r["p"] for r in m.transform(rows).select("ticker", "date", learn.probability().alias("p")).orderBy("ticker", "date").collect()]
    assert p(model) == p(held)
    with pytest.raises(MissingFeatures, match="rsi_14 is missing"):
        held.transform(rows.drop("rsi_14"))
    with pytest.raises(MissingFeatures, match="rsi_14 is string, not double"):
        held.transform(rows.withColumn("rsi_14", F.col("rsi_14").cast("string")))


SPACE = {"x": Integer(0, 60), "y": Integer(0, 60)}


def hill(asked):
    """Best at (41, 17), with a lower hill elsewhere; one trial in a corner fails."""
    x, y = F.col("x"), F.col("y")
    value = F.greatest(100 - F.abs(x - 41) - F.abs(y - 17), 80 - F.abs(x - 5) - F.abs(y - 55)) * 1.0
    return asked.select("trial", value.alias("value")).filter((x > 2) | (y > 2))


def test_search_beats_a_grid_of_three_times_as_many(spark):
    study = Study(spark, shared_folder(spark, "study"))
    study.search(hill, SPACE, 80)
    found = tuning.best(study.trials()).first()["value"]
    grid = spark.createDataFrame([(i, 4 * (i % 16), 4 * (i // 16)) for i in range(256)], "trial int, x int, y int")
    assert found >= hill(grid).agg(F.max("value")).first()[0] and found >= 97
    trials = study.trials().collect()
    assert len({(r["params"]["x"], r["params"]["y"]) for r in trials}) == 80 == len({r["trial"] for r in trials})


def test_search_resumes_and_repeats(spark):
    a, b = (Study(spark, shared_folder(spark, "study")) for _ in range(2))
    a.search(hill, SPACE, 40)
    for n in (20, 30, 40, 40):
        b.search(hill, SPACE, n)
    rows = lambda s: [(r["trial"], r["params"], r["value"]) for r in s.trials().orderBy("trial").collect()]
    assert rows(a) == rows(b)
    top = tuning.plateau(a.trials()).first()
    values = [r[2] for r in rows(a)]
    assert top["near"] == sum(v >= max(values) - 0.1 * abs(max(values)) for v in values) and top["trials"] == 40


def test_a_small_space_is_used_up(spark):
    study = Study(spark, shared_folder(spark, "study"))
    study.search(hill, {"x": Integer(0, 3), "y": Integer(0, 2)}, 50, TpeParams(startup=5, batch=4))
    assert study.trials().count() == 12 and study.trials().filter("value = double('-infinity')").count() == 9


def test_rows_split_in_order(panel):
    rows = sorted((r["date"], r["ticker"], r["is_train"]) for r in learn.split_rows(panel.limit(703)).collect())
    assert [r[2] for r in rows] == [True] * 562 + [False] * 141


def test_average_precision_with_ties(spark):
    rows = [(1, 1, 0.9), (1, 0, 0.9), (1, 1, 0.5), (1, 0, 0.1), (2, 0, 0.3)]
    df = spark.createDataFrame(rows, "fold int, y int, p double")
    got = {r["fold"]: r["ap"] for r in evaluate.average_precision(df, "y", "p", ["fold"]).collect()}
    assert got == {1: pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3), 2: None}
    assert LearnParams().threshold == 0.7


def test_panels_are_kept_for_what_reads_them_again(spark, panel):
    fresh = panel.sparkSession.createDataFrame(panel.collect(), panel.schema).withColumn("return_n3", F.col("return_n3") * 1)
    kept = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("InMemoryRelation")
    assert kept(evaluate.split(fresh)) >= 2  # rows and dates
    assert kept(learn.trained(fresh.withColumn("return_n3", F.col("return_n3") * 2))[1]) >= 1
