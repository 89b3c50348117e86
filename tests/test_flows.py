"""Loads that die, bars that come late, signals that come twice, batches with repeats and nulls."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import diagnostics, store
from barloom.session import shared_folder
from barloom.sources import bars as B
from barloom.sources import files
from barloom.streaming import once
from barloom.streaming.ledger import Averages, Ledger, load

SF = "/root/testdata/sf0.001"
CLOSES = "ticker string, date date, close double"


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def closes(spark, *rows):
    return spark.createDataFrame([(t, day(d), float(c)) for t, d, c in rows], CLOSES)


def held(df):
    return sorted((r["ticker"], (r["date"] - day(0)).days, r["close"]) for r in df.collect())


class Dies(Ledger):
    """Dies between the writes and the commit, as often as told."""

    deaths = 1

    def commit(self, n, text=""):
        if self.deaths:
            self.deaths -= 1
            raise RuntimeError("killed")
        super().commit(n, text)


def test_a_load_that_dies_before_its_commit_changes_nothing(spark):
    at = shared_folder(spark, "test")
    ledger = Dies(spark, f"{at}/t", CLOSES)
    closes(spark, ("A", 1, 1), ("A", 2, 2), ("B", 5, 5)).write.parquet(f"{at}/in/0")
    with pytest.raises(Exception, match="killed"):
        load(spark, f"{at}/in/*", CLOSES, ledger, f"{at}/c")
    assert ledger.last() == -1 and ledger.rows().count() == 0 and ledger.marks().count() == 0
    load(spark, f"{at}/in/*", CLOSES, ledger, f"{at}/c")
    first = [("A", 1, 1.0), ("A", 2, 2.0), ("B", 5, 5.0)]
    assert held(ledger.rows()) == first
    closes(spark, ("A", 2, 9), ("A", 3, 3), ("B", 4, 9), ("C", 0, 7), ("C", 0, 8)).write.parquet(f"{at}/in/1")
    ledger.deaths = 1
    with pytest.raises(Exception, match="killed"):
        load(spark, f"{at}/in/*", CLOSES, ledger, f"{at}/c")
    assert held(ledger.rows()) == first
    for _ in range(2):  # the second finds nothing new
        load(spark, f"{at}/in/*", CLOSES, ledger, f"{at}/c")
        assert held(ledger.rows()) == [*first[:2], ("A", 3, 3.0), first[2], ("C", 0, 7.0)]
        assert {r["ticker"]: (r["mark"] - day(0)).days for r in ledger.marks().collect()} == {"A": 3, "B": 5, "C": 0}
    ledger.add(closes(spark, ("Z", 1, 1)), 1)  # a batch that was committed
    assert ledger.rows().filter("ticker = 'Z'").count() == 0


def test_first_write_counts(spark):
    at = shared_folder(spark, "test")
    ledger = Ledger(spark, f"{at}/t", CLOSES, mark=None)
    ledger.add(closes(spark, ("A", 5, 5), ("A", 5, 4)), 0)
    ledger.add(closes(spark, ("A", 5, 1), ("A", 2, 2)), 1)
    assert held(ledger.rows()) == [("A", 2, 2.0), ("A", 5, 4.0)]


def test_late_bars_touch_only_their_buckets(spark):
    b = B.weekly(spark, SF).select("ticker", "date", "close").persist()
    late = (F.col("ticker") == "Brand#11") & (F.dayofmonth("date") == 9)
    assert b.filter(late).count() > 3
    table = Averages(spark, shared_folder(spark, "test"), spans=(9, 400))
    table.add(b.filter(~late), 0)
    before = table.current()
    table.add(b.filter(late).unionByName(b.filter("ticker = 'Brand#11'").withColumn("close", F.lit(-1.0)).limit(5)), 1)
    after = table.current()
    assert [k for k in after if after[k] != before.get(k)] == [b.filter("ticker = 'Brand#11'").select(table.bucket()).first()[0]]
    whole = Averages(spark, shared_folder(spark, "test"), spans=(9, 400))
    whole.add(b, 0)
    key = lambda df: {(r["ticker"], r["date"]): r for r in df.filter("close > 0").collect()}
    got, want = key(table.rows()), key(whole.rows())
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert got[k]["close"] == r["close"] and got[k]["ema_9"] == pytest.approx(r["ema_9"]) and got[k]["ema_400"] == pytest.approx(r["ema_400"])


def test_signals_come_once_and_are_forgotten(spark):
    at, schema = shared_folder(spark, "test"), "k string, as_of timestamp, opens timestamp, closes timestamp"
    t = lambda d: dt.datetime(2020, 1, 1) + dt.timedelta(days=d)
    row = lambda k, at_, a, b: (k, t(at_), t(a), t(b))
    drops = [
        [row("a", 2, 1, 5), row("a", 1.5, 1, 5), row("b", 0, 1, 5), row("c", 0.2, 1, 5)],  # b and c lie outside
        [row("a", 3, 1, 5), row("b", 4, 1, 5), row("d", 8, 7, 9)],
        [row("e", 40, 39, 41)],  # the watermark passes the windows of a, b and d
        [row("a", 4.5, 1, 5), row("f", 40, 39, 41), row("e", 40, 39, 41)],  # a is too late
    ]
    before = once.with_store(spark)
    try:
        for i, rows in enumerate(drops):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/in/{i}")
            stream = spark.readStream.schema(schema).parquet(f"{at}/in/*")
            q = once.once(stream, ["k"], "2 days").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/c").trigger(availableNow=True).start()
            q.awaitTermination()
        left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        once.restore_store(spark, before)
    got = sorted((r["k"], r["as_of"]) for r in spark.read.parquet(f"{at}/out").collect())
    assert [k for k, _ in got] == ["a", "b", "d", "e", "f"] and got[0][1] == t(1.5)
    assert left < 5  # keys of windows that have ended are gone


def test_keys_of_one_bucket_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(once, "BUCKETS", 1)
    at, schema = shared_folder(spark, "test"), "k string, n int, as_of timestamp, opens timestamp, closes timestamp"
    t = lambda d: dt.datetime(2020, 1, 1) + dt.timedelta(days=d)
    drops = [[("a", i % 7, t(2 + i / 10), t(1), t(5)) for i in range(14)] + [(None, None, t(2), t(1), t(5))], [("a", i, t(4), t(1), t(5)) for i in range(9)] + [(None, None, t(3), t(1), t(5))], [("z", 0, t(60), t(59), t(61))]]
    before = once.with_store(spark)
    try:
        for i, rows in enumerate(drops):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/in/{i}")
            q = once.once(spark.readStream.schema(schema).parquet(f"{at}/in/*"), ["k", "n"], "2 days").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/c").trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        once.restore_store(spark, before)
    got = {(r["k"], r["n"]): r["as_of"] for r in spark.read.parquet(f"{at}/out").collect()}
    assert got == {**{("a", i): t(2 + i / 10) for i in range(7)}, ("a", 7): t(4), ("a", 8): t(4), (None, None): t(2), ("z", 0): t(60)}


def test_batches_with_repeats_and_nulls(spark):
    table = spark.createDataFrame([(1, "x"), (2, "x")], "k int, v string")
    batch = spark.createDataFrame([(2, "y", None), (3, "a", 1), (3, "b", None), (3, "c", 2), (4, None, None)], "k int, v string, at int")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(store.insert_or_replace(table, batch, ["k"], "at")) == [(1, "x"), (2, "y"), (3, "c"), (4, None)]
    assert rows(store.insert_or_ignore(table, batch, ["k"], "at")) == [(1, "x"), (2, "x"), (3, "a"), (4, None)]
    known = spark.createDataFrame([(1, "x", 1), (2, "x", 2)], "k int, v string, w int")
    news = spark.createDataFrame([(1, "y", None, 1), (1, None, 7, 2), (1, "z", None, None), (5, None, None, 1)], "k int, v string, w int, at int")
    assert rows(store.merge_known(known, news, ["k"], "at")) == [(1, "y", 7), (2, "x", 2), (5, None, None)]
    found = spark.createDataFrame([("A", day(1), 5.0), ("A", day(1), 5.0), ("A", day(1), 4.0), ("B", day(1), 1.0)], CLOSES)
    new, outcomes = store.record_signals(spark.createDataFrame([], "id long"), found, "v1")
    assert new.count() == new.select("id").distinct().count() == 2
    assert sorted((r["ticker"], r["price_at_signal"]) for r in outcomes.collect()) == [("A", 4.0), ("B", 1.0)]


def test_ranks_leave_nan_out_and_cells_are_even(spark):
    values = [float(i * i) / 1e9 for i in range(2000)] * 2 + [float("nan"), None, 1e12, -1e12, float("inf")]
    df = spark.createDataFrame([(1, v) for v in values], "g int, v double")
    got = {r["v"]: r["rank_v"] for r in diagnostics.ranks_by_counts(df, "v", ["g"]).collect()}
    known = sorted(v for v in values if v is not None and v == v)
    want = {v: known.index(v) + (known.count(v) + 1) / 2 for v in set(known)}
    assert got == want


def test_at_most_so_many_are_fetched(spark):
    have = closes(spark, ("A", 30, 1), ("B", 1, 1), ("C", 2, 1))
    asked = spark.createDataFrame([(t,) for t in "ABCDEB"], "ticker string")
    assert [r["ticker"] for r in files.stale(asked, have, str(day(31)), 3, 3).orderBy(F.col("last").asc_nulls_first(), "ticker").collect()] == ["D", "E", "B"]
    assert files.stale(asked, have, str(day(31)), 3, 25).count() == 4
