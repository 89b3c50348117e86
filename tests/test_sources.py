import datetime as dt

import duckdb
from pyspark.sql import functions as F

from barloom.functions import text as T
from barloom.plans import report, scan
from barloom.sources import bars as B
from barloom.sources import files
from barloom.streaming import bars as stream

SF = "/root/testdata/sf0.001"


def test_csv_round_trip(spark, tmp_path):
    for t in ("AAAA", "BBBB"):
        (tmp_path / f"{t}_1y_1d.csv").write_text("date,open,high,low,close,volume\n2020-01-01,1,2,0.5,1.5,10\n2020-01-02,,,,,\n")
    got = files.csv_bars(spark, str(tmp_path)).orderBy("ticker").collect()
    assert [(r["ticker"], r["date"], r["close"]) for r in got] == [("AAAA", dt.date(2020, 1, 1), 1.5), ("BBBB", dt.date(2020, 1, 1), 1.5)]


def test_lists_and_fallback(spark, tmp_path):
    (tmp_path / "u.txt").write_text(" AAAA \n\nBBBB\n")
    found = files.universe(spark, str(tmp_path / "u.txt"))
    fixed = spark.createDataFrame([("ZZZZ",)], "ticker string")
    assert sorted(r[0] for r in files.with_fallback(found, fixed, 2).collect()) == ["AAAA", "BBBB"]
    assert [r[0] for r in files.with_fallback(found, fixed, 3).collect()] == ["ZZZZ"]


def test_payloads(spark, tmp_path):
    one = spark.createDataFrame([('{"data":[{"KodeEmiten":"BBCA","EfekEmiten_Saham":true},{"KodeEmiten":"XX","EfekEmiten_Saham":true},{"KodeEmiten":"ASII","EfekEmiten_Saham":false},{"KodeEmiten":"BBCA","EfekEmiten_Saham":true}]}',)], "p string")
    assert one.select(files.companies(F.col("p"))).first()[0] == ["BBCA"]
    (tmp_path / "a.json").write_text('{"Items":[{"Id":"1","Title":"t","PublishDate":"2024-02-03T10:00:00","Tags":"x"},{"Id":"1","Title":"t","PublishDate":"2024-02-03T10:00:00","Tags":"x"}]}')
    assert [(r["announcement_id"], r["date"]) for r in files.announcements(spark, str(tmp_path)).collect()] == [("1", dt.date(2024, 2, 3))]
    xml = "<rss><channel><item><title>A</title><pubDate>Mon, 05 Feb 2024 09:00:00 GMT</pubDate><description>d</description></item></channel></rss>"
    got = files.rss_items(spark.createDataFrame([(xml,)], "xml string")).first()
    assert (got["title"], got["date"], got["summary"]) == ("A", dt.date(2024, 2, 5), "d")


def test_provider_fetches_only_what_is_missing(spark, tmp_path):
    rows = [(t, dt.date(2020, 1, d), 1.0, 1.0, 1.0, 1.0, 1.0) for t in ("A", "B") for d in range(1, 11)]
    df = spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double")
    df.write.parquet(str(tmp_path / "bars"))
    provider = files.ReplayProvider(spark, str(tmp_path / "bars"))
    assert provider.fetch(["A"], "2020-01-03").count() == 8
    have = df.filter("ticker = 'A' and date <= date'2020-01-04'")
    new = provider.fetch_missing(have, ["A", "B"], "2020-01-10", 3)
    assert {r["ticker"]: r["n"] for r in new.groupBy("ticker").agg(F.count("*").alias("n")).collect()} == {"A": 6, "B": 10}


def test_messages(spark):
    texts = ["asii, bbca", "BBCAJK", "BBRI.JK BBRI", "abc", "", "TLKM tlkm.jk"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.tickers_in(F.col("t"))).collect()]
    assert got == [["ASII", "BBCA"], ["BBCA"], ["BBRI"], [], [], ["TLKM"]]


def test_stream_equals_batch(spark, tmp_path):
    only = tmp_path / "in"
    only.mkdir()
    (only / "events.parquet").symlink_to(f"{SF}/events.parquet")
    q = stream.bars(stream.events(spark, str(only)), late="1 hour").writeStream.outputMode("complete").format("memory").queryName("hourly").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["ticker"], str(r["date"])): (r["open"], r["close"], r["volume"]) for r in spark.sql("select * from hourly").collect()}
    want = {(r["ticker"], str(r["date"])): (r["open"], r["close"], r["volume"]) for r in B.hourly(spark, SF).collect()}
    assert got == want


def test_upsert_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("A", 1), ("B", 2)], "ticker string, x int")
    write = stream.upsert(str(tmp_path / "t"))
    write(df, 0)
    write(df.filter("ticker = 'A'").withColumn("x", F.lit(5)), 1)
    write(df.filter("ticker = 'A'").withColumn("x", F.lit(5)), 1)
    assert {r["ticker"]: r["x"] for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {"A": 5, "B": 2}


def test_reports(spark):
    top = scan.unusual(B.weekly(spark, SF))
    page = report.page("Scan <1>", {"top": top.select("ticker", "level")})
    assert "Scan &lt;1&gt;" in page and page.count("<tr>") == top.count() + 1
    assert all(" | " in r[0] for r in top.select(report.scan_line()).collect())


def test_bars_are_total(spark):
    con = duckdb.connect()
    n = con.sql(f"select count(distinct (p_brand, date_trunc('week', l_shipdate))) from '{SF}/lineitem.parquet' join '{SF}/part.parquet' on l_partkey = p_partkey").fetchall()[0][0]
    b = B.weekly(spark, SF)
    assert b.count() == n and b.filter("high < low or open > high or close < low").count() == 0
