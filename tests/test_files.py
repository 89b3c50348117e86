"""Landed files with broken lines, pages, tables in HTML, stored datasets, exports, plug-ins."""

import datetime as dt
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from barloom.operators import indicators, learn, scorers
from barloom.plans import report
from barloom.session import shared_folder
from barloom.sources import bars as B
from barloom.sources import files, html, master

SF = "/root/testdata/sf0.001"


def test_broken_files_end_nothing(spark, tmp_path):
    (tmp_path / "AAAA.JK_5y_1d.csv").write_text("Date,Open,High,Low,Close,Volume\n2020-01-01,1,2,0.5,1.5,10\n2020-13-45,1,2,0.5,1.5,10\n2020-01-03,1,2\n\n2020-01-04,x,2,1,1,1\n")
    (tmp_path / "BBBB_1y.csv").write_bytes(b"\x00\xff\xfe no table \n more")
    (tmp_path / "CCCC_1y.csv").write_text("")
    (tmp_path / "DDDD_1y.csv").write_text("2020-01-01,1,2,0.5,1.5,10\n2020-01-02,,,,,\n")
    rows, bad = files.fetched(spark, str(tmp_path))
    assert sorted((r["ticker"], r["date"].day, r["close"]) for r in rows.collect()) == [("AAAA.JK", 1, 1.5), ("DDDD", 1, 1.5)]
    assert {r["ticker"]: r["count"] for r in bad.groupBy("ticker").count().collect()} == {"AAAA.JK": 3, "BBBB": 2}
    assert all(r["file"].endswith(".csv") for r in bad.collect())


def test_one_file_a_ticker(spark, tmp_path):
    b = B.weekly(spark, SF).select("ticker", "date", "open", "high", "low", "close", "volume")
    files.write_csv(b, str(tmp_path / "out"))
    folders = [p for p in (tmp_path / "out").iterdir() if p.is_dir()]
    assert len(folders) == b.select("ticker").distinct().count() and all(len(list(p.glob("*.csv"))) == 1 for p in folders)
    back = files.csv_bars(spark, str(tmp_path / "out"))
    assert back.count() == b.count() and back.exceptAll(b).count() == 0


def test_pages_end_at_the_empty_one(spark, tmp_path):
    item = lambda i, t: f'{{"Id":"{i}","Title":"{t}","PublishDate":"2024-02-03T10:00:00","Tags":"x"}}'
    pages = [(1, [item(1, "a"), item(2, "b"), item(1, "again")]), (2, [item(2, "later"), item(3, "c")]), (3, []), (4, [item(4, "d")])]
    for n, items in pages:
        (tmp_path / f"{n}.json").write_text(f'{{"PageNumber":{n},"Items":[{",".join(items)}]}}')
    got = lambda **k: sorted((r["announcement_id"], r["title"]) for r in files.announcements(spark, str(tmp_path), **k).collect())
    assert got() == [("1", "a"), ("2", "b"), ("3", "c")]
    assert got(pages=1) == [("1", "a"), ("2", "b")]


class Plain(HTMLParser):
    """The first table's cells."""

    def __init__(self):
        super().__init__()
        self.rows, self.open, self.tables = [], False, 0

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables += 1
        if self.tables == 1 and tag == "tr":
            self.rows.append([])
        if self.tables == 1 and tag in ("td", "th"):
            self.rows[-1].append("")
            self.open = True

    def handle_endtag(self, tag):
        if tag == "table":
            self.tables += 10
        self.open = self.open and tag not in ("td", "th", "tr")

    def handle_data(self, data):
        if self.open and self.tables == 1:
            self.rows[-1][-1] += data


PAGES = [
    "<p>none</p>", "", None,
    "<TABLE border=1><TR><TH>No</TH><TH>Simbol</TH></TR><tr><td>1</td><td> BBCA </td></tr><tr><td>2<td><a href=\"/x>y\">bei: ASII</a></tr><tr><td>3</td><td>ABC1</td></tr><tr><td>4</td><td>BBCA</td></tr></TABLE>",
    "<table data-x='>'><thead><tr><th><b>Emiten</b></th></tr></thead><tbody><tr><td>TLKM<br></td><td>x</td></tr><tr></tr><tr><td>A&amp;B</td></tr></tbody></table><table><tr><th>Kode</th></tr><tr><td>ZZZZ</td></tr></table>",
    "<table><!-- <tr><td>NOPE</td></tr> --><tr><th>Nama</th><th>KODE&nbsp;saham</th></tr><tr><td>x</td></tr><tr><td>y</td><td>GOTO</td></tr></table>",
]


def test_tables_in_pages_against_a_parser(spark):
    df = spark.createDataFrame(list(enumerate(PAGES)), "i int, h string")
    got = {r["i"]: (r["c"], r["k"]) for r in df.select("i", html.cells(html.first_table(F.col("h"))).alias("c"), html.codes(F.col("h")).alias("k")).collect()}
    for i, page in enumerate(PAGES):
        parser = Plain()
        parser.feed(page or "")
        want = [[" ".join(c.split()) for c in r] for r in parser.rows if r]
        assert (got[i][0] or []) == want
    assert [got[i][1] for i in range(6)] == [None, None, None, ["BBCA.JK", "ASII.JK"], ["TLKM.JK"], ["GOTO.JK"]]


def test_codes_of_a_long_page_take_time_by_its_rows(spark):
    rows = F.array_join(F.transform(F.sequence(F.lit(1), F.col("id")), lambda i: F.concat(F.lit("<tr><td>x</td><td>AB"), F.chr((i % 26 + 65).cast("int")), F.chr((F.floor(i / 26) % 26 + 65).cast("int")), F.lit("</td></tr>"))), "")
    page = F.concat(F.lit("<table><tr><th>Nama</th><th>Kode</th></tr>"), rows, F.lit("</table>"))

    def took(n: int) -> float:
        start = time.monotonic()
        assert spark.range(n, n + 1).select(F.size(html.codes(page)).alias("n")).first()["n"] == min(n, 676)
        return time.monotonic() - start

    took(10)
    assert took(8_000) < 16 * took(1_000)  # in proportion or less; with the heading read again for each row some 64


def test_master_dataset_needs_no_exchange(spark):
    b, at = B.weekly(spark, SF), shared_folder(spark, "master")
    master.write(b, f"{at}/bars", "bars_of_test", buckets=4)
    held = spark.table("bars_of_test")
    out = indicators.compute(held, placed=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SelectedBucketsCount" in plan
    key = lambda df: sorted(map(str, df.select("ticker", "date", F.round("rsi_14", 6), F.round("macd_signal", 6)).collect()))
    assert key(out) == key(indicators.compute(b))
    again = master.register(spark, f"{at}/bars", "bars_again", ", ".join(f"{c} {t}" for c, t in b.dtypes), buckets=4)
    both = held.join(again.select("ticker", F.col("date").alias("d"), "close"), "ticker").groupBy("ticker").count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = held.hint("merge").join(again.select("ticker", F.col("date").alias("d")), "ticker").groupBy("ticker").count()
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert again.count() == b.count()


def test_export_opens_in_spreadsheets(spark, tmp_path):
    rows = [(1, "A", dt.date(2020, 1, 1), 70, "BULLISH", 0.0123, None), (1, "B", dt.date(2020, 1, 1), 10, "BEARISH", 0.5, 0.5)]
    df = spark.createDataFrame(rows, "fold int, ticker string, date date, score int, signal string, return_n1 double, return_n3 double")
    report.write_signals(df, str(tmp_path / "x"))
    text = max((p.read_bytes() for p in (tmp_path / "x").glob("*.csv")), key=len)  # others are headings of empty parts
    assert text.startswith(b"\xef\xbb\xbffold,ticker") and b"1,A,2020-01-01,70,1.23%,\n" in text and b",B," not in text


def test_plugins(spark):
    df = spark.createDataFrame([("A", dt.date(2020, 1, d), float(d)) for d in range(1, 5)], "ticker string, date date, x double")
    one = scorers.Plugin("late", 3, lambda p: F.when(F.col("_n") > 2, 1.0))
    two = scorers.Plugin("high", 1, lambda p: F.col("x") / 2)
    got = [(r["score_late"], r["score_high"], r["score"]) for r in scorers.plugged(df, [one, two]).orderBy("date").collect()]
    assert got == [(0, 12, 12), (0, 25, 25), (75, 25, 100), (75, 25, 100)]


def test_universe_and_features(spark, tmp_path):
    df = spark.createDataFrame([("B",), ("A",), ("B",)], "ticker string")
    files.write_universe(df, str(tmp_path / "u"))
    assert [r[0] for r in files.universe(spark, str(tmp_path / "u")).collect()] == ["A", "B"]
    rows = indicators.classic(B.weekly(spark, SF))
    assert set(learn.feature_columns(rows)) & set(learn.NOT_FEATURES) == set()


@pytest.mark.parametrize("texts, same", [(["a", "a"], True), (["a", "b"], False)])
def test_ids_follow_titles(spark, texts, same):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert (df.select(files.hash_id(F.col("t")).alias("i")).distinct().count() == 1) == same
