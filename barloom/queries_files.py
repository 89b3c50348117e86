"""Queries of landed files, pages, lists, exports and stored datasets. What they read is written from the tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import oracle as O
from .functions import text as T
from .operators import indicators, learn, scorers
from .plans import report, scan
from .registry import PRICES, RULES, bars, ind, query, signals
from .session import shared_folder
from .sources import bars as B
from .sources import files, html, master

_BROKEN = "ticker LIKE '%1' OR ticker LIKE '%2'"


@query("SRC-10", O.query(f"SELECT ticker, count(*) AS n, round(sum(close), 6) AS total, CAST(CASE WHEN {_BROKEN} THEN 3 ELSE 0 END AS BIGINT) AS rejected FROM bars GROUP BY ticker", O.BARS))
def src10(spark, sf):
    """A folder with one file a ticker, some with broken lines: good rows are read, the others told."""
    at, b = shared_folder(spark, "csv"), bars(spark, sf)
    files.write_csv(b, f"{at}/bars")
    bad = b.filter(_BROKEN).select("ticker").distinct().select("ticker", F.explode(F.array(*map(F.lit, ["1995-13-45,1,2,3,4,5", "1995-01-02,one,2,3,4,5", "no table at all"]))).alias("line"))
    bad.write.mode("append").partitionBy("ticker").text(f"{at}/bars")
    rows, rejects = files.fetched(spark, f"{at}/bars")
    good = rows.groupBy("ticker").agg(F.count("*").alias("n"), F.sum("close").alias("total"))
    told = rejects.groupBy("ticker").agg(F.count("*").alias("rejected"))
    return good.join(told, "ticker", "left").withColumn("rejected", F.coalesce("rejected", F.lit(0)).cast("long"))


@query("SRC-17", O.query(f"SELECT {PRICES}, CAST(1 AS BIGINT) AS files FROM bars", O.BARS))
def src17(spark, sf):
    """Bars of many tickers written to a file each, and read back."""
    at = shared_folder(spark, "csv")
    files.write_csv(bars(spark, sf), at)
    lines = files.landed(spark, at).filter("bar is not null")
    n = lines.groupBy("ticker").agg(F.count_distinct("file").alias("files"))
    return lines.select("ticker", "bar.*").join(n, "ticker")


@query("SRC-12", "SELECT DISTINCT upper(trim(p_brand)) AS ticker FROM part")
def src12(spark, sf):
    """A universe from a text file with blank lines and blanks around names."""
    at = shared_folder(spark, "universe")
    names = B.read(spark, sf, "part").select(F.concat(F.lit("  "), "p_brand", F.lit(" \t")).alias("line")).distinct()
    names.union(spark.createDataFrame([("",), ("   ",)], "line string")).write.text(at)
    return files.universe(spark, at).select(F.upper("ticker").alias("ticker"))


@query("SNK-16", O.query("SELECT ticker, row_number() OVER (ORDER BY ticker) AS line FROM (SELECT DISTINCT ticker FROM bars WHERE close * volume >= 1000000)", O.BARS).replace("row_number()", "CAST(row_number()").replace("(ORDER BY ticker) AS line", "(ORDER BY ticker) AS INTEGER) AS line"))
def snk16(spark, sf):
    """The universe of liquid tickers as a sorted text file of one column."""
    at = shared_folder(spark, "universe")
    files.write_universe(bars(spark, sf).filter("close * volume >= 1000000"), at)
    whole = spark.read.text(at, wholetext=True).select(F.posexplode(F.split(F.rtrim("value", F.lit("\n")), "\n")))
    return whole.select(F.col("col").alias("ticker"), (F.col("pos") + 1).alias("line"))


@query("SRC-18", """SELECT n_name, code FROM nation JOIN (SELECT DISTINCT c_nationkey, translate(c_mktsegment[1:3] || chr(CAST(65 + c_custkey % 26 AS INTEGER)), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || '.JK' AS code FROM customer WHERE c_custkey % 7 <> 0) ON n_nationkey = c_nationkey""")
def src18(spark, sf):
    """Codes scraped from the first table of pages, one page for each nation and thousand customers' keys, with nested tags, attributes, a prefix and rows that hold no code."""
    code = F.concat(F.upper(F.substring("c_mktsegment", 1, 3)), F.chr((F.lit(65) + F.col("c_custkey") % 26).cast("int")))
    row = F.concat(F.lit("<TR class='a>b'><td>"), F.col("c_name"), F.lit("</td><td align=\"left\"><a href='/x?a=1'>"), F.when(F.col("c_custkey") % 3 == 0, "BEI: ").otherwise(""), F.when(F.col("c_custkey") % 7 == 0, F.concat(code, F.lit("1"))).otherwise(F.concat(F.lit("<b>"), code, F.lit("</b>"))), F.lit("</a><!-- <td> --></td></tr>\n"))
    c = B.read(spark, sf, "customer")
    body = c.groupBy("c_nationkey", F.floor(F.col("c_custkey") / 1000)).agg(F.array_join(F.array_distinct(F.collect_list(row)), "").alias("rows"))
    page = F.concat(F.lit("<html><body><p>Daftar</p><table class='x'><tr><th>Nama</th><th>Kode&nbsp;saham</th></tr>"), "rows", F.lit("</table><table><tr><th>Kode</th></tr><tr><td>ZZZZ</td></tr></table></body></html>"))
    pages = body.select("c_nationkey", html.codes(page).alias("codes"))
    n = B.read(spark, sf, "nation")
    return pages.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", F.explode("codes").alias("code")).distinct()


_CODE = "chr(CAST(65 + s_suppkey % 26 AS INTEGER)) || chr(CAST(65 + s_suppkey // 26 % 26 AS INTEGER)) || 'A' || CASE WHEN s_suppkey % 5 = 0 THEN 'BC' ELSE 'B' END"


@query("SRC-19", f"""SELECT least, code FROM (SELECT least, code, count(*) OVER (PARTITION BY least) AS n FROM (SELECT DISTINCT l.least, {_CODE} AS code FROM supplier, (VALUES (5), (100000)) l(least) WHERE s_suppkey % 5 <> 0 AND s_suppkey % 4 <> 0)) WHERE n >= least
  UNION ALL SELECT l.least, f.code FROM (VALUES (5), (100000)) l(least), (VALUES ('AAAA'), ('BBBB')) f(code) WHERE (SELECT count(DISTINCT {_CODE}) FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 4 <> 0) < l.least""")
def src19(spark, sf):
    """Listed companies from JSON payloads: codes of four characters of shares; the fixed list where too few are found."""
    k = F.col("s_suppkey")
    code = F.concat(F.chr((65 + k % 26).cast("int")), F.chr((65 + F.floor(k / 26) % 26).cast("int")), F.lit("A"), F.when(k % 5 == 0, "BC").otherwise("B"))
    one = F.struct(code.alias("KodeEmiten"), (k % 4 != 0).alias("EfekEmiten_Saham"))
    payload = B.read(spark, sf, "supplier").groupBy("s_nationkey").agg(F.to_json(F.struct(F.collect_list(one).alias("data"))).alias("payload"))
    found = payload.select(F.explode(files.companies(F.col("payload"))).alias("code")).distinct()
    fixed = spark.createDataFrame([("AAAA",), ("BBBB",)], "code string")
    both = [files.with_fallback(found, fixed, n).select(F.lit(n).alias("least"), "code") for n in (5, 100_000)]
    return both[0].union(both[1])


@query("SRC-22", "SELECT CAST(doc_id AS VARCHAR) AS announcement_id, DATE '2024-02-03' AS date, text AS title, source AS tags FROM documents")
def src22(spark, sf):
    """Announcements from pages of 50: items that shift to the next page come once, and nothing counts behind the empty page."""
    at = shared_folder(spark, "pages")
    item = lambda title: F.struct(F.col("doc_id").cast("string").alias("Id"), title.alias("Title"), F.lit("2024-02-03T10:00:00").alias("PublishDate"), F.col("source").alias("Tags"))
    docs = B.read(spark, sf, "documents")
    page = F.floor(F.col("doc_id") / 50).cast("int") + 1
    rows = docs.select(page.alias("PageNumber"), item(F.col("text")).alias("i"))
    rows = rows.union(docs.filter("doc_id % 50 >= 48").select((page + 1).alias("PageNumber"), item(F.lit("again")).alias("i")))
    last = docs.agg(F.max(page)).first()[0]
    rows = rows.filter(F.col("PageNumber") <= last)
    none = F.array().cast("array<struct<Id:string,Title:string,PublishDate:string,Tags:string>>")
    late = docs.filter("doc_id < 50").select(F.lit(last + 2).alias("PageNumber"), item(F.lit("late")).alias("i"))
    pages = rows.union(late).groupBy("PageNumber").agg(F.collect_list("i").alias("Items")).union(spark.range(1).select(F.lit(last + 1), none))
    pages.write.json(at)
    return files.announcements(spark, at)


@query("SNK-09", O.query("SELECT ticker, count(*) AS n, CAST(sum(target_momentum) AS BIGINT) AS hits, min(date) AS first FROM (SELECT ticker, date, CASE WHEN up IS NOT NULL THEN CAST(up >= 0.05 AS INTEGER) END AS target_momentum FROM (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY ticker) AS cnt, lead(high) OVER w / close - 1 AS up FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE cnt >= 50 AND n >= 200 AND up IS NOT NULL) GROUP BY 1", O.BARS))
def snk09(spark, sf):
    """The master dataset, stored in buckets of tickers and read back."""
    at = shared_folder(spark, "master")
    name = f"master_{at.rpartition('-')[2]}"
    master.write(master.features(bars(spark, sf)), f"{at}/rows", name)
    return spark.table(name).groupBy("ticker").agg(F.count("*").alias("n"), F.sum("target_momentum").alias("hits"), F.min("date").alias("first"))


@query("SNK-10", O.query("SELECT CAST(fold AS VARCHAR) AS fold, ticker, CAST(date AS VARCHAR) AS date, CAST(CAST(score AS INTEGER) AS VARCHAR) AS score, " + ", ".join(f"CASE WHEN return_n{h} IS NOT NULL THEN printf('%.2f%%', 100 * return_n{h}) END AS return_n{h}" for h in (1, 3, 5)) + " FROM sig WHERE score >= 65", *RULES))
def snk10(spark, sf):
    """Bullish signals as CSV files with a byte-order mark and percentages, read back as text."""
    at = shared_folder(spark, "export")
    report.write_signals(signals(spark, sf), at)
    rows = spark.read.option("header", True).csv(at)
    return rows.select(*[F.col(c).alias(c.lstrip("﻿")) for c in rows.columns])


@query("MTH-05", "SELECT count(DISTINCT text) AS titles, count(DISTINCT text) AS ids, count(*) AS items FROM documents")
def mth05(spark, sf):
    """Ids that are hashes of titles: as many as there are titles."""
    docs = B.read(spark, sf, "documents")
    return docs.select("text", files.hash_id(F.col("text")).alias("id")).agg(F.count_distinct("text").alias("titles"), F.count_distinct("id").alias("ids"), F.count("*").alias("items"))


@query("PRJ-01", O.query("SELECT unnest(['atr_simple', 'ema_20', 'ema_200', 'ema_50', 'gap_up', 'pct_change', 'rvol', 'volatility_ratio', 'vol_sma_20']) AS feature, (SELECT count(*) FROM bars) AS n_rows", O.BARS))
def prj01(spark, sf):
    """The columns that are features: all but keys, prices, the label and the raw range."""
    rows = indicators.classic(bars(spark, sf))
    n = rows.select(*learn.feature_columns(rows)).withColumn("_one", F.lit(1)).agg(F.count("_one").alias("n_rows"))
    return n.select(F.explode(F.array(*map(F.lit, learn.feature_columns(rows)))).alias("feature"), "n_rows")


@query("UDF-01", O.query("SELECT ticker, date, CAST(CASE WHEN rsi_14 < 30 THEN 100 WHEN rsi_14 < 50 THEN 60 ELSE 0 END AS INTEGER) AS score FROM ind", O.BARS, O.INDICATORS))
def udf01(spark, sf):
    """A scorer that a user adds, alone in an engine."""
    own = scorers.Plugin("oversold", 100, lambda p: F.when(F.col("rsi_14") < 30, 1.0).when(F.col("rsi_14") < 50, 0.6).otherwise(0.0))
    return scorers.plugged(ind(spark, sf), [own]).select("ticker", "date", F.col("score").cast("int").alias("score"))


_HEAD = "CASE WHEN list_contains(unusual, 'RESISTANCE_BREAKOUT') AND list_contains(unusual, 'VOLUME_SPIKE') THEN 'BREAKOUT_VOLUME' WHEN list_contains(unusual, 'SUPPORT_BREAKDOWN') AND list_contains(unusual, 'VOLUME_SPIKE') THEN 'BREAKDOWN_VOLUME' WHEN list_contains(unusual, 'BB_SQUEEZE') AND list_contains(unusual, 'VOLUME_SPIKE') THEN 'SQUEEZE_VOLUME' WHEN list_contains(unusual, 'MACD_BULLISH_CROSS') AND list_contains(all_ids, 'TREND_ALIGNMENT_UP') THEN 'MACD_BULLISH_TREND' WHEN list_contains(unusual, 'MACD_BEARISH_CROSS') AND list_contains(all_ids, 'TREND_ALIGNMENT_DOWN') THEN 'MACD_BEARISH_TREND' ELSE list_filter(['RESISTANCE_BREAKOUT', 'SUPPORT_BREAKDOWN', 'VOLUME_SPIKE', 'MACD_BULLISH_CROSS', 'MACD_BEARISH_CROSS', 'HIGH_RSI_RELATIVE', 'LOW_RSI_RELATIVE', 'BB_SQUEEZE', 'ATR_EXPANSION', 'EMA50_FAR_ABOVE', 'EMA50_FAR_BELOW', 'GAP_UP', 'GAP_DOWN'], lambda x: list_contains(unusual, x))[1] END"
_ESC = "replace({}, '_', '\\_')"


@query("OPN-03", O.query(f"SELECT ticker, '*' || {_ESC.format('ticker')} || ': ' || {_ESC.format('head')} || '* (' || level || ')' || array_to_string(list_transform(unusual, lambda t: chr(10) || '- ' || {_ESC.format('t')}), '') AS chat, '  ' || ticker || ': ' || head || ' [' || level || ']' || array_to_string(list_transform(unusual, lambda t: chr(10) || '     - ' || t), '') AS terminal FROM (SELECT *, {_HEAD} AS head FROM scan)", O.BARS, O.INDICATORS, O.TAGS, O.LATEST, O.OPINION))
def opn03(spark, sf):
    """The opinion of every result as a chat message and as lines of a terminal."""
    lines = report.opinion_lines()
    return scan.unusual(bars(spark, sf)).select("ticker", *[c.alias(k) for k, c in lines.items()])
