"""Queries of incremental loads, streams and stored signals: each lands batches in a shared folder and lets a stream take them, as a schedule would."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as O
from .operators import store
from .plans import scan
from .registry import PRICES, RULES, bars, query, signals
from .session import shared_folder, ship
from .sources import bars as B
from .sources import files
from .streaming import once
from .streaming.ledger import Averages, Ledger, load

CLOSES = "ticker string, date date, close double"


def _closes(spark: SparkSession, sf: str) -> DataFrame:
    return B.by_supplier(spark, sf).select("ticker", "date", "close")


def _drops(b: DataFrame) -> list[DataFrame]:
    """Three landings that overlap; each gives other closes, so that one sees whose rows were taken."""
    return [b.filter("date < date'1995-06-01'"), b.filter("date >= date'1995-01-01' and date < date'1997-01-01'").withColumn("close", F.col("close") + 1), b.filter("date >= date'1996-06-01' or date < date'1993-01-01'").withColumn("close", F.col("close") + 2)]


def _loaded(spark: SparkSession, drops: list[DataFrame], **how) -> Ledger:
    at = shared_folder(spark, "load")
    ledger = Ledger(spark, f"{at}/table", CLOSES, **how)
    for i, rows in enumerate(drops):
        rows.write.parquet(f"{at}/in/drop{i}")
        load(spark, f"{at}/in/*", CLOSES, ledger, f"{at}/checkpoint")
    return ledger


_TAKEN = "CASE WHEN date < DATE '1995-06-01' THEN close WHEN date < DATE '1997-01-01' THEN close + 1 ELSE close + 2 END"
#: A row is taken if it lies beyond its ticker's mark when its batch comes.
_MARKED = """
d0 AS (SELECT ticker, date, close FROM bars WHERE date < DATE '1995-06-01'), m0 AS (SELECT ticker, max(date) AS mark FROM d0 GROUP BY 1),
d1 AS (SELECT b.ticker, b.date, b.close + 1 AS close FROM bars b LEFT JOIN m0 USING (ticker) WHERE date >= DATE '1995-01-01' AND date < DATE '1997-01-01' AND (mark IS NULL OR date > mark)),
m1 AS (SELECT ticker, max(date) AS mark FROM (SELECT * FROM d0 UNION ALL SELECT * FROM d1) GROUP BY 1),
d2 AS (SELECT b.ticker, b.date, b.close + 2 AS close FROM bars b LEFT JOIN m1 USING (ticker) WHERE (date >= DATE '1996-06-01' OR date < DATE '1993-01-01') AND (mark IS NULL OR date > mark)),
loaded AS (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2)"""


@query("STM-01", O.query("SELECT ticker, date, round(close, 6) AS close, max(date) OVER (PARTITION BY ticker) AS mark FROM loaded", O.SUPPLIERS, _MARKED))
def stm01(spark, sf):
    """Bars beyond each ticker's mark, taken from three landings by a stream that stops in between."""
    ledger = _loaded(spark, _drops(_closes(spark, sf)))
    return ledger.rows().join(ledger.marks(), "ticker")


@query("STM-02", O.query("""SELECT ticker, date, round(CASE WHEN date < DATE '1995-06-01' THEN close WHEN date < DATE '1997-01-01' THEN close + 1 ELSE close + 2 END, 6) AS close FROM bars""", O.SUPPLIERS))
def stm02(spark, sf):
    """The first write of a bar counts; what comes again, within a landing or later, is left out."""
    drops = _drops(_closes(spark, sf))
    twice = [d.union(d.withColumn("close", F.col("close") + 5)) for d in drops]  # of a key's rows in one landing the least counts
    return _loaded(spark, twice, mark=None).rows()


@query("STM-03", O.query("SELECT ticker, date, close, " + ", ".join(f"round(CASE WHEN n >= {s} THEN list_reduce(lc, lambda a, x: a * ({s - 1}.0::DOUBLE / {s + 1}) + x * (2.0::DOUBLE / {s + 1})) END, 6) AS ema_{s}" for s in (9, 21, 50)) + " FROM (SELECT *, row_number() OVER w AS n, list(close) OVER w AS lc FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING))", O.BARS))
def stm03(spark, sf):
    """Averages over bars of which some come late, some twice: what is stored equals a whole computation."""
    b, at = bars(spark, sf).select("ticker", "date", "close"), shared_folder(spark, "averages")
    table = Averages(spark, at)
    late = (F.dayofmonth("date") % 9 == 4) & (F.substring("ticker", -1, 1) < "4")
    table.add(b.filter(~late & F.col("date").between("1900-01-01", "1997-06-30")), 0)
    table.add(b.filter(late & (F.col("date") < "1996-01-01")), 1)
    table.add(b.filter((F.col("date") > "1997-06-30") & ~late).union(b.filter(late)), 2)
    return table.rows()


#: A user's events of a type and week are one signal, open from the week's start for five days. Events come in the order of four landings, a tenth of them one landing late, and a seventh twice.
_LANDED = "LEAST(3, CAST(day(ts) AS INTEGER) // 8 + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END)"


@query("STM-04", f"""SELECT event_type, user_id, date_trunc('week', ts)::TIMESTAMP AS opens, strftime(arg_min(ts, ({_LANDED}, ts)), '%Y-%m-%d %H:%M:%S.%f') AS as_of FROM events
  WHERE ts <= date_trunc('week', ts) + INTERVAL 5 DAY GROUP BY 1, 2, 3""")
def stm04(spark, sf):
    """Signals that are open, each given once over several runs of a stream."""
    at, week = shared_folder(spark, "once"), F.date_trunc("week", "ts")
    e = B.read(spark, sf, "events").select("event_id", "event_type", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    landed = F.least(F.lit(3), F.floor(F.dayofmonth("ts") / 8).cast("int") + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0))
    e = e.withColumn("_in", landed)
    again = e.filter("event_id % 7 = 0").withColumn("_in", F.least(F.lit(3), F.col("_in") + 1))
    rows = e.union(again)
    ship(spark)
    before = once.with_store(spark)
    try:
        for i in range(4):
            rows.filter(F.col("_in") == i).drop("_in").write.parquet(f"{at}/in/drop{i}")
            stream = spark.readStream.schema(e.drop("_in").schema).parquet(f"{at}/in/*")
            seen = stream.select("event_type", "user_id", F.date_format(week, "yyyy-MM-dd").alias("week"), F.col("ts").alias("as_of"), week.alias("opens"), (week + F.expr("interval 5 days")).cast("timestamp").alias("closes"))
            out = once.once(seen, ["event_type", "user_id", "week"], "20 days")
            out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        once.restore_store(spark, before)
    found = spark.read.parquet(f"{at}/out")
    return found.select("event_type", "user_id", F.col("opens").cast("timestamp_ntz").alias("opens"), F.date_format("as_of", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("as_of"))


@query("SCN-03", O.query("""SELECT ticker, count(*) AS n, max(date) AS last FROM (SELECT b.ticker, b.date FROM bars b JOIN
  (SELECT t.ticker, CASE WHEN h.last IS NULL OR DATE '1998-06-30' - h.last > 90 THEN row_number() OVER (ORDER BY CASE WHEN h.last IS NULL OR DATE '1998-06-30' - h.last > 90 THEN 0 ELSE 1 END, h.last NULLS FIRST, t.ticker) ELSE 0 END AS k, h.last FROM (SELECT DISTINCT ticker FROM bars) t LEFT JOIN
    (SELECT ticker, max(date) AS last FROM had GROUP BY 1) h USING (ticker)) s USING (ticker)
  WHERE (b.date <= coalesce(s.last, DATE '1900-01-01') AND (ticker, b.date) IN (SELECT (ticker, date) FROM had)) OR (s.k BETWEEN 1 AND 25 AND b.date > coalesce(s.last, DATE '1900-01-01') AND b.date <= DATE '1998-06-30')) GROUP BY 1 HAVING count(*) >= 20""", O.SUPPLIERS,
  ", had AS (SELECT * FROM bars WHERE date <= CASE CAST(ticker AS INTEGER) % 5 WHEN 0 THEN DATE '1900-01-01' WHEN 1 THEN DATE '1996-12-31' ELSE DATE '1998-06-30' END)".lstrip(", ")))
def scn03(spark, sf):
    """Before a scan at most 25 tickers that have no bars, or only old ones, are fetched; others wait for the next scan. Tickers with too few bars aren't scanned."""
    b, day = B.by_supplier(spark, sf), "1998-06-30"
    fifth = F.col("ticker").cast("int") % 5
    had = b.filter(F.col("date") <= F.when(fifth == 0, F.lit("1900-01-01")).when(fifth == 1, F.lit("1996-12-31")).otherwise(F.lit(day)).cast("date"))
    rows = scan.with_fetches(b.select("ticker").distinct(), had, lambda wanted: b.join(wanted.select("ticker"), "ticker", "left_semi"), day, 90, 25)
    return rows.groupBy("ticker").agg(F.count("*").alias("n"), F.max("date").alias("last")).filter("n >= 20")


@query("SRC-16", O.query("SELECT ticker, count(date) FILTER (WHERE NOT broken) AS n, CASE WHEN broken THEN 'file is unreadable' WHEN count(date) = 0 THEN 'no bars' END AS problem FROM (SELECT u.ticker, b.date, u.ticker LIKE '%1' AS broken FROM (SELECT DISTINCT p_brand AS ticker FROM part UNION SELECT 'ZZZZ') u LEFT JOIN bars b ON b.ticker = u.ticker) GROUP BY ticker, broken", O.BARS))
def src16(spark, sf):
    """A batch of tickers fetched in one job: what fails for one ticker is told beside it and doesn't end the others."""
    at = shared_folder(spark, "batch")
    b = bars(spark, sf)
    b.repartition("ticker").write.partitionBy("ticker").option("header", True).csv(f"{at}/bars")
    wanted = b.select("ticker").distinct().union(B.read(spark, sf, "part").select("p_brand")).union(spark.createDataFrame([("ZZZZ",)], "ticker string")).distinct()
    broken = wanted.filter(F.col("ticker").endswith("1"))
    broken.select(F.lit("\x00\x01 not a table").alias("line"), "ticker").repartition("ticker").write.mode("append").partitionBy("ticker").text(f"{at}/bad")
    rows, bad = files.fetched(spark, [f"{at}/bars", f"{at}/bad"])
    n = rows.groupBy("ticker").agg(F.count("*").alias("n"))
    failed = bad.select("ticker").distinct().withColumn("_bad", F.lit(True))
    out = wanted.join(n, "ticker", "left").join(failed, "ticker", "left")
    problem = F.when(F.col("_bad"), "file is unreadable").when(F.col("n").isNull(), "no bars")
    return out.select("ticker", F.when(F.col("_bad"), 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n"), problem.alias("problem"))


_SIG = "SELECT ticker, date, close, fold FROM sig"


@query("SNK-06", O.query("SELECT 'context' AS tbl, ticker AS key, CAST(date AS VARCHAR) AS day, round(close + 2, 6) AS value FROM bars WHERE date >= DATE '1996-01-01' UNION ALL SELECT 'context', ticker, CAST(date AS VARCHAR), round(close, 6) FROM bars WHERE date < DATE '1996-01-01' "
  "UNION ALL SELECT 'announcements', CAST(doc_id AS VARCHAR), source, CASE WHEN doc_id % 4 = 0 THEN 1.0 ELSE 2.0 END FROM documents WHERE doc_id % 4 < 2 UNION ALL SELECT 'signals', ticker, CAST(date AS VARCHAR), CAST(fold AS DOUBLE) FROM sig UNION ALL SELECT 'signals', ticker, CAST(date AS VARCHAR), CAST(fold AS DOUBLE) FROM sig WHERE fold > 2", *RULES))
def snk06(spark, sf):
    """Three writers: contextual values are replaced by their key, announcements are written once by their id, signals are appended."""
    b = bars(spark, sf).select(F.col("ticker").alias("key"), F.col("date").cast("string").alias("day"), F.col("close").alias("value"))
    new = b.filter("day >= '1996-01-01'").withColumn("value", F.col("value") + 2)
    context = store.insert_or_replace(b.filter("day < '1997-01-01'"), new, ["key", "day"])
    docs = B.read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("key"), F.col("source").alias("day"), "doc_id")
    held = docs.filter("doc_id % 4 = 0").withColumn("value", F.lit(1.0)).drop("doc_id")
    came = docs.filter("doc_id % 4 < 2").withColumn("value", F.lit(2.0)).drop("doc_id")
    announcements = store.insert_or_ignore(held, came.union(came.withColumn("value", F.lit(3.0))), ["key"])
    s = signals(spark, sf).select(F.col("ticker").alias("key"), F.col("date").cast("string").alias("day"), F.col("fold").cast("double").alias("value"))
    appended = s.union(s.filter("value > 2"))
    parts = {"context": context, "announcements": announcements, "signals": appended}
    one, two, three = (df.select(F.lit(k).alias("tbl"), "key", "day", "value") for k, df in parts.items())
    return one.unionByName(two).unionByName(three)
