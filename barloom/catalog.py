"""Further queries by operator id; importing this module registers them beside those of `registry`."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import oracle as O
from .functions import series as S
from .functions import text as T
from .operators import diagnostics, folds, indicators, learn, metrics, risk, scorers, store, tags, validate
from .params import BacktestParams
from .plans import backtest, scan
from .registry import CTX, DIRTY, IC, ORACLE_SQL, PANEL, PRICES, QUERIES, RISK, RULES, bars, ctx, dirty, ind, query, r, signals, trend
from .sources import bars as B
from .sources import files

# --- scans and writes ------------------------------------------------------------------------------------------------
SCAN = (O.BARS, O.INDICATORS, O.TAGS, O.LATEST, O.OPINION)


@query("SRC-08", O.query("SELECT scan_date, ticker, CAST(unusual_count AS INTEGER) AS unusual_count FROM (SELECT date AS scan_date, ticker, len(unusual) AS unusual_count FROM scan) WHERE scan_date >= DATE '1999-01-01' ORDER BY unusual_count DESC, ticker LIMIT 10", *SCAN))
def src08(spark, sf):
    """Scan results that were stored with JSON-encoded tags, read back."""
    out = scan.unusual(bars(spark, sf)).select(F.col("date").alias("scan_date"), "ticker", "unusual_count", F.to_json("unusual_tags").alias("tags"))
    back = out.withColumn("unusual_count", F.size(F.from_json("tags", "array<string>")))
    return back.filter("scan_date >= date'1999-01-01'").orderBy(F.desc("unusual_count"), "ticker").limit(10).select("scan_date", "ticker", "unusual_count")


@query("SRC-11", O.query(f"SELECT {PRICES} FROM bars ORDER BY date, ticker", O.BARS))
def src11(spark, sf):
    return bars(spark, sf).select(*PRICES.split(", ")).orderBy("date", "ticker")


@query("SRC-15", O.query("SELECT ticker, count(*) AS n FROM bars b WHERE date > coalesce((SELECT max(date) FROM bars h WHERE h.ticker = b.ticker AND h.date <= DATE '1998-06-30' AND h.ticker <> 'Brand#11'), DATE '1900-01-01') GROUP BY 1", O.BARS))
def src15(spark, sf):
    """Bars beyond each ticker's high-water mark; a ticker without one takes all."""
    b = bars(spark, sf)
    mark = b.filter("date <= date'1998-06-30' and ticker <> 'Brand#11'").groupBy("ticker").agg(F.max("date").alias("mark"))
    return b.join(mark, "ticker", "left").filter(F.col("mark").isNull() | (F.col("date") > F.col("mark"))).groupBy("ticker").agg(F.count("*").alias("n"))


@query("SRC-20", "SELECT least, ticker FROM (SELECT DISTINCT 10 AS least, p_brand AS ticker FROM part) WHERE (SELECT count(DISTINCT p_brand) FROM part) >= 10 UNION ALL SELECT l, ticker FROM (VALUES (10), (10000)) n(l), (VALUES ('AAAA'), ('BBBB'), ('CCCC')) t(ticker) WHERE (SELECT count(DISTINCT p_brand) FROM part) < l")
def src20(spark, sf):
    """A list that is long enough, and one that isn't."""
    fixed = spark.createDataFrame([("AAAA",), ("BBBB",), ("CCCC",)], "ticker string")
    found = B.read(spark, sf, "part").select(F.col("p_brand").alias("ticker")).distinct()
    long, short = (files.with_fallback(found, fixed, n).select(F.lit(n).alias("least"), "ticker") for n in (10, 10_000))
    return long.union(short)


@query("SRC-22-ITEMS", "SELECT CAST(doc_id AS VARCHAR) AS announcement_id, text AS title, source AS tags FROM documents")
def src22_items(spark, sf):
    """Announcements as JSON items, exploded again."""
    items = B.read(spark, sf, "documents").select(F.to_json(F.struct(F.array(F.struct(F.col("doc_id").cast("string").alias("Id"), F.col("text").alias("Title"), F.col("source").alias("Tags"))).alias("Items"))).alias("page"))
    rows = items.select(F.explode(F.from_json("page", "Items array<struct<Id:string, Title:string, Tags:string>>")["Items"]).alias("i"))
    return rows.select(F.col("i.Id").alias("announcement_id"), F.col("i.Title").alias("title"), F.col("i.Tags").alias("tags"))


@query("SRC-23", "SELECT DATE '2024-02-05' AS date, CAST(doc_id AS VARCHAR) AS title, source AS summary FROM documents")
def src23(spark, sf):
    docs = B.read(spark, sf, "documents").select(F.format_string("<rss><channel><item><title>%d</title><pubDate>Mon, 05 Feb 2024 09:00:00 GMT</pubDate><description>%s</description></item></channel></rss>", "doc_id", "source").alias("xml"))
    return files.rss_items(docs).drop("announcement_id")  # a hash of the title


@query("SNK-04", O.query("SELECT ticker, date, event_type, round(CASE WHEN year(date) >= 1997 THEN dividend_yield + 1 ELSE dividend_yield END, 6) AS dividend_yield FROM act", O.EVENTS))
def snk04(spark, sf):
    a = B.actions(spark, sf)
    new = a.filter("year(date) >= 1997")
    batch = new.union(new.withColumn("dividend_yield", F.col("dividend_yield") + 1))  # of a key's rows the one with the greater values counts as the last
    return store.insert_or_replace(a.filter("year(date) < 1998"), batch, ["ticker", "date", "event_type"])


@query("SNK-05", O.query("SELECT 'ALL' AS symbol, date, round(avg(close) + CASE WHEN date >= DATE '1996-01-01' THEN 2 ELSE 0 END, 6) AS close FROM bars GROUP BY date", O.BARS))
def snk05(spark, sf):
    """Index values of a batch replace those on record; the last of a day counts."""
    index = B.market_index(bars(spark, sf)).select("symbol", "date", "close")
    new = index.filter("date >= date'1996-01-01'")
    batch = new.withColumn("close", F.col("close") + 1).withColumn("at", F.lit(1)).union(new.withColumn("close", F.col("close") + 2).withColumn("at", F.lit(2)))
    return store.insert_or_replace(index.filter("date < date'1997-01-01'"), batch, ["symbol", "date"], "at")


@query("SNK-07", O.query("SELECT date AS scan_date, ticker, CAST(len(unusual) AS INTEGER) AS unusual_count, array_to_string(unusual, ',') AS unusual_tags FROM scan", *SCAN))
def snk07(spark, sf):
    """Scan results with tags as JSON, as they are stored, and decoded again."""
    out = scan.unusual(bars(spark, sf)).select(F.col("date").alias("scan_date"), "ticker", F.to_json("all_tags").alias("all_tags"))
    tags_ = F.from_json("all_tags", "array<struct<tag_id: string, value: double, is_unusual: boolean>>")
    named = F.transform(F.filter(tags_, lambda x: x["is_unusual"]), lambda x: x["tag_id"])
    return out.select("scan_date", "ticker", F.size(named).alias("unusual_count"), F.array_join(named, ",").alias("unusual_tags"))


@query("SNK-08", O.query("SELECT count(*) AS n FROM sig WHERE fold > 1", *RULES))
def snk08(spark, sf):
    """Signals of the first fold are on record already; the others are new."""
    s = signals(spark, sf).select("ticker", "date", "close", "fold")
    known, _ = store.record_signals(spark.createDataFrame([], "id long"), s.filter("fold = 1").drop("fold"), "v1")
    new, _ = store.record_signals(known, s.drop("fold"), "v1")
    return new.agg(F.count("*").alias("n"))


@query("STM-05", O.query("SELECT ticker, date AS signal_date, round(return_n1, 6) AS return_n1, round(return_n3, 6) AS return_n3, round(return_n5, 6) AS return_n5, return_n3 >= 0.003 AS hit_target FROM (SELECT ticker, date, " + ", ".join(f"lead(close, {h}) OVER w / close - 1 AS return_n{h}" for h in (1, 3, 5)) + " FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)) JOIN (SELECT ticker, date FROM sig) USING (ticker, date)", *RULES))
def stm05(spark, sf):
    """Outcomes of recorded signals after one, three and five bars."""
    _, outcomes = store.record_signals(spark.createDataFrame([], "id long"), signals(spark, sf).select("ticker", "date", "close"), "v1")
    return store.update_outcomes(outcomes, bars(spark, sf)).select("ticker", "signal_date", *[F.round(f"return_n{h}", 6).alias(f"return_n{h}") for h in (1, 3, 5)], "hit_target")


# --- filters, projections, indicators ----------------------------------------------------------------------------------
@query("FLT-13", O.query("SELECT count(*) AS n FROM noted WHERE open IS NOT NULL AND volume IS NOT NULL", O.BARS, DIRTY))
def flt13(spark, sf):
    return dirty(spark, sf).na.drop(subset=["open", "volume"]).agg(F.count("*").alias("n"))


@query("PRJ-06", O.query("SELECT ticker, date, round(CASE WHEN close > 0 THEN 100 / close * 100 END, 6) AS yield FROM bars", O.BARS))
def prj06(spark, sf):
    return bars(spark, sf).select("ticker", "date", F.when(F.col("close") > 0, 100 / F.col("close") * 100).alias("yield"))


@query("IND-07", O.query("SELECT ticker, date, round(CASE WHEN count(tr) OVER m >= 14 THEN avg(tr) OVER m END, 6) AS atr_simple, round(tr, 6) AS true_range FROM i1 WINDOW m AS (PARTITION BY ticker ORDER BY date ROWS 13 PRECEDING)", O.BARS, O.INDICATORS))
def ind07(spark, sf):
    df = S.by_series(validate.long_enough(bars(spark, sf), 50)).withColumn("true_range", indicators.true_range())
    return df.select("ticker", "date", S.rolling(F.avg, F.col("true_range"), 14).alias("atr_simple"), "true_range")


@query("IND-10", O.query("SELECT ticker, date, round(tr / nullif(atr_14, 0), 6) AS to_atr, round((high - low) / (atr_14 + 1e-8), 6) AS span_to_atr FROM ind", O.BARS, O.INDICATORS))
def ind10(spark, sf):
    df = ind(spark, sf)
    return df.select("ticker", "date", (indicators.true_range() / F.nullif(F.col("atr_14"), F.lit(0.0))).alias("to_atr"), ((F.col("high") - F.col("low")) / (F.col("atr_14") + 1e-8)).alias("span_to_atr"))


@query("IND-11", O.query("SELECT ticker, date, open > lag(high) OVER w AS gap_up, " + ", ".join(f"round(close / lag(close, {k}) OVER w - 1, 6) AS change_{k}" for k in (1, 5, 20)) + " FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)", O.BARS))
def ind11(spark, sf):
    return S.by_series(bars(spark, sf)).select("ticker", "date", (F.col("open") > S.lag("high")).alias("gap_up"), *[S.change("close", k).alias(f"change_{k}") for k in (1, 5, 20)])


@query("IND-14", O.query("SELECT ticker, date, round(vol_accum_5d, 6) AS vol_accum_5d FROM c1 WHERE vol_accum_5d IS NOT NULL", O.BARS, O.INDEX, O.CONTEXT))
def ind14(spark, sf):
    h, l, c, v = (F.col(x) for x in ("high", "low", "close", "volume"))
    flow = ((c - l) - (h - c)) / (h - l + 1e-8) * v
    df = S.by_series(bars(spark, sf)).withColumn("_f", flow).select("ticker", "date", (S.rolling(F.sum, F.col("_f"), 5) / (S.rolling(F.sum, v, 5) + 1e-8)).alias("vol_accum_5d"))
    return df.filter("vol_accum_5d is not null")


@query("IND-15", O.query(f"SELECT date, {r('ma_20 slope_20d')} FROM trend", O.BARS, O.INDEX))
def ind15(spark, sf):
    return trend(spark, sf).select("date", "ma_20", "slope_20d")


# --- scores, risk, observations --------------------------------------------------------------------------------------
@query("SCO-08", O.query("SELECT ticker, count(*) AS n, CAST(max(score) AS INTEGER) AS best, CAST(min(score) AS INTEGER) AS worst FROM scored GROUP BY 1", O.BARS, O.INDICATORS, O.POINTS))
def sco08(spark, sf):
    return scorers.points(ind(spark, sf)).groupBy("ticker").agg(F.count("*").alias("n"), F.max("score").alias("best"), F.min("score").alias("worst"))


@query("SCO-10", O.query("SELECT ticker, date, CAST(score AS INTEGER) AS score FROM (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1) WHERE score > 0", O.BARS.replace("GROUP BY 1, 2)", "WHERE l_shipdate >= TIMESTAMP '1997-01-06' GROUP BY 1, 2)"), O.INDICATORS, O.POINTS))
def sco10(spark, sf):
    """The look-back cuts the bars before the windows, so warm-ups start anew."""
    return scan.latest(scorers.points(indicators.compute(bars(spark, sf).filter("date >= date'1997-01-06'")))).filter("score > 0").select("ticker", "date", "score")


_FIRES = {"ema": "close > ema_21", "rsi": "rsi_14 < 40", "macd": "macd > macd_signal"}


@query("SCO-15", O.query(
    "SELECT ticker, name, CAST(cut + CASE WHEN name = 'ema' THEN 100 - sum(cut) OVER (PARTITION BY ticker) ELSE 0 END AS INTEGER) AS weight FROM ("
    "SELECT *, CAST(floor(CAST(w AS DOUBLE) / CAST(sum(w) OVER (PARTITION BY ticker) AS DOUBLE) * 100) AS INTEGER) AS cut FROM ("
    + " UNION ALL ".join(f"SELECT ticker, '{n}' AS name, count(*) FILTER (WHERE {c}) AS w FROM ind GROUP BY ticker" for n, c in _FIRES.items())
    + ") QUALIFY sum(w) OVER (PARTITION BY ticker) > 0)", O.BARS, O.INDICATORS))
def sco15(spark, sf):
    """Weights of indicators by how often each fires for a ticker, scaled to 100."""
    fires = ind(spark, sf).groupBy("ticker").agg(*[F.count(F.when(F.expr(c), 1)).alias(n) for n, c in _FIRES.items()])
    return scorers.normalised_weights(fires.unpivot("ticker", list(_FIRES), "name", "weight"), ["ticker"])


@query("RSK-01", O.query("SELECT ticker, date, round_even(close - atr_14 * 2, 2) AS stop_loss, round_even(atr_14, 2) AS atr FROM ind WHERE atr_14 > 0", O.BARS, O.INDICATORS))
def rsk01(spark, sf):
    return risk.assess(ind(spark, sf), RISK).filter("atr_14 > 0").select("ticker", "date", "stop_loss", "atr")


@query("RSK-03", O.query("SELECT ticker, date, avg(volume) OVER m >= 100 AND avg(volume * close) OVER m >= 1000000 AS liquid FROM ind WINDOW m AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING)", O.BARS, O.INDICATORS))
def rsk03(spark, sf):
    return risk.assess(ind(spark, sf), RISK).select("ticker", "date", "liquid")


@query("TAG-11", O.query("SELECT ticker, date, CASE WHEN t IS NULL OR t <= 0 THEN 'n/a' WHEN t >= 1e10 THEN 'liquid' ELSE 'less liquid' END AS note FROM (SELECT ticker, date, CASE WHEN count(*) OVER m >= 3 THEN 1e4 * avg(close * volume) OVER m END AS t FROM bars WINDOW m AS (PARTITION BY ticker ORDER BY date ROWS 4 PRECEDING))", O.BARS))
def tag11(spark, sf):
    return S.by_series(bars(spark, sf)).withColumn("t", 1e4 * indicators.turnover(3)).select("ticker", "date", tags.liquidity_note(F.col("t")).alias("note"))


@query("BRD-02", "SELECT DISTINCT p.p_brand AS ticker, CASE WHEN p.p_brand LIKE '%5' THEN 'Lainnya' ELSE s.sector END AS sector FROM part p JOIN (" + ORACLE_SQL["SRC-21"] + ") s ON p.p_brand = s.ticker")
def brd02(spark, sf):
    known = B.sectors(spark, sf).filter("ticker not like '%5'")
    return B.read(spark, sf, "part").select(F.col("p_brand").alias("ticker")).distinct().join(known, "ticker", "left").withColumn("sector", F.coalesce("sector", F.lit(B.OTHER_SECTOR)))


@query("OPN-02", O.query("""SELECT ticker, CASE WHEN list_contains(unusual, 'RESISTANCE_BREAKOUT') AND list_contains(unusual, 'VOLUME_SPIKE') THEN 'BREAKOUT_VOLUME' WHEN list_contains(unusual, 'SUPPORT_BREAKDOWN') AND list_contains(unusual, 'VOLUME_SPIKE') THEN 'BREAKDOWN_VOLUME'
  WHEN list_contains(unusual, 'BB_SQUEEZE') AND list_contains(unusual, 'VOLUME_SPIKE') THEN 'SQUEEZE_VOLUME' WHEN list_contains(unusual, 'MACD_BULLISH_CROSS') AND list_contains(all_ids, 'TREND_ALIGNMENT_UP') THEN 'MACD_BULLISH_TREND'
  WHEN list_contains(unusual, 'MACD_BEARISH_CROSS') AND list_contains(all_ids, 'TREND_ALIGNMENT_DOWN') THEN 'MACD_BEARISH_TREND' ELSE
  list_filter(['RESISTANCE_BREAKOUT', 'SUPPORT_BREAKDOWN', 'VOLUME_SPIKE', 'MACD_BULLISH_CROSS', 'MACD_BEARISH_CROSS', 'HIGH_RSI_RELATIVE', 'LOW_RSI_RELATIVE', 'BB_SQUEEZE', 'ATR_EXPANSION', 'EMA50_FAR_ABOVE', 'EMA50_FAR_BELOW', 'GAP_UP', 'GAP_DOWN'], lambda x: list_contains(unusual, x))[1] END AS headline FROM scan""", *SCAN))
def opn02(spark, sf):
    return scan.unusual(bars(spark, sf)).select("ticker", "headline")


# --- joins and aggregates ----------------------------------------------------------------------------------------------
@query("JN-03", O.query("SELECT b.ticker, b.date, round(b.close / t.close, 6) AS to_index FROM bars b LEFT JOIN mi t ON b.date = t.date", O.BARS, O.INDEX))
def jn03(spark, sf):
    b = bars(spark, sf)
    return b.join(B.market_index(b).select("date", F.col("close").alias("level")), "date", "left").select("ticker", "date", (F.col("close") / F.col("level")).alias("to_index"))


@query("JN-05", O.query("SELECT s.ticker, s.date, b.open, b.volume FROM sig s LEFT JOIN bars b USING (ticker, date)", *RULES))
def jn05(spark, sf):
    return signals(spark, sf).select("ticker", "date").join(bars(spark, sf).select("ticker", "date", "open", "volume"), ["ticker", "date"], "left")


@query("JN-08", O.query("SELECT count(*) AS n FROM act WHERE (ticker, date) NOT IN (SELECT (ticker, date) FROM bars)", O.BARS, O.EVENTS))
def jn08(spark, sf):
    return B.actions(spark, sf).join(bars(spark, sf).select("ticker", "date"), ["ticker", "date"], "left_anti").agg(F.count("*").alias("n"))


@query("AGG-01", O.query("SELECT count(*) AS n, min(date) AS first, max(date) AS last FROM bars", O.BARS))
def agg01(spark, sf):
    return bars(spark, sf).agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


@query("AGG-02", O.query("SELECT count(DISTINCT ticker) AS tickers, count(DISTINCT date) AS dates FROM bars", O.BARS))
def agg02(spark, sf):
    return bars(spark, sf).agg(F.count_distinct("ticker").alias("tickers"), F.count_distinct("date").alias("dates"))


@query("AGG-12", O.query("""SELECT b.bucket, coalesce(count(return_n3), 0) AS n, round(avg(CAST(return_n3 >= 0.02 AS INTEGER)), 6) AS win_rate, round(avg(return_n3) - 0.004, 6) AS ev_net, CASE WHEN count(return_n3) >= 30 THEN 'ok' WHEN count(return_n3) >= 15 THEN 'caution' ELSE 'too few' END AS reliability
  FROM (VALUES ('50-69', 50, 69), ('70-79', 70, 79), ('80-89', 80, 89), ('90-100', 90, 100)) b(bucket, lo, hi) LEFT JOIN (SELECT * FROM sig WHERE return_n3 IS NOT NULL) s ON s.score BETWEEN lo AND hi GROUP BY 1""", *RULES))
def agg12(spark, sf):
    return metrics.buckets(signals(spark, sf), metrics.MODEL_BUCKETS)


@query("AGG-14", O.query("SELECT round(corr(ra, rb), 6) AS ic FROM (SELECT rank() OVER (ORDER BY rel_strength_5d) + (count(*) OVER (PARTITION BY rel_strength_5d) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY vol_accum_5d) + (count(*) OVER (PARTITION BY vol_accum_5d) - 1) / 2.0::DOUBLE AS rb FROM ctx)", O.BARS, O.INDEX, O.CONTEXT))
def agg14(spark, sf):
    """Ranks over all rows, without one task for all of them: the rank of a value is the number of smaller ones, from grouped counts."""
    rows = ctx(spark, sf).select("rel_strength_5d", "vol_accum_5d")
    for c in rows.columns:
        per = rows.groupBy(c).agg(F.count("*").alias("_n")).withColumn("_b", F.floor(F.col(c) * 64))
        totals = per.groupBy("_b").agg(F.sum("_n").alias("_s")).withColumn("_base", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        inner = F.coalesce(F.sum("_n").over(Window.partitionBy("_b").orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        per = per.withColumn("_in", inner).join(totals.select("_b", "_base"), "_b").select(F.col(c).alias("_v"), (F.col("_in") + F.col("_base") + (F.col("_n") + 1) / 2).alias(f"_rank_{c}"))
        rows = rows.join(per, F.col(c) == F.col("_v")).drop("_v")
    return rows.agg(F.corr("_rank_rel_strength_5d", "_rank_vol_accum_5d").alias("ic"))


@query("AGG-16", O.query("SELECT fold, count(*) AS n, round(corr(ra, rb), 6) AS ic FROM (SELECT fold, rank() OVER (PARTITION BY fold ORDER BY a) + (count(*) OVER (PARTITION BY fold, a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY fold ORDER BY b) + (count(*) OVER (PARTITION BY fold, b) - 1) / 2.0::DOUBLE AS rb FROM ic0 JOIN folds USING (date) WHERE a IS NOT NULL AND b IS NOT NULL) GROUP BY 1", O.BARS, O.INDICATORS, O.FOLDS, IC))
def agg16(spark, sf):
    b = bars(spark, sf)
    rows = ind(spark, sf).select("ticker", "date", "rsi_14", S.forward_return("close", 3).alias("r3")).join(F.broadcast(folds.walk_forward(b, 5)), "date")
    rows = rows.select("fold", "rsi_14", "r3").filter("fold is not null and rsi_14 is not null and r3 is not null")
    for c in ("rsi_14", "r3"):
        rows = diagnostics.ranks_by_counts(rows, c, ["fold"])
    return rows.groupBy("fold").agg(F.count("*").alias("n"), F.corr("rank_rsi_14", "rank_r3").alias("ic"))


@query("AGG-22", O.query("SELECT horizon, fold, count(*) AS n, round(avg(r), 6) AS ev_gross, round(avg(r) - 0.004, 6) AS ev_net, round(avg(CAST(r > 0 AS INTEGER)), 6) AS win_rate FROM (" + " UNION ALL ".join(f"SELECT {h} AS horizon, fold, score, lead(close, {h}) OVER w / close - 1 AS r FROM scored LEFT JOIN folds USING (date) WINDOW w AS (PARTITION BY ticker ORDER BY date)" for h in (10, 20)) + ") WHERE score >= 50 AND r IS NOT NULL AND fold IS NOT NULL GROUP BY 1, 2", O.BARS, O.INDICATORS, O.POINTS, O.FOLDS))
def agg22(spark, sf):
    b = bars(spark, sf)
    rows = scorers.points(ind(spark, sf)).join(F.broadcast(folds.walk_forward(b, 5)), "date", "left").withColumn("_pick", (F.col("score") >= 50) & F.col("fold").isNotNull())
    return diagnostics.horizons(rows, (10, 20), 0.004, ("fold",))


@query("AGG-24", O.query("SELECT count(return_n3) AS n, round(avg(return_n3) - 0.004, 6) AS ev_net, round(avg(CAST(return_n3 > 0 AS INTEGER)), 6) AS win_rate, count(return_n3) >= 30 AND avg(return_n3) - 0.004 > 0 AND avg(CAST(return_n3 > 0 AS INTEGER)) >= 0.5 AS passed FROM sig WHERE fold = 5 AND return_n3 IS NOT NULL", *RULES))
def agg24(spark, sf):
    x = F.col("return_n3")
    out = signals(spark, sf).filter("fold = 5 and return_n3 is not null").agg(F.count(x).alias("n"), (F.avg(x) - 0.004).alias("ev_net"), F.avg((x > 0).cast("int")).alias("win_rate"))
    return out.withColumn("passed", (F.col("n") >= 30) & (F.col("ev_net") > 0) & (F.col("win_rate") >= 0.5))


@query("AGG-25", O.query("SELECT variant, count(*) AS n, round(avg(return_n3), 6) AS ev FROM (SELECT unnest(['all'] || CASE WHEN close > open THEN ['green'] ELSE [] END || CASE WHEN slope_20d > 0 THEN ['up'] ELSE [] END || CASE WHEN close > open AND slope_20d > 0 THEN ['green_up'] ELSE [] END) AS variant, return_n3 FROM fwd LEFT JOIN (SELECT date, slope_20d FROM trend) USING (date) WHERE rel_strength_5d_rank <= 20 AND return_n3 IS NOT NULL) GROUP BY 1", *CTX))
def agg25(spark, sf):
    b, t = bars(spark, sf), trend(spark, sf).select("date", "slope_20d")
    rows = backtest.labelled(b.join(ctx(spark, sf).select("ticker", "date", "rel_strength_5d_rank"), ["ticker", "date"], "left"), b, BacktestParams()).join(t, "date", "left")
    green, up = F.col("close") > F.col("open"), F.col("slope_20d") > 0
    labels = F.array_compact(F.array(F.lit("all"), F.when(green, "green"), F.when(up, "up"), F.when(green & up, "green_up")))
    rows = rows.filter("rel_strength_5d_rank <= 20 and return_n3 is not null").select(F.explode(labels).alias("variant"), "return_n3")
    return rows.groupBy("variant").agg(F.count("*").alias("n"), F.avg("return_n3").alias("ev"))


@query("AGG-27", O.query("SELECT count(*) FILTER (WHERE ev >= best - 0.1 * abs(best)) AS near, count(*) FILTER (WHERE ev >= best - 0.1 * abs(best)) >= 5 AS plateau FROM (SELECT ev, max(ev) OVER () AS best FROM (SELECT t, avg(return_n3) AS ev FROM fwd, (SELECT unnest(range(10, 41)) AS t) WHERE rel_strength_5d_rank <= t AND return_n3 IS NOT NULL GROUP BY 1))", *CTX))
def agg27(spark, sf):
    b = bars(spark, sf)
    rows = backtest.labelled(b.join(ctx(spark, sf).select("ticker", "date", "rel_strength_5d_rank"), ["ticker", "date"], "left"), b, BacktestParams()).filter("return_n3 is not null")
    trials = rows.select(F.explode(F.filter(F.sequence(F.lit(10), F.lit(40)), lambda t: F.col("rel_strength_5d_rank") <= t)).alias("t"), "return_n3").groupBy("t").agg(F.avg("return_n3").alias("ev"))
    best = trials.agg(F.max("ev").alias("b"))
    near = trials.withColumn("b", best.scalar()).agg(F.count_if(F.col("ev") >= F.col("b") - 0.1 * F.abs("b")).alias("near"))
    return near.withColumn("plateau", F.col("near") >= 5)


@query("BT-05", O.query("SELECT ticker, date, CAST(score AS INTEGER) AS score, " + ", ".join(f"round(lead(close, {h}) OVER w / close - 1, 6) AS return_n{h}" for h in (3, 5, 10)) + " FROM scored WINDOW w AS (PARTITION BY ticker ORDER BY date)", O.BARS, O.INDICATORS, O.POINTS))
def bt05(spark, sf):
    return scorers.points(ind(spark, sf)).select("ticker", "date", "score", *[S.forward_return("close", h).alias(f"return_n{h}") for h in (3, 5, 10)])


# --- windows, order, sets --------------------------------------------------------------------------------------------
@query("WIN-01", O.query("SELECT ticker, date, " + ", ".join(f"lag(close, {k}) OVER w AS back_{k}" for k in (1, 2, 3, 5, 10)) + " FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)", O.BARS))
def win01(spark, sf):
    return S.by_series(bars(spark, sf)).select("ticker", "date", *[S.lag("close", k).alias(f"back_{k}") for k in (1, 2, 3, 5, 10)])


@query("WIN-03", O.query("SELECT ticker, date, CAST(lead(high) OVER (PARTITION BY ticker ORDER BY date) / close - 1 >= 0.05 AS INTEGER) AS label FROM bars", O.BARS))
def win03(spark, sf):
    up = S.lead("high") / F.col("close") - 1
    return S.by_series(bars(spark, sf)).select("ticker", "date", (up >= 0.05).cast("int").alias("label"))


@query("WIN-05", O.query("SELECT ticker, date, round(CASE WHEN count(*) OVER m >= 10 THEN stddev_samp(close) OVER m END, 6) AS dev, max(high) OVER m AS top, min(low) OVER m AS bottom, round(sum(volume) OVER m, 6) AS volume FROM bars WINDOW m AS (PARTITION BY ticker ORDER BY date ROWS 9 PRECEDING)", O.BARS))
def win05(spark, sf):
    w = S.last(10)
    return S.by_series(bars(spark, sf)).select("ticker", "date", S.rolling(F.stddev_samp, F.col("close"), 10).alias("dev"), F.max("high").over(w).alias("top"), F.min("low").over(w).alias("bottom"), F.sum("volume").over(w).alias("volume"))


@query("WIN-09", O.query("SELECT ticker, count(*) AS n, round(avg(close), 6) AS mean FROM (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 60) GROUP BY 1", O.BARS))
def win09(spark, sf):
    recent = Window.partitionBy("ticker").orderBy(F.desc("date"))
    rows = bars(spark, sf).withColumn("_r", F.row_number().over(recent)).filter("_r <= 60")
    return rows.groupBy("ticker").agg(F.count("*").alias("n"), F.avg("close").alias("mean"))


@query("WIN-10", O.query("SELECT ticker, date, n - coalesce(max(CASE WHEN NOT up THEN n END) OVER (PARTITION BY ticker ORDER BY date), 0) AS run FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n, close > open AS up FROM bars)", O.BARS))
def win10(spark, sf):
    df = S.by_series(bars(spark, sf)).withColumn("_n", S.row())
    return df.select("ticker", "date", S.run_length(F.col("close") > F.col("open")).cast("long").alias("run"))


@query("WIN-12", O.query("SELECT date, CAST(least((pos - 1) // (nd // 5) + 1, 5) AS INTEGER) AS fold FROM fd", O.BARS, O.FOLDS))
def win12(spark, sf):
    return folds.walk_forward(bars(spark, sf), 5, 0)


@query("WIN-15", O.query("SELECT ticker, count(*) AS n FROM (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date) >= 60) GROUP BY 1", O.BARS))
def win15(spark, sf):
    return S.by_series(bars(spark, sf)).withColumn("_n", S.row()).filter("_n >= 60").groupBy("ticker").agg(F.count("*").alias("n"))


@query("WIN-17", O.query("SELECT ticker, date, round(return_n5, 6) AS return_n5 FROM fwd WHERE fold = 5", *CTX))
def win17(spark, sf):
    b = bars(spark, sf)
    return backtest.labelled(b, b, BacktestParams()).filter("fold = 5").select("ticker", "date", "return_n5")


@query("SRT-05", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def srt05(spark, sf):
    return B.read(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("SRT-06", O.query("SELECT ticker, array_to_string(list_transform(list_reverse_sort([{'a': abs(d9), 'n': 'ema_9'}, {'a': abs(d21), 'n': 'ema_21'}, {'a': abs(d50), 'n': 'ema_50'}]), lambda x: x.n), ',') AS order FROM (SELECT ticker, close / ema_9 - 1 AS d9, close / ema_21 - 1 AS d21, close / ema_50 - 1 AS d50 FROM ind QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1)".replace(" AS order ", ' AS "order" '), O.BARS, O.INDICATORS))
def srt06(spark, sf):
    """Names sorted by the size of their values."""
    d = learn.distances(scan.latest(ind(spark, sf)))
    pairs = F.array(*[F.struct((-F.abs(f"{c}_dist")).alias("a"), F.lit(c).alias("n")) for c in ("ema_9", "ema_21", "ema_50")])
    return d.select("ticker", F.array_join(F.transform(F.array_sort(pairs), lambda x: x["n"]), ",").alias("order"))


@query("SET-02", "SELECT c_custkey, array_to_string(list_distinct_in_order, ',') AS merged FROM (SELECT c_custkey, CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN ['AUTOMOBILE', 'X'] ELSE ['AUTOMOBILE', 'X', c_mktsegment] END AS list_distinct_in_order FROM customer)")
def set02(spark, sf):
    merged = F.array_distinct(F.concat(F.array(F.lit("AUTOMOBILE"), F.lit("X")), F.array("c_mktsegment")))
    return B.read(spark, sf, "customer").select("c_custkey", F.array_join(merged, ",").alias("merged"))


@query("SET-04", O.query("SELECT kind, count(*) AS n FROM (SELECT 'bar' AS kind, ticker, date FROM bars UNION ALL SELECT 'event', ticker, date FROM act) GROUP BY 1", O.BARS, O.EVENTS))
def set04(spark, sf):
    a = bars(spark, sf).select(F.lit("bar").alias("kind"), "ticker", "date")
    return a.unionByName(B.actions(spark, sf).select(F.lit("event").alias("kind"), "ticker", "date")).groupBy("kind").agg(F.count("*").alias("n"))


@query("SET-05", O.query("SELECT ticker, date, CAST(len(list_intersect(unusual, ['VOLUME_SPIKE', 'GAP_UP', 'GAP_DOWN'])) AS INTEGER) AS n FROM tagged", O.BARS, O.INDICATORS, O.TAGS))
def set05(spark, sf):
    wanted = F.array(*map(F.lit, ("VOLUME_SPIKE", "GAP_UP", "GAP_DOWN")))
    return tags.evaluate(ind(spark, sf)).select("ticker", "date", F.size(F.array_intersect("unusual_tags", wanted)).alias("n"))


# --- scalars -----------------------------------------------------------------------------------------------------------
@query("STR-02", "SELECT DISTINCT p_brand, upper(trim(p_brand)) || '.JK' || ',' || upper(trim(p_brand)) AS forms FROM part")
def str02(spark, sf):
    return B.read(spark, sf, "part").select("p_brand", F.array_join(T.candidates(F.col("p_brand")), ",").alias("forms")).distinct()


@query("STR-04", "SELECT doc_id, list_filter(regexp_extract_all(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[A-Z]+'), lambda w: list_contains(['THAT', 'THIS', 'ESTA', 'DANS'], w))[1] AS code FROM documents")
def str04(spark, sf):
    known = F.array(*map(F.lit, ("THAT", "THIS", "ESTA", "DANS")))
    upper = F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return B.read(spark, sf, "documents").select("doc_id", T.first_code(F.regexp_replace(upper, "[^A-Z]", " "), known).alias("code"))


@query("STR-05", O.query("SELECT DISTINCT replace(ticker || '.JK', '.JK', '') AS bare FROM bars", O.BARS))
def str05(spark, sf):
    return bars(spark, sf).select(T.bare_ticker(F.concat("ticker", F.lit(".JK"))).alias("bare")).distinct()


@query("STR-09", "SELECT p_partkey, printf('%.2f', p_retailprice + 0.001) AS price, printf('%+.1f', p_size + 0.25) AS size FROM part")
def str09(spark, sf):
    return B.read(spark, sf, "part").select("p_partkey", F.format_string("%.2f", F.col("p_retailprice") + 0.001).alias("price"), F.format_string("%+.1f", F.col("p_size") + 0.27).alias("size"))


ORACLE_SQL["STR-09"] = ORACLE_SQL["STR-09"].replace("+ 0.25", "+ 0.27")


@query("STR-12", "SELECT p_partkey, CASE WHEN p_size * 2 >= 50 THEN printf('Top %d%%', CAST(100 - p_size * 2 AS INTEGER)) ELSE printf('Bottom %d%%', CAST(p_size * 2 AS INTEGER)) END AS place FROM part")
def str12(spark, sf):
    return B.read(spark, sf, "part").select("p_partkey", T.percentile_text(F.col("p_size") * 2).alias("place"))


@query("STR-13", "SELECT role, count(*) AS n FROM conversations WHERE lower(role) IN ('user', 'assistant') GROUP BY 1")
def str13(spark, sf):
    return B.read(spark, sf, "conversations").filter(F.lower("role").isin("user", "assistant")).groupBy("role").agg(F.count("*").alias("n"))


@query("JSN-01", O.query("SELECT ticker, date, array_to_string(unusual, ',') AS back FROM tagged WHERE len(unusual) > 0", O.BARS, O.INDICATORS, O.TAGS))
def jsn01(spark, sf):
    rows = tags.evaluate(ind(spark, sf)).filter("unusual_count > 0").withColumn("j", F.to_json("unusual_tags"))
    return rows.select("ticker", "date", F.array_join(F.from_json("j", "array<string>"), ",").alias("back"))


@query("DAT-01", "SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y-%m-%d') AS DATE) AS day FROM orders")
def dat01(spark, sf):
    return B.read(spark, sf, "orders").select("o_orderkey", F.to_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"))


@query("DAT-03", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders WHERE year(o_orderdate) >= 1994 GROUP BY 1")
def dat03(spark, sf):
    return B.read(spark, sf, "orders").filter(F.year("o_orderdate") >= 1994).groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))


@query("MTH-01", "SELECT p_partkey, round_even(p_size / 2, 0) AS half, CAST(trunc(p_retailprice * 0.3) AS INTEGER) AS cut, least(greatest(p_size, 10), 40) AS clamped, round(ln(1 + p_size), 6) AS logged FROM part")
def mth01(spark, sf):
    s = F.col("p_size")
    return B.read(spark, sf, "part").select("p_partkey", F.bround(s / 2).alias("half"), (F.col("p_retailprice") * 0.3).cast("int").alias("cut"), F.least(F.greatest(s, F.lit(10)), F.lit(40)).alias("clamped"), F.log1p(s).alias("logged"))


@query("MTH-03", O.query("SELECT ticker, date, round((high - low) / nullif(close - open, 0), 6) AS ratio FROM bars", O.BARS))
def mth03(spark, sf):
    return bars(spark, sf).select("ticker", "date", F.try_divide(F.col("high") - F.col("low"), F.nullif(F.col("close") - F.col("open"), F.lit(0.0))).alias("ratio"))


@query("MAP-01", "SELECT n_name, CASE n_regionkey WHEN 0 THEN 'south' WHEN 1 THEN 'west' ELSE 'other' END AS side FROM nation")
def map01(spark, sf):
    sides = F.create_map(F.lit(0), F.lit("south"), F.lit(1), F.lit("west"))
    return B.read(spark, sf, "nation").select("n_name", F.coalesce(F.try_element_at(sides, F.col("n_regionkey")), F.lit("other")).alias("side"))


# --- learning ----------------------------------------------------------------------------------------------------------
@query("ML-03-DATES", O.query("SELECT count(*) FILTER (WHERE date < cut) AS train, count(*) FILTER (WHERE date >= cut) AS test FROM panel, (SELECT date AS cut FROM fd WHERE pos = CAST(floor(nd * 0.8) AS INTEGER))", O.BARS, O.INDICATORS, PANEL, O.FOLDS))
def ml03_dates(spark, sf):
    d = folds.dates(bars(spark, sf)).filter(F.col("at") == F.floor(F.col("n") * 0.8)).select("date")
    rows = learn.panel(ind(spark, sf)).withColumn("_cut", d.scalar())
    return rows.agg(F.count_if(F.col("date") < F.col("_cut")).alias("train"), F.count_if(F.col("date") >= F.col("_cut")).alias("test"))


@query("ML-04-WEIGHTS", O.query("SELECT target, count(*) AS n, round(any_value(t / (2 * c)), 6) AS weight FROM (SELECT target, count(*) OVER () AS t, count(*) OVER (PARTITION BY target) AS c FROM panel) GROUP BY 1", O.BARS, O.INDICATORS, PANEL))
def ml04_weights(spark, sf):
    return learn.weighted(learn.panel(ind(spark, sf))).groupBy("target").agg(F.count("*").alias("n"), F.max("weight").alias("weight"))


@query("ML-09", None)
def ml09(spark, sf):
    model, _ = learn.trained(learn.panel(ind(spark, sf)))
    return spark.createDataFrame([(n, float(v)) for n, v in learn.importances(model)[:8]], "feature string, importance double")


@query("ML-11", None)
def ml11(spark, sf):
    model, rows = learn.trained(learn.panel(ind(spark, sf)))
    out = learn.contributions(model, scan.latest(rows), rows)
    return out.select("ticker", "date", F.size("reasons").alias("n"), F.element_at("reasons", 1)["feature"].alias("first"))


@query("ML-13", None)
def ml13(spark, sf):
    model, rows = learn.sequence_classifier(ind(spark, sf))
    return model.transform(scan.latest(rows)).select("ticker", "date", learn.probability().alias("p"))


@query("ML-12-BUCKETS", None)
def ml12_buckets(spark, sf):
    model, rows = learn.trained(learn.panel(ind(spark, sf)))
    out = learn.scored(model, rows).filter("score >= 50").withColumn("fold", F.lit(1))
    return metrics.buckets(out, metrics.MODEL_BUCKETS)


#: Ids that another query covers whole.
SAME = {
    "PRJ-03": "PRJ-02", "PRJ-04": "PRJ-05", "IND-08": "IND-07", "IND-12": "IND-11", "RSK-02": "RSK-04", "JN-01": "SRC-03", "JN-02": "SRC-04", "JN-04": "SRC-04", "SJ-01": "WIN-02",
    "SRT-01": "SRC-11", "SET-01": "SRC-06", "ARR-01": "SET-05", "ARR-02": "BRD-03", "MTH-02": "MTH-01", "MTH-04": "SCO-04", "STR-11": "STR-06", "UDF-02": "IND-13", "UDF-03": "WIN-12", "SRT-04": "ML-09", "ML-05": "ML-10",
}
for _id, _as in SAME.items():
    QUERIES[_id] = QUERIES[_as]
    if _as in ORACLE_SQL:
        ORACLE_SQL[_id] = ORACLE_SQL[_as]

from . import queries_files, queries_flows, queries_models  # noqa: E402, F401  registers more queries
