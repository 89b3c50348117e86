"""Landed files: CSV folders, text lists, JSON and XML payloads, and a replayed market-data provider."""

from __future__ import annotations

from abc import ABC, abstractmethod
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CSV = "date date, open double, high double, low double, close double, volume double"
RSS = "title string, pubDate string, description string"


def landed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, ticker, bar, line of every line but headers of bar files. The ticker begins the file's name up to the first underscore, or is named by its folder
    (ticker=...). A line that doesn't fit has no bar; one broken file or line ends nothing."""
    path = F.col("_metadata.file_path")
    name = F.element_at(F.split(path, "/"), -1)
    folder = F.regexp_extract(path, "/ticker=([^/]*)/", 1)
    ticker = F.when(folder != "", F.url_decode(F.url_decode(folder))).otherwise(F.url_decode(F.split(name, "_")[0]))  # folders' names are escaped, then paths
    text = spark.read.option("recursiveFileLookup", True).text(paths)
    parsed = F.from_csv("value", f"{CSV}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = text.select(path.alias("file"), ticker.alias("ticker"), F.col("value").alias("line"), parsed.alias("bar")).filter("lower(line) not like 'date,%' and trim(line) <> ''")
    fits = F.col("bar._bad").isNull() & F.col("bar.date").isNotNull()
    return rows.select("file", "ticker", F.when(fits, F.col("bar").dropFields("_bad")).alias("bar"), "line")


def fetched(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Bars of a batch of files, and the lines that were rejected: file, ticker, line."""
    lines = landed(spark, paths)
    bars = lines.filter("bar is not null").select("ticker", "bar.*").dropna("all", subset=["open", "high", "low", "close"])
    return bars, lines.filter("bar is null").select("file", "ticker", "line")


def csv_bars(spark: SparkSession, path: str) -> DataFrame:
    """The good bars of a folder of files, one for each ticker."""
    return fetched(spark, path)[0]


def write_csv(bars: DataFrame, path: str) -> None:
    """A folder with one file for each ticker, written by one shuffle."""
    bars.select("ticker", "date", "open", "high", "low", "close", "volume").repartition("ticker").sortWithinPartitions("ticker", "date").write.partitionBy("ticker").option("header", True).mode("overwrite").csv(path)


def write_universe(tickers: DataFrame, path: str) -> None:
    """A text file of sorted distinct tickers, thousands of lines at most."""
    tickers.select("ticker").distinct().orderBy("ticker").coalesce(1).write.mode("overwrite").text(path)


def universe(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file, trimmed, blank ones left out."""
    return spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("ticker")).filter("ticker <> ''")


def with_fallback(found: DataFrame, fixed: DataFrame, least: int) -> DataFrame:
    """The found rows if there are at least `least`, else the fixed ones, in one plan."""
    n = found.agg(F.count("*").alias("n"))
    return found.filter(n.scalar() >= least).unionByName(fixed.filter(n.scalar() < least))


def companies(payload: Column) -> Column:
    """Codes of four characters of listed shares in a JSON payload."""
    rows = F.from_json(payload, "data array<struct<KodeEmiten:string, EfekEmiten_Saham:boolean>>")["data"]
    return F.array_sort(F.array_distinct(F.transform(F.filter(rows, lambda r: r["EfekEmiten_Saham"] & (F.length(r["KodeEmiten"]) == 4)), lambda r: r["KodeEmiten"])))


def announcements(spark: SparkSession, path: str, pages: int | None = None) -> DataFrame:
    """Landed pages of the announcements interface (JSON with PageNumber and Items), one row for each item. Pages count up to the first empty one, and up to `pages`; an
    id that comes again, as where items shift between pages, counts on its first page only."""
    read = spark.read.schema("PageNumber int, Items array<struct<Id:string, Title:string, PublishDate:string, Tags:string>>").json(path)
    read = read.withColumn("PageNumber", F.coalesce("PageNumber", F.lit(1)))
    end = read.filter(F.coalesce(F.size("Items"), F.lit(0)) <= 0).agg(F.coalesce(F.min("PageNumber"), F.lit(2**31 - 1)).alias("end"))
    read = read.filter(F.col("PageNumber") < end.scalar())
    read = read if pages is None else read.filter(F.col("PageNumber") <= pages)
    items = read.select("PageNumber", F.posexplode("Items").alias("at", "i"))
    first = items.groupBy(F.col("i.Id").alias("announcement_id")).agg(F.min_by("i", F.struct("PageNumber", "at")).alias("i"))
    return first.select("announcement_id", F.to_date(F.substring("i.PublishDate", 1, 10)).alias("date"), F.col("i.Title").alias("title"), F.col("i.Tags").alias("tags"))


def hash_id(title: Column) -> Column:
    """A stable id from a title, the same on every machine and day."""
    return F.xxhash64(title).cast("string")


def rss_items(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """announcement_id, date, title, summary of every item of feed documents. The id is a stable hash of the title."""
    path = lambda tag: F.xpath(F.col(xml), F.lit(f"rss/channel/item/{tag}/text()"))
    rows = feeds.select(F.explode(F.arrays_zip(path("title").alias("t"), path("pubDate").alias("d"), path("description").alias("s"))).alias("x"))
    day = F.to_date(F.regexp_extract("x.d", r"(\d{1,2} \w{3} \d{4})", 1), "d MMM yyyy")
    return rows.select(hash_id(F.col("x.t")).alias("announcement_id"), day.alias("date"), F.col("x.t").alias("title"), F.col("x.s").alias("summary"))


class Provider(ABC):
    """Where bars come from."""

    @abstractmethod
    def fetch(self, tickers: list[str], start: str | None = None, end: str | None = None) -> DataFrame: ...

    def fetch_missing(self, have: DataFrame, tickers: list[str], end: str, most_gap_days: int) -> DataFrame:
        """Bars of tickers without any or whose last bar is too old, from their last bar on: one distributed job."""
        spark = have.sparkSession
        wanted = spark.createDataFrame([(t,) for t in tickers], "ticker string").join(have.groupBy("ticker").agg(F.max("date").alias("last")), "ticker", "left")
        stale = wanted.filter(F.col("last").isNull() | (F.datediff(F.lit(end).cast("date"), "last") > most_gap_days))
        held = stale.collect()  # a row for each ticker asked for
        start = None if any(r["last"] is None for r in held) else str(min((r["last"] for r in held), default=end))
        new = self.fetch([r["ticker"] for r in held], start, end).join(spark.createDataFrame(held, stale.schema), "ticker")
        return new.filter(F.col("last").isNull() | (F.col("date") > F.col("last"))).drop("last")


class ReplayProvider(Provider):
    """Replays bars that are stored as Parquet; stands in for a market-data service. Tickers and dates reach the scan."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def fetch(self, tickers, start=None, end=None):
        df = self.spark.read.parquet(self.path).filter(F.col("ticker").isin(tickers))
        df = df if start is None else df.filter(F.col("date") >= F.lit(start).cast("date"))
        df = df if end is None else df.filter(F.col("date") <= F.lit(end).cast("date"))
        return df.select("ticker", "date", "open", "high", "low", "close", "volume")


def stale(tickers: DataFrame, have: DataFrame, day: str, most_gap_days: int, most: int) -> DataFrame:
    """ticker, last: of the asked tickers those without bars or whose last bar is too old, at most `most` of them, the ones that wait longest first."""
    last = have.groupBy("ticker").agg(F.max("date").alias("last"))
    rows = tickers.select("ticker").distinct().join(last, "ticker", "left").filter(F.col("last").isNull() | (F.datediff(F.lit(day).cast("date"), "last") > most_gap_days))
    return rows.orderBy(F.col("last").asc_nulls_first(), "ticker").limit(most)
