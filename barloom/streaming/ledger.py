"""Tables that grow by whole batches, for loads that may die at any point.

A batch's rows (rows/batch=N) and what is remembered about them (marks/batch=N) are written first and become visible together, when the file commits/N
appears. A batch that is replayed after a crash overwrites what it had left; one that was committed is left out. Readers see the committed batches only.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import series as S
from ..operators import store


class Folder:
    """A folder with numbered commits, each a small text."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def last(self) -> int:
        """The number of the last commit, -1 before the first."""
        where = self._path(f"{self.path}/commits")
        if not self._fs.exists(where):
            return -1
        return max((int(f.getPath().getName()) for f in self._fs.listStatus(where) if f.getPath().getName().isdigit()), default=-1)

    def commit(self, n: int, text: str = "") -> None:
        """One rename, so that the commit is there whole or not at all."""
        temporary, final = self._path(f"{self.path}/commits/_{n}"), self._path(f"{self.path}/commits/{n}")
        out = self._fs.create(temporary, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.rename(temporary, final):
            raise RuntimeError(f"batch {n} is committed already")

    def text(self, n: int) -> str:
        return self.spark.read.text(f"{self.path}/commits/{n}", wholetext=True).first()[0]


class Ledger(Folder):
    """Rows by keys, with a high-water mark for each ticker.

    mark: rows beyond their ticker's mark are taken, all of them where a ticker has none. Without it, rows whose key isn't held yet are taken: the first write
    counts. Of a key that repeats within a batch the row with the least `order` is taken.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple[str, ...] = ("ticker", "date"), mark: str | None = "date", order: str | None = None):
        super().__init__(spark, path)
        self.schema, self.keys, self.mark, self.order = schema, list(keys), mark, order

    def rows(self) -> DataFrame:
        last = self.last()
        if last < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(f"{self.schema}, batch int").parquet(f"{self.path}/rows").filter(F.col("batch") <= last).drop("batch")

    def marks(self) -> DataFrame:
        """ticker, mark: as of the last commit."""
        last = self.last()
        if last < 0 or not self.mark:
            return self.rows().groupBy(self.keys[0]).agg(F.max(self.mark or self.keys[-1]).alias("mark"))
        return self.spark.read.parquet(f"{self.path}/marks/batch={last}")

    def fresh(self, batch: DataFrame) -> DataFrame:
        if not self.mark:
            return store.append_new(self.rows(), batch, self.keys, self.order)
        ahead = batch.join(self.marks(), self.keys[0], "left").filter(F.col("mark").isNull() | (F.col(self.mark) > F.col("mark"))).drop("mark")
        return store.one_each(ahead, self.keys, self.order, False)

    def add(self, batch: DataFrame, n: int) -> None:
        """For foreachBatch."""
        if n <= self.last():
            return
        self.fresh(batch).write.mode("overwrite").parquet(f"{self.path}/rows/batch={n}")
        if self.mark:
            new = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows/batch={n}").groupBy(self.keys[0]).agg(F.max(self.mark).alias("mark"))
            both = self.marks().unionByName(new).groupBy(self.keys[0]).agg(F.max("mark").alias("mark"))
            both.write.mode("overwrite").parquet(f"{self.path}/marks/batch={n}")
        self.commit(n)


def load(spark: SparkSession, folder: str, schema: str, ledger: Ledger, checkpoint: str, files_per_batch: int = 1000) -> None:
    """Take whatever has landed in the folder since the last load, then stop."""
    landed = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    landed.writeStream.foreachBatch(ledger.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Averages(Folder):
    """Bars with recursive averages of their closes, kept up to date with bars that come late.

    Every row holds the averages at full precision, so the row before a late bar is the state from which its ticker's later rows are made anew; earlier rows and other tickers
    are left as they are. Rows lie in buckets of tickers, a file set each; an update reads and writes the buckets of its tickers only, and its commit
    names for each bucket the batch that holds it now. A bar on record is not changed by a late one of its date.
    """

    def __init__(self, spark: SparkSession, path: str, spans: tuple[int, ...] = (9, 21, 50), buckets: int = 32):
        super().__init__(spark, path)
        self.spans, self.buckets = spans, buckets
        self.raw = [f"raw_{s}" for s in spans]

    def bucket(self):
        return F.pmod(F.xxhash64("ticker"), F.lit(self.buckets)).cast("int")

    def current(self) -> dict[int, int]:
        """bucket: batch."""
        last = self.last()
        return {int(k): v for k, v in json.loads(self.text(last)).items()} if last >= 0 else {}

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/rows/batch={n}/bucket={b}" for b, n in sorted(self.current().items()) if buckets is None or b in buckets]
        schema = "ticker string, date date, close double, n long, " + ", ".join(f"{r} double" for r in self.raw)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        """ticker, date, close and an average of each span, null before it has as many bars."""
        return self.read().select("ticker", "date", "close", *[F.when(F.col("n") >= s, F.col(r)).alias(f"ema_{s}") for s, r in zip(self.spans, self.raw)])

    def recomputed(self, rows: DataFrame) -> DataFrame:
        """Averages of rows in the order of their dates. A ticker's first row may be a state (n and raw averages known); others have none."""
        df = S.by_series(rows).withColumn("_k", S.row()).withColumn("_base", F.first("n").over(S.so_far()))
        first = F.col("_k") == 1
        wanted = {f"_y{s}": (F.when(first, F.coalesce(F.col(r), F.col("close"))).otherwise(F.col("close")), 2 / (s + 1), first, F.lit(True)) for s, r in zip(self.spans, self.raw)}
        df = S.exponential(df, wanted)
        n = F.coalesce(F.col("_base"), F.lit(1)) + F.col("_k") - 1
        return df.select("ticker", "date", "close", n.alias("n"), *[F.col(f"_y{s}").alias(r) for s, r in zip(self.spans, self.raw)])

    def add(self, bars: DataFrame, n: int) -> None:
        """For foreachBatch: ticker, date and close of new bars, late ones too."""
        if n <= self.last():
            return
        new = store.one_each(bars.select("ticker", "date", "close"), ["ticker", "date"], None, False)
        touched = [r[0] for r in new.select(self.bucket().alias("b")).distinct().collect()]  # `buckets` rows at most
        held = self.read(touched)
        new = new.join(held.select("ticker", "date"), ["ticker", "date"], "left_anti")
        since = new.groupBy("ticker").agg(F.min("date").alias("_since"))
        held = held.join(since, "ticker", "left").withColumn("_state", F.max(F.when(F.col("date") < F.col("_since"), F.col("date"))).over(S.whole()))
        stays = F.col("_since").isNull() | F.coalesce(F.col("date") <= F.col("_state"), F.lit(False))
        state = held.filter(F.col("date") == F.col("_state"))
        later = held.filter(~stays)
        bare = [F.lit(None).cast("long").alias("n"), *[F.lit(None).cast("double").alias(r) for r in self.raw]]
        suffix = later.select("ticker", "date", "close", *bare).unionByName(new.select("ticker", "date", "close", *bare)).unionByName(state.select("ticker", "date", "close", "n", *self.raw))
        suffix = self.recomputed(suffix).join(state.select("ticker", "date"), ["ticker", "date"], "left_anti")
        out = held.filter(stays).select("ticker", "date", "close", "n", *self.raw).unionByName(suffix).withColumn("bucket", self.bucket())
        out.repartition("bucket").sortWithinPartitions("bucket", "ticker", "date").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/batch={n}")
        self.commit(n, json.dumps(self.current() | {b: n for b in touched}))
