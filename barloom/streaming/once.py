"""Signals that are given once while their window is open.

A row says that at `as_of` a signal's window, from `opens` to `closes`, was seen open or not. Of each key the first row that lies within the
window makes the signal; whatever else arrives for the key, in the same batch or later, late or repeated, makes none. Keys are held by
transformWithState in buckets by their hash, each a list of keys with the ends of their windows, so that a bucket's keys of a batch cost a few calls of the state store together, not a few each. A
timer at the end of a window, when no row can be in time any more, forgets its keys. Rows of a window that the watermark has passed come too late:
they can't be told from signals that were given and forgotten, and give nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

#: The store that keeps keyed state with timers.
STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Buckets of keys: a batch's keys of one bucket, and those that are held, are in memory together.
BUCKETS = 1 << 12


class FirstInWindow(StatefulProcessor):
    """Rows: bucket, key, as_of, opens, closes. held: the key's fields."""

    def __init__(self, held: list[StructField]):
        self.names = [f.name for f in held]
        self.schema = StructType([*held, StructField("_until", LongType())])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.given = handle.getListState("given", self.schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now, first = timerValues.getCurrentWatermarkInMs(), {}
        for r in rows:
            name, seen = tuple(r[c] for c in self.names), (r["as_of"], r["opens"], r["closes"])
            if name not in first or seen < first[name]:
                first[name] = seen
        first = {name: seen for name, seen in first.items() if seen[2].timestamp() * 1000 >= now}
        if not first:
            return
        for held in self.given.get():
            first.pop(tuple(held)[:-1], None)
        if not first:
            return
        ends = {name: int(seen[2].timestamp() * 1000) + 1 for name, seen in first.items()}
        self.given.appendList([(*name, end) for name, end in ends.items()])
        for end in set(ends.values()):
            self.handle.registerTimer(end)
        for name, (as_of, opens, closes) in first.items():
            yield Row(**dict(zip(self.names, name)), as_of=as_of, opens=opens, closes=closes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        left = [tuple(held) for held in self.given.get()]
        left = [held for held in left if held[-1] > expiredTimerInfo.getExpiryTimeInMs()]
        if left:
            self.given.put(left)
        else:
            self.given.clear()
        return iter(())

    def close(self) -> None:
        pass


def once(stream: DataFrame, keys: list[str], late: str) -> DataFrame:
    """keys, as_of, opens, closes of each key's first row within its window. late: how far behind the latest as_of a row may be."""
    rows = stream.withWatermark("as_of", late).select(*keys, "as_of", "opens", "closes")
    schema = StructType([rows.schema[c] for c in [*keys, "as_of", "opens", "closes"]])
    first = FirstInWindow([rows.schema[c] for c in keys])
    inside = rows.filter((F.col("as_of") >= F.col("opens")) & (F.col("as_of") <= F.col("closes")))
    return inside.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")).groupBy("_bucket").transformWithState(first, schema, "Append", "EventTime")


def with_store(spark: SparkSession) -> str | None:
    """Choose the store that timers need; returns the one before, to be set again."""
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    return before


def restore_store(spark: SparkSession, before: str | None) -> None:
    if before is None:
        spark.conf.unset(STORE[0])
    else:
        spark.conf.set(STORE[0], before)
