"""Shared helpers: the shared folder, bounded samples and vectorised text kernels over Arrow buffers.

Text kernels treat a batch of texts as one byte buffer plus offsets and work on whole arrays, so a
task's memory depends on the chunk size below (or on the longest single text), never on the table.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Bytes of text a kernel works on at once.
CHUNK_BYTES = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is configured, a temporary one, if the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="barloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def park(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder, in folders by the values of `by`, and read it again."""
    return park_all([df], by)


def park_all(parts: Iterable[DataFrame], by: list[str] | None = None) -> DataFrame:
    """park for the union of at least one table of equal columns, written one after the other."""
    path = None
    for df in parts:
        path = path or f"{shared_dir(df.sparkSession)}/parked-{uuid.uuid4().hex}"
        df.write.mode("append").parquet(path, partitionBy=by)
    spark = df.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of numbers that may be broadcast: some tens of MB.
FEW = 1 << 20


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """df, a parked table of a few numbers a row, marked to be broadcast if it has so few rows; if not, to be shuffled as the side that is hashed."""
    return F.broadcast(df) if df.count() <= most else df.hint("shuffle_hash")


def unpark(df: DataFrame) -> None:
    """Delete the files of a parked table that nothing reads any more, and the shuffle files with it that led to it."""
    spark = df.sparkSession
    for path in {found[0] for f in df.inputFiles() if (found := re.match(r".*/parked-[0-9a-f]+", f))}:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    tidy(spark)


def tidy(spark: SparkSession) -> None:
    """Let go of shuffle files that no plan refers to any more. Spark deletes them only once the driver has collected its garbage, which one with memory
    to spare doesn't do for long, while each further job adds its own."""
    gc.collect()
    spark._jvm.System.gc()


#: Rows that Spark reads or hands over at once, for texts: with the defaults (4,096 and 10,000) every running task would fill tens of MB
#: in the JVM, in pieces that its heap handles badly, and again in Python. A session that sets other values keeps them.
BATCHES = {"spark.sql.parquet.columnarReaderBatchSize": ("4096", "512"), "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000")}


def small_batches(spark: SparkSession) -> None:
    for key, (default, ours) in BATCHES.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, ours)


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow, in batches that suit texts, with this package's source at hand on the executors."""
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def fold(col: str, n: int) -> Column:
    """crc32 of an id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def as_text(df: DataFrame, text_col: str) -> Column:
    return F.coalesce(df[text_col].cast("string"), F.lit(""))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, keep: Column, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _text, _label of at most `rows` labelled texts, those whose hashed id is smallest, in one partition and in that order.

    Only ids and hashes of texts are ranked; a text that repeats under one id counts once. Rows with null ids or labels are left out.
    """
    chosen = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_label")).filter(keep)
    chosen = chosen.distinct().orderBy(F.xxhash64("_id"), "_id", "_label").limit(rows)
    docs = documents.select(documents[id_col].alias("_id"), as_text(documents, text_col).alias("_text")).withColumn("_key", F.xxhash64("_text"))
    order = [F.xxhash64("_id"), F.col("_id"), F.col("_key"), F.col("_label")]
    rank = docs.select("_id", "_key").join(F.broadcast(chosen), "_id").distinct().orderBy(*order).limit(rows)  # rows of numbers, no more than `rows`
    found = docs.join(F.broadcast(rank), ["_id", "_key"]).groupBy("_id", "_key", "_label").agg(F.first("_text").alias("_text"))
    return found.repartition(1).sortWithinPartitions(*order).select("_id", "_text", "_label")


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 1 << 16)
        _pow = np.full(size, _P, np.uint64)
        _inv = np.full(size, _PINV, np.uint64)
        _pow[0] = _inv[0] = 1
        np.multiply.accumulate(_pow, out=_pow)
        np.multiply.accumulate(_inv, out=_inv)
    return _pow, _inv


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over all 64."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


class Texts:
    """A chunk of texts: bytes, offsets, and the first row's place in its batch."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off, self.n = data, off, len(off) - 1
        self._prefix = None

    @classmethod
    def of(cls, texts: list) -> Texts:
        return cls.from_arrow(pa.array(texts, pa.string()))

    @classmethod
    def from_arrow(cls, arr: pa.Array) -> Texts:
        if isinstance(arr, pa.ChunkedArray):
            arr = arr.combine_chunks()
        if arr.null_count:
            arr = arr.fill_null("")
        kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
        if len(arr) == 0:
            return cls(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        _, offsets, data = arr.buffers()
        off = np.frombuffer(offsets, kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        return cls(raw[off[0] : off[-1]], off - off[0])

    def lowered(self) -> Texts:
        return Texts(LOWER[self.data], self.off)

    def spans(self, blank: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every word, and the number of words before each text (one more entry than texts)."""
        n = len(self.data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(self.n + 1, np.int64)
        inside = ~blank[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.off] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:n]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:n]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(starts, self.off)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each byte range, equal for equal bytes."""
        p, inv = powers(len(self.data) + 1)
        if self._prefix is None:
            self._prefix = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * p[: len(self.data)], out=self._prefix[1:])
        return mix((self._prefix[ends] - self._prefix[starts]) * inv[starts])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r"""Start and end of every \n-split line, and the number of lines before each text."""
        breaks = np.flatnonzero(self.data == 10)
        before = np.searchsorted(breaks, self.off)
        owner = np.repeat(np.arange(self.n), np.diff(before))
        line_off = before + np.arange(self.n + 1)
        starts, ends = np.empty(line_off[-1], np.int64), np.empty(line_off[-1], np.int64)
        at = np.arange(len(breaks)) + owner
        starts[line_off[:-1]], ends[line_off[1:] - 1] = self.off[:-1], self.off[1:]
        starts[at + 1], ends[at] = breaks + 1, breaks
        return starts, ends, line_off

    def chars(self) -> np.ndarray:
        """Code points before each byte position."""
        out = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=out[1:])
        return out


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of values[off[i]:off[i+1]] for each i, empty ranges included."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def chunks(batches: Iterator[pa.RecordBatch], text_col: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of the batches with about `most` bytes of text each (a longer single text stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = Texts.from_arrow(batch.column(text_col))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(texts.off, texts.off[at] + most, "right")) - 1)
            off = texts.off[at : to + 1]
            yield batch.slice(at, to - at), Texts(texts.data[off[0] : off[-1]], off - off[0])
            at = to


def weights_of(df: DataFrame, column: str) -> np.ndarray:
    """The single array that a fitting task returned."""
    rows = df.select(column).collect()
    return np.array(rows[0][0], np.float64) if rows else np.zeros(0)
