"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the mix maps the golden-ratio point frac((i + 1/2) * phi) through the cumulative targets to a source, so that
any stretch of the mix is near the target shares. Slots are ranked per source, and rank r takes the r-th block of
`block_words` words of the source's shuffled texts, starting anew after the last block. A source's ranks end where its
words reach its target; the last block is cut there.

Shuffling is by the MD5 of the id and of the text (then the id's order), so reruns agree and rows without ids, or of one id, are spread like others. Texts without
a word are never taken. Null sources form one source, last in order (so a source's place, and with it its weight, never depends on row order); rows equal in id and text share one place in
the shuffle, where they are interchangeable. Long texts are counted whole. An empty table gives an empty mix. There may be many sources: points meet them by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import as_text, chunks, few, map_arrow, park
from .running import running_total

PHI = 0.6180339887498949


@dataclass(frozen=True)
class Params:
    """weights: of the sources in order, repeating. cap: most times a source's words are taken.
    block_words: words of a block. rows_per_bucket: of the pieces that shuffled texts are cut into for running totals, about;
    slots_per_bucket: the same for slots. cells: pieces of the line from 0 to 1 in which points meet sources."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    cap: int = 3
    block_words: int = 1024
    rows_per_bucket: int = 4096
    slots_per_bucket: int = 4096
    cells: int = 4096


def word_counts(documents: DataFrame, carry: list[str], text_col: str = "text") -> DataFrame:
    """The carried columns and `size`, the words of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in chunks(batches, "_text"):
            _, _, off = t.spans()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(off[1:] - off[:-1])], names=[*carry, "size"])

    src = documents.select(*carry, as_text(documents, text_col).alias("_text"))
    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in carry)
    return map_arrow(src, run, f"{kinds}, size long")


def targets(sizes: DataFrame, p: Params = Params()) -> DataFrame:
    """source, source_size, target: shares of all words by weight; what lies above cap times a source's words is shared
    out again by weight among the rest. One row per source, so the windows below see the sources only.

    With sources in the order in which they fill up (cap * size / weight), the level after filling the first k is
    (total - their caps) / weight of the rest; the first source that this level leaves below its cap ends the filling.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = Window.orderBy(F.col("source").asc_nulls_last())
    at = (F.row_number().over(w) - 1) % len(p.weights)
    per = per.withColumn("_w", F.element_at(F.array(*[F.lit(float(x)) for x in p.weights]), (at + 1).cast("int")))
    per = per.withColumn("_cap", F.col("source_size") * float(p.cap)).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    all_ = Window.partitionBy(F.lit(0))
    fill = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(all_) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(fill.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("_level", level).withColumn("_full", F.col("_ratio") <= F.col("_level"))
    stop = F.min(F.when(~F.col("_full"), F.struct("_ratio", F.coalesce("source", F.lit("")), "_level"))).over(all_)["_level"]
    return per.withColumn("_stop", stop).select("source", "source_size", F.when(F.col("_stop").isNull() | (F.col("_ratio") <= F.col("_stop")), F.col("_cap")).otherwise(F.col("_w") * F.col("_stop")).alias("target"))


def digest(id_: Column, text: Column) -> Column:
    return F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(" "), F.md5(text.cast("binary"))).cast("binary"))


def shuffled(sizes: DataFrame, p: Params = Params(), id_col: str = "doc_id") -> DataFrame:
    """Adds `start`: the words of the same source that come before the row in the shuffle. sizes: with the _digest of each row, which goes."""
    buckets = min(1 << 28, max(256, sizes.count() // p.rows_per_bucket))
    bucket = (F.conv(F.substring("_digest", 1, 7), 16, 10).cast("long") * buckets / (1 << 28)).cast("int")
    return running_total(sizes, ["source"], bucket, ["_digest", id_col, "size"], "size", "start").drop("_digest")


def schedule(spark, per_source: DataFrame, p: Params = Params()) -> DataFrame:
    """slot, source, rank, epoch, block, words: the mix in order. per_source: rows of targets()."""
    b = float(p.block_words)
    s = per_source.filter("target > 0 and source_size > 0").withColumn("_words", F.round("target").cast("long"))
    s = s.withColumn("_blocks", F.ceil(F.col("source_size") / b).cast("long")).withColumn("_rest", F.col("_words") % F.col("source_size"))
    s = s.withColumn("_need", F.floor(F.col("_words") / F.col("source_size")).cast("long") * F.col("_blocks") + F.ceil(F.col("_rest") / b).cast("long")).filter("_need > 0")
    kind = per_source.schema["source"].dataType.simpleString()
    order = Window.orderBy(F.col("source").asc_nulls_last())  # a row for each source, as in targets()
    total = s.agg(F.sum("_need")).first()[0]
    if not total:
        return spark.createDataFrame([], f"slot long, source {kind}, rank long, epoch long, block long, words long")
    end = F.sum("_need").over(order.rowsBetween(Window.unboundedPreceding, 0))
    sources = s.select((F.row_number().over(order) - 1).alias("_at"), "source", F.col("source_size").alias("_size"), "_words", "_blocks", "_need", ((end - F.col("_need")) / total).alias("_lo"), (end / total).alias("_hi"))
    sources = park(sources)
    point = F.col("slot") * F.lit(PHI) + F.lit(PHI / 2)
    points = spark.range(total).withColumnRenamed("id", "slot").withColumn("_point", point - F.floor(point)).withColumn("_cell", F.floor(F.col("_point") * p.cells))
    ranges = park(sources.select("_at", "_lo", "_hi", F.explode(F.sequence(F.floor(F.col("_lo") * p.cells), F.floor(F.col("_hi") * p.cells))).alias("_c")))
    points = points.join(few(ranges), (F.col("_cell") == F.col("_c")) & (F.col("_point") >= F.col("_lo")) & (F.col("_point") < F.col("_hi"))).select("slot", "_at", F.lit(1).alias("_one"))
    sources = sources.drop("_lo", "_hi")
    number = sources.count()
    df = running_total(points, ["_at"], F.floor(F.col("slot") / p.slots_per_bucket), ["slot"], "_one", "rank").drop("_one")
    df = df.join(few(sources), "_at").filter("rank < _need")
    # the points miss a source's share by a few slots at most; the missing ranks come last
    have = points.groupBy("_at").agg(F.count("*").alias("_have"))
    short = sources.join(have, "_at", "left").withColumn("_have", F.coalesce("_have", F.lit(0))).filter("_have < _need")
    short = short.withColumn("rank", F.explode(F.sequence("_have", F.col("_need") - 1)))
    short = short.withColumn("slot", F.lit(total) + F.col("_at") + (F.col("rank") - F.col("_have")) * number)
    df = df.unionByName(short.select(*df.columns))
    df = df.withColumn("epoch", F.floor(F.col("rank") / F.col("_blocks"))).withColumn("block", F.col("rank") % F.col("_blocks"))
    at_word = F.col("epoch") * F.col("_size") + F.col("block") * p.block_words
    size = F.least(F.lit(p.block_words), F.col("_size") - F.col("block") * p.block_words, F.col("_words") - at_word)
    return df.select("slot", "source", "rank", "epoch", "block", size.cast("long").alias("words"))


def mix(documents: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, size, source_size, target, taken for each row: the words of it that the schedule's blocks take."""
    spark = documents.sparkSession
    src = documents.select(documents[id_col].alias("_id"), documents[source_col].cast("string").alias("source"), as_text(documents, text_col).alias("_text"))
    src = src.withColumn("_digest", digest(F.col("_id"), F.col("_text")))
    sizes = park(word_counts(src, ["_id", "source", "_digest"], "_text"))
    per = park(targets(sizes, p))
    rows = shuffled(sizes, p, "_id")
    slots = schedule(spark, per, p)
    # how often a block is taken whole, and the words taken of its cut copy
    full = F.col("words") >= F.least(F.lit(p.block_words), F.col("_size") - F.col("block") * p.block_words)
    taken = slots.join(few(per.select(F.col("source").alias("_s"), F.col("source_size").alias("_size"))), F.col("source").eqNullSafe(F.col("_s")))
    taken = taken.groupBy(F.col("source").alias("_src"), F.col("block").alias("_blk")).agg(F.sum(full.cast("long")).alias("_times"), F.sum(F.when(~full, F.col("words")).otherwise(0)).alias("_cut"))
    # one row for each block that a text reaches into; texts with a place but no word get none
    b = p.block_words
    rows = rows.withColumn("_row", F.struct("_id", "source", "size", "start"))
    pieces = rows.filter("size > 0").select("_id", "source", "size", "start", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))).alias("_b"))
    got = pieces.join(taken, pieces["source"].eqNullSafe(taken["_src"]) & (pieces["_b"] == taken["_blk"]), "left")
    lo, hi = F.greatest(F.col("start") - F.col("_b") * b, F.lit(0)), F.least(F.col("start") + F.col("size") - F.col("_b") * b, F.lit(b))
    words = F.coalesce(F.col("_times"), F.lit(0)) * (hi - lo) + F.greatest(F.least(hi, F.coalesce(F.col("_cut"), F.lit(0))) - lo, F.lit(0))
    got = got.groupBy("_id", "source", "size", "start").agg(F.sum(words).alias("taken"))
    got = got.unionByName(rows.filter("size = 0").select("_id", "source", "size", "start", F.lit(0).cast("long").alias("taken")))
    per = per.select(F.col("source").alias("_s"), "source_size", "target")
    out = got.join(few(per), F.col("source").eqNullSafe(F.col("_s")))
    return out.select(F.col("_id").alias(id_col), "source", F.col("size").cast("long").alias("size"), "source_size", "target", F.col("taken").cast("long").alias("taken"))
