r"""Reversible line dedup: sharded cuckoo filters, backed by exact reference tables.

A line's key is the line without white space at its ends and with A-Z lower-cased; keys of at least `min_chars` code
points take part. The index holds one reference (key, document) for each document that has the key, and for each
shard of the keys a cuckoo filter of the keys that at least two documents have. A document's lines first probe their
shard's filter: what it rejects is certain to be unrepeated, only the rest is looked up in the reference table.

Inserting or deleting documents writes a delta, the references that come or go, and changes their keys in their shards' filters, so an
index after a deletion equals one that never held the document. After `most_parts` deltas the table is written whole. A filter that gets full
is built anew, larger, from the exact table; when references outgrow the shards twice, all are dealt to more shards.

Keys are 128-bit BLAKE2 digests. Documents are rows with one id of any type that has an order: rows of equal id are one document, rows with a
null id are one document after all others. Null and empty texts have one empty line, which stays; a line that stands
twice in one document only isn't repeated. Long texts are read whole. An empty table gives an empty index, which drops nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import FEW, as_text, chunks, few, map_arrow, mix, park

KEY = np.dtype([("k1", "<i8"), ("k2", "<i8")])


@dataclass(frozen=True)
class Params:
    """min_chars: code points of a key that takes part. shard_keys: references of a shard, about.
    probe_rows: lines that one probing task takes, about. load: filled share of a cuckoo filter. most_parts: deltas kept apart.
    few: repeated lines that are broadcast at once; of more, those of very many documents are."""

    min_chars: int = 10
    shard_keys: int = 1 << 18
    probe_rows: int = 1 << 18
    load: float = 0.7
    most_parts: int = 8
    few: int = FEW


def keys_of(text: bytes, min_chars: int) -> list[bytes | None]:
    """A key for each line, None where the line doesn't take part."""
    out: list[bytes | None] = []
    for line in text.lower().split(b"\n"):
        k = line.strip()
        if len(k) < min_chars or not k.isascii() and len(k) < 4 * min_chars and len(k.decode("utf-8", "replace")) < min_chars:
            out.append(None)
        else:
            out.append(hashlib.blake2b(k, digest_size=16).digest())
    return out


class CuckooFilter:
    """Buckets of four 16-bit marks; every mark stands in one of two buckets that follow from each other."""

    def __init__(self, cells: np.ndarray):
        self.cells = cells.reshape(-1, 4)

    @classmethod
    def sized(cls, n: int, load: float = 0.7) -> CuckooFilter:
        return cls(np.zeros((1 << max(4, int(np.ceil(np.log2(max(1, n) / load / 4)))), 4), np.uint16))

    def places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mark = (k2.astype(np.uint64) >> np.uint64(11)).astype(np.uint16)
        mark[mark == 0] = 1
        return mark, (mix(k1.astype(np.uint64)) & np.uint64(len(self.cells) - 1)).astype(np.int64)

    def other(self, mark: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at ^ (mix(mark.astype(np.uint64) + np.uint64(77)) & np.uint64(len(self.cells) - 1)).astype(np.int64)

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> bool:
        """Whether all found a place; if not, the filter is too small and must be built anew."""
        mark, at = self.places(k1, k2)
        rng = np.random.default_rng(1)
        for turn in range(2000):
            if not len(mark):
                return True
            _, first = np.unique(at, return_index=True)
            m, b = mark[first], at[first]
            free = self.cells[b] == 0
            slot = np.where(free.any(1), free.argmax(1), rng.integers(0, 4, len(b)))
            out = self.cells[b, slot]
            self.cells[b, slot] = m
            rest = np.ones(len(mark), bool)
            rest[first] = False
            kicked = out != 0
            wait = at[rest]
            if turn % 2:
                wait = self.other(mark[rest], wait)
            mark, at = np.concatenate([mark[rest], out[kicked]]), np.concatenate([wait, self.other(out[kicked], b[kicked])])
        return False

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        mark, at = self.places(k1, k2)
        return (self.cells[at] == mark[:, None]).any(1) | (self.cells[self.other(mark, at)] == mark[:, None]).any(1)

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """The keys must have been inserted."""
        mark, at = self.places(k1, k2)
        for m, a, b in zip(mark, at, self.other(mark, at)):
            for bucket in (a, b):
                hit = np.flatnonzero(self.cells[bucket] == m)
                if len(hit):
                    self.cells[bucket, hit[0]] = 0
                    break


ON = ["shard", "k1", "k2"]


@dataclass(frozen=True)
class LineIndex:
    """parts: tables of shard, k1, k2, doc and step (1: the reference comes, below 0: it goes). filters: shard, n, cells. All are tables in the shared folder.
    total: references, those that go counted too."""

    parts: tuple[DataFrame, ...]
    filters: DataFrame
    shards: int
    total: int
    p: Params

    @classmethod
    def build(cls, documents: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        return cls._of(park(references(documents, p, id_col, text_col)), p)

    @classmethod
    def _of(cls, refs: DataFrame, p: Params) -> LineIndex:
        """refs: k1, k2, doc."""
        total = refs.count()
        shards = max(1, -(-total // p.shard_keys))
        refs = refs.select(shard_of(shards), "k1", "k2", "doc", F.lit(1).alias("step"))
        return cls((refs,), park(updated(no_filters(refs), repeated(refs).select(*ON, F.lit(1).alias("step")), p)), shards, total, p)

    def references(self) -> DataFrame:
        """shard, k1, k2, doc: each at least once."""
        if len(self.parts) == 1:
            return self.parts[0].drop("step")
        every = reduce(DataFrame.union, self.parts)
        return every.groupBy(*ON, "doc").agg(F.sum("step").alias("step")).filter("step > 0").drop("step")

    def _moved(self, delta: DataFrame) -> LineIndex:
        """The index with a delta (a parked table), whose references come or go for the first time."""
        total = self.total + delta.count()
        grown = replace(self, parts=(*self.parts, delta), total=total)
        if total > 2 * self.shards * self.p.shard_keys:
            return self._of(park(grown.references().select("k1", "k2", "doc")), self.p)
        touched = park(delta.select(*ON).distinct())
        near = few(touched)
        was, now = (repeated(x.references().join(near, ON, "left_semi")) for x in (self, grown))
        changes = now.join(was, ON, "left_anti").select(*ON, F.lit(1).alias("step")).union(was.join(now, ON, "left_anti").select(*ON, F.lit(-1).alias("step")))
        filters = park(updated(self.filters, changes, self.p))
        full = filters.filter("cells is null").select("shard")
        if not full.isEmpty():
            keys = repeated(grown.references().join(F.broadcast(full), "shard", "left_semi"))  # a row for each shard
            anew = updated(no_filters(filters), keys.select(*ON, F.lit(1).alias("step")), self.p)
            filters = park(filters.filter("cells is not null").union(anew))
        if len(grown.parts) > self.p.most_parts:
            whole = park(grown.references().withColumn("step", F.lit(1)))
            grown = replace(grown, parts=(whole,), total=whole.count())
        return replace(grown, filters=filters)

    def insert(self, documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        new = references(documents, self.p, id_col, text_col).select(shard_of(self.shards), "k1", "k2", "doc").distinct()
        old = self.references().select(*(F.col(c).alias(f"_{c}") for c in (*ON, "doc")))
        same = F.col("doc").eqNullSafe(F.col("_doc"))
        for c in ON:
            same = same & (F.col(c) == F.col(f"_{c}"))
        return self._moved(park(new.join(old, same, "left_anti").withColumn("step", F.lit(1))))

    def delete(self, ids: DataFrame) -> LineIndex:
        """ids: one column of document ids."""
        every = reduce(DataFrame.union, self.parts)
        gone = park(ids.select(F.col(ids.columns[0]).cast(every.schema["doc"].dataType).alias("_gone")).distinct())
        out = every.join(few(gone), F.col("doc").eqNullSafe(F.col("_gone")), "left_semi")
        return self._moved(park(out.groupBy(*ON, "doc").agg((-F.sum("step")).cast("int").alias("step")).filter("step < 0")))

    def dropped(self) -> DataFrame:
        """doc, k1, k2: keys whose lines the document loses, as another document with a smaller id holds them.

        References probe their shard's filter in groups of about probe_rows: a shard that a frequent key swells gets more
        groups, by its counted references. The hits are verified against the exact table, which holds a frequent key once.
        """
        refs, p = self.references(), self.p
        groups = refs.groupBy("shard").agg(F.ceil(F.count("*") / p.probe_rows).cast("int").alias("groups"))
        groups = park(groups.withColumnRenamed("shard", "_shard"))  # a row for each shard
        dealt = refs.join(few(groups), F.col("shard") == F.col("_shard")).withColumn("salt", F.pmod(F.xxhash64("doc", "k2"), F.col("groups")).cast("int")).drop("_shard", "groups")
        filters = self.filters.join(few(groups), F.col("shard") == F.col("_shard"))
        filters = filters.select("shard", "cells", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"))

        def probe(left: pa.Table, right: pa.Table) -> pa.Table:
            if not right.num_rows:
                return left.select(["k1", "k2", "doc"]).slice(0, 0)
            have = CuckooFilter(np.frombuffer(right.column("cells")[0].as_py(), np.uint16))
            hit = have.contains(left.column("k1").to_numpy(), left.column("k2").to_numpy())
            return left.select(["k1", "k2", "doc"]).filter(pa.array(hit))

        kind = refs.schema["doc"].dataType.simpleString()
        hits = dealt.groupBy("shard", "salt").cogroup(filters.groupBy("shard", "salt")).applyInArrow(probe, f"k1 long, k2 long, doc {kind}")
        return self.firsts(hits).filter(~F.col("doc").eqNullSafe(F.col("first"))).select("doc", "k1", "k2")

    def firsts(self, hits: DataFrame) -> DataFrame:
        """Adds `first`, a repeated key's least document; rows whose key isn't repeated go.

        More than p.few repeated keys are shuffled, but for those that more than a p.few-th of all references have, fewer than p.few: these are
        broadcast, and their rows go to tasks by their documents, so that a line of every document meets in no single task.
        """
        exact = park(repeated(self.references()).select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "first", "holders"))
        on = (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))
        if exact.count() <= self.p.few:
            return hits.join(F.broadcast(exact), on).drop("_k1", "_k2", "holders")
        frequent = F.col("holders") > max(self.total // self.p.few, min(self.p.probe_rows, self.total // 64))
        hits = hits.join(F.broadcast(exact.filter(frequent).select("_k1", "_k2", F.col("first").alias("_hot"))), on, "left").drop("_k1", "_k2")
        hits = hits.withColumn("_at", F.when(F.col("_hot").isNull(), F.col("k1")).otherwise(F.xxhash64("doc", "k2")))
        rest = exact.filter(~frequent).select("_k1", "_k2", F.col("first").alias("_cold")).hint("shuffle_hash")
        hits = hits.join(rest, F.col("_hot").isNull() & (F.col("_at") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left")
        return hits.withColumn("first", F.coalesce("_hot", "_cold")).filter("first is not null").drop("_hot", "_cold", "_at", "_k1", "_k2")


def shard_of(shards: int) -> Column:
    return F.pmod("k1", F.lit(shards)).cast("int").alias("shard")


def no_filters(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "shard int, n long, cells binary")


def references(documents: DataFrame, p: Params, id_col: str, text_col: str) -> DataFrame:
    """k1, k2, doc: the distinct keys of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in chunks(batches, "_text"):
            raw = t.data.tobytes()
            rows, keys = [], []
            for i, (a, b) in enumerate(zip(t.off[:-1], t.off[1:])):
                own = {k for k in keys_of(raw[a:b], p.min_chars) if k}
                keys += own
                rows.append(np.full(len(own), i))
            k = np.frombuffer(b"".join(keys), KEY)
            docs = batch.column("doc").take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([pa.array(k["k1"].copy()), pa.array(k["k2"].copy()), docs], names=["k1", "k2", "doc"])

    src = documents.select(documents[id_col].alias("doc"), as_text(documents, text_col).alias("_text"))
    return map_arrow(src, run, f"k1 long, k2 long, doc {documents.schema[id_col].dataType.simpleString()}")


def repeated(refs: DataFrame) -> DataFrame:
    """shard, k1, k2, first, holders: keys of at least two documents, the least of these and the references."""
    per = refs.groupBy(*ON).agg(F.min("doc").alias("first"), F.max("doc").alias("_last"), F.count("doc").alias("_some"), F.count("*").alias("holders"))
    return per.filter((F.col("first") != F.col("_last")) | (F.col("_some") > 0) & (F.col("_some") < F.col("holders"))).drop("_last", "_some")


def updated(filters: DataFrame, changes: DataFrame, p: Params) -> DataFrame:
    """Filters after keys are added (step 1) and removed (step -1). Keys are distinct, so a shard has a few times shard_keys at most.
    A filter that gets full has null cells: it must be built anew from its keys."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        k1, k2, step = (right.column(c).to_numpy() for c in ("k1", "k2", "step"))
        shard = (left if left.num_rows else right).column("shard")[0].as_py()
        add, sub = step > 0, step < 0
        n = (left.column("n")[0].as_py() if left.num_rows else 0) + int(add.sum()) - int(sub.sum())
        if left.num_rows:
            have = CuckooFilter(np.frombuffer(left.column("cells")[0].as_py(), np.uint16).copy())
            have.delete(k1[sub], k2[sub])
            fits = n <= 0.95 * have.cells.size and have.insert(k1[add], k2[add])
        else:
            have, fits = CuckooFilter.sized(int(add.sum()) + 64, p.load), True
            while not have.insert(k1[add], k2[add]):
                have = CuckooFilter(np.zeros((2 * len(have.cells), 4), np.uint16))
        cells = have.cells.tobytes() if fits else None
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([n], pa.int64()), "cells": pa.array([cells], pa.binary())})

    return filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(run, "shard int, n long, cells binary")


def dedup(documents: DataFrame, index: LineIndex, carry: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The carried columns as _c0, _c1, ..., then _text (the lines that stay, joined by newlines), _lines and _dropped."""
    drops = index.dropped().groupBy("doc").agg(F.collect_set(F.struct("k1", "k2")).alias("_keys"))  # at most a document's lines
    src = documents.select(*[documents[c].alias(f"_c{i}") for i, c in enumerate(carry)], as_text(documents, text_col).alias("_text"), documents[id_col].alias("_doc"))
    # the build side holds 16 bytes for each dropped line; texts stream past it unsorted
    joined = src.join(drops.hint("shuffle_hash"), src["_doc"].eqNullSafe(drops["doc"]), "left").drop("_doc", "doc")
    least = index.p.min_chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, gone = [], [], []
            for text, drop in zip(batch.column("_text"), batch.column("_keys")):
                raw = text.as_py().encode()
                if not drop.is_valid:
                    texts.append(raw), lines.append(raw.count(b"\n") + 1), gone.append(0)
                    continue
                bad = {np.array((x["k1"], x["k2"]), KEY).tobytes() for x in drop.as_py()}
                own = raw.split(b"\n")
                stay = [line for line, k in zip(own, keys_of(raw, least)) if k not in bad]
                texts.append(b"\n".join(stay)), lines.append(len(own)), gone.append(len(own) - len(stay))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(carry))), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], names=[*(f"_c{i}" for i in range(len(carry))), "_text", "_lines", "_dropped"])

    kinds = "".join(f"_c{i} {documents.schema[c].dataType.simpleString()}, " for i, c in enumerate(carry))
    return map_arrow(joined, run, f"{kinds}_text string, _lines long, _dropped long")
