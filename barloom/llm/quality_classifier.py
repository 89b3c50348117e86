"""Hashed word n-gram logistic regression, trained by follow-the-regularised-leader, scored as sparse dot products.

Features of a text, all hashed into 2^bits places: its words and word pairs, and the pairs and triples of the words'
shapes (letter case, digits and punctuation, runs collapsed, with a mark where a word equals one of the two before
it). A group of features weighs 1 in total, so length does not matter. Training takes one pass (or `passes`) over at most
`sample_rows` labelled documents in the order of their hashed ids; classes weigh alike.

Null and empty texts have no feature: their score is that of the bias. Long texts are read whole. Rows with null ids or labels teach nothing, and are scored like any other;
repeated rows are each scored, and a text that repeats under one id teaches once. Texts are taken in the order of hashed ids, ids, hashed texts, so reruns agree. An empty table gives an empty result; a table without labelled rows gives 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import as_text, chunks, labelled_sample, map_arrow, mix, sums, Texts

#: What a byte is in a word's shape: upper, lower or other letter, digit, else itself.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[65:91], SHAPE[97:123], SHAPE[128:], SHAPE[48:58] = 65, 97, 97, 48
GROUPS = 5


@dataclass(frozen=True)
class Params:
    """bits: log2 of the number of weights. sample_rows: labelled documents to learn from, a bound.
    alpha, beta, l1, l2: follow-the-regularised-leader. passes over the sample."""

    bits: int = 18
    sample_rows: int = 8000
    alpha: float = 0.4
    beta: float = 1.0
    l1: float = 1e-5
    l2: float = 1e-4
    passes: int = 2


def features(t: Texts, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each group: places of its features, and the number of features before each text."""
    starts, ends, off = t.spans()
    words = t.hashes(starts, ends)
    shape = SHAPE[t.data]
    fresh = np.ones(len(shape), bool)
    fresh[1:] = shape[1:] != shape[:-1]
    fresh[starts] = True
    rank = np.cumsum(fresh)
    base = np.zeros(len(shape), np.int64)
    base[starts] = rank[starts]
    np.maximum.accumulate(base, out=base)
    step = np.minimum(rank - base, 20)
    value = np.where(fresh, mix(shape.astype(np.uint64) * np.uint64(131) + step.astype(np.uint64) + np.uint64(1)), np.uint64(0))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
    same = np.zeros(len(words), np.uint64)
    owner = np.repeat(np.arange(t.n), np.diff(off))
    for back in (2, 1):
        hit = (words[back:] == words[:-back]) & (owner[back:] == owner[:-back])
        same[back:][hit] = back
    shapes = mix(total[ends] - total[starts] + same * np.uint64(0x9E3779B97F4A7C15))
    down = np.uint64(64 - bits)
    yield mix(words + np.uint64(1)) >> down, off
    yield mix(shapes + np.uint64(5)) >> down, off
    for source, n, salt in ((words, 2, 2), (shapes, 2, 3), (shapes, 3, 4)):
        at = np.arange(max(0, len(source) - n + 1))
        at = at[at + n <= off[owner[at] + 1]]
        key = np.full(len(at), salt, np.uint64)
        for k in range(n):
            key = (key + source[at + k]) * np.uint64(0xD6E8FEB86659FD93)
        yield mix(key) >> down, np.searchsorted(at, off)


def margins(t: Texts, w: np.ndarray, bits: int) -> np.ndarray:
    """w: the bias, then the weights."""
    out = np.full(t.n, float(w[0]))
    for places, off in features(t, bits):
        out += sums(w[1:][places.astype(np.int64)], off) / np.maximum(np.diff(off), 1)
    return out


def train_weights(examples: list[tuple[np.ndarray, np.ndarray, int]], p: Params) -> np.ndarray:
    """examples: places (0 is the bias), values, label."""
    z, n = np.zeros((1 << p.bits) + 1), np.zeros((1 << p.bits) + 1)
    kinds = np.array([y for *_, y in examples])
    weight = {y: 0.5 * len(kinds) / max(1, (kinds == y).sum()) for y in (0, 1)}

    def lead(at: np.ndarray | slice) -> np.ndarray:
        return np.where(np.abs(z[at]) <= p.l1, 0, -(z[at] - np.sign(z[at]) * p.l1) / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2))

    for _ in range(p.passes):
        for at, x, y in examples:
            w = lead(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x * weight[y]
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / p.alpha * w
            n[at] = grown
    return lead(slice(None))


def fit(documents: DataFrame, labels: DataFrame, keep: Column | None = None, p: Params = Params(), label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """The weights, from one task over the bounded sample. keep: a condition on `_id`."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for batch, t in chunks(batches, "_text", 1 << 19):
            got = [(f.astype(np.int64) + 1, off) for f, off in features(t, p.bits)]
            for k, y in enumerate(batch.column("_label").to_pylist()):
                at, x = [np.zeros(1, np.int64)], [np.ones(1)]
                for f, off in got:
                    places, count = np.unique(f[off[k] : off[k + 1]], return_counts=True)
                    at.append(places)
                    x.append(count / max(1, off[k + 1] - off[k]))
                at, back = np.unique(np.concatenate(at), return_inverse=True)
                examples.append((at.astype(np.int32), np.bincount(back, np.concatenate(x)).astype(np.float32), int(y == 1)))
        yield pa.RecordBatch.from_pydict({"w": pa.array([train_weights(examples, p).astype(np.float32).tobytes()], pa.binary())})

    sample = labelled_sample(documents, labels, label, F.lit(True) if keep is None else keep, p.sample_rows, id_col, text_col)
    got = map_arrow(sample.coalesce(1), train, "w binary").collect()
    return np.frombuffer(bytes(got[0][0]), np.float32).astype(np.float64) if got else np.zeros((1 << p.bits) + 1)


def score(documents: DataFrame, w: np.ndarray, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (probability of label 1) for each row."""
    w = w.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in chunks(batches, "_text"):
            got = 1 / (1 + np.exp(-np.clip(margins(t, w, p.bits), -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(got)], names=["_id", "score"])

    src = documents.select(documents[id_col].alias("_id"), as_text(documents, text_col).alias("_text"))
    return map_arrow(src, run, f"_id {documents.schema[id_col].dataType.simpleString()}, score double").withColumnRenamed("_id", id_col)
