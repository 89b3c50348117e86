"""Centroid clustering with block-norm screening, in exact integers.

Every vector becomes integers, once, and is parked with its compressed form: for each segment of a few components their
sum and the norm of what is left beside their mean. By Cauchy-Schwarz, two vectors are in a segment at least as far apart as
those two numbers say: |v - c|^2 >= (sum v - sum c)^2 / width + (rest v - rest c)^2. A vector's exact distance to the centroid
with the least bound comes first; only centroids whose bound doesn't exceed the best distance so far get an exact one.

A round is one pass over the parked vectors. Tasks send at most one row of sums a cluster, which are added up by cluster; centroids, a
bounded table of `clusters` rows, are the only thing that comes to the driver and goes to tasks. A lost executor's tasks give the same sums again.

Kept are vectors of exactly `dim` components, none null or not finite; others, null vectors included, have no row. Zero vectors and copies count like any
other, repeated rows each have a row, ties go to the smaller number. A null id is hashed as empty text and carried. Fewer vectors than
`clusters`: as many centroids as vectors; an empty table gives an empty result. Only the id and the vector are read, whatever else the table holds. Components are
limited to 2^27 / `scale`: beyond that squared distances don't fit 64 bits, and the job fails saying so.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import map_arrow, park, unpark

LIMIT = 1 << 27


@dataclass(frozen=True)
class Params:
    """scale: of components before they are rounded down. seed: precedes an id where starting vectors are drawn. segment: components a bound is made from."""

    clusters: int = 40
    rounds: int = 5
    dim: int = 64
    scale: int = 256
    seed: str = "2"
    segment: int = 8


def finite(vec: Column) -> Column:
    """Whether a vector isn't null and has no null or non-finite component."""
    return vec.isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def matrix(col: pa.Array, kind, width: int) -> np.ndarray:
    """Rows of a column of binary values of `width` numbers each."""
    if not len(col):
        return np.zeros((0, width), kind)
    each = width * np.dtype(kind).itemsize
    return np.frombuffer(col.buffers()[2], kind)[: (col.offset + len(col)) * width][col.offset * width :].reshape(-1, width) if each else np.zeros((len(col), 0), kind)


def binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    each = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * each).astype(np.int32)), pa.py_buffer(rows)])


def compressed(v: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of segments, and norms of what is left beside the mean, for rows of integers."""
    v = np.pad(v.astype(np.int64), ((0, 0), (0, -v.shape[1] % segment)))
    s = v.reshape(len(v), v.shape[1] // segment, segment)
    total = s.sum(2)
    return total, np.sqrt((segment * (s * s).sum(2) - total * total) / segment)


class Nearest:
    """Assigns integer vectors to the nearest of some centroids, screened by segment norms."""

    def __init__(self, centroids: list[list[int]], p: Params):
        self.p, self.c = p, np.array(centroids, np.int64).reshape(-1, p.dim)
        self.total, self.rest = compressed(self.c, p.segment)
        self.square = (self.c * self.c).sum(1).astype(float)

    def __call__(self, v: np.ndarray, total: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Cluster and squared distance of each row, and how many exact distances were taken."""
        v, n, k = v.astype(np.int64), len(v), len(self.c)
        bound = np.zeros((n, k))
        for j in range(total.shape[1]):
            bound += (total[:, j, None] - self.total[:, j]).astype(float) ** 2 / self.p.segment + (rest[:, j, None] - self.rest[:, j]) ** 2
        bound -= 1e-12 * ((v * v).sum(1).astype(float)[:, None] + self.square) + 0.5  # more than rounding can add
        best = bound.argmin(1)
        apart = v - self.c[best]
        least, exact = (apart * apart).sum(1), n
        first = best.copy()
        for c in range(k):
            rows = np.flatnonzero((bound[:, c] <= least) & (first != c))
            apart = v[rows] - self.c[c]
            d = (apart * apart).sum(1)
            nearer = (d < least[rows]) | (d == least[rows]) & (c < best[rows])
            best[rows[nearer]], least[rows[nearer]] = c, d[nearer]
            exact += len(rows)
        return best, least, exact


def integers(vectors: DataFrame, p: Params = Params(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """_id, v, total, rest: the kept vectors as integers, and their compressed form."""
    width = -(-p.dim // p.segment)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column("_v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            v = np.floor(p.scale * flat).reshape(b.num_rows, p.dim)
            if v.size and np.abs(v).max() > LIMIT:
                raise OverflowError(f"a component of {np.abs(v).max() / p.scale:g} gives distances beyond 64 bits")
            v = v.astype(np.int32)
            total, rest = compressed(v, p.segment)
            yield pa.RecordBatch.from_arrays([b.column("_id"), binary(v), binary(total), binary(rest)], names=["_id", "v", "total", "rest"])

    rows = vectors.select(vectors[id_col].alias("_id"), vectors[vec_col].alias("_v")).filter((F.size("_v") == p.dim) & finite(F.col("_v")))
    assert width * p.segment >= p.dim
    return map_arrow(rows, run, f"_id {vectors.schema[id_col].dataType.simpleString()}, v binary, total binary, rest binary")


def parts(b: pa.RecordBatch, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = -(-p.dim // p.segment)
    return matrix(b.column("v"), np.int32, p.dim), matrix(b.column("total"), np.int64, width), matrix(b.column("rest"), np.float64, width)


def moved(rows: DataFrame, centroids: list[list[int]], p: Params) -> list[list[int]]:
    """The centroids after one round: floors of the means of their vectors, empty ones as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Nearest(centroids, p)
        count, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), p.dim), np.int64)
        for b in batches:
            v, total, rest = parts(b, p)
            best, _, _ = near(v, total, rest)
            np.add.at(sums, best, v)
            count += np.bincount(best, minlength=len(count))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    found = map_arrow(rows.select("v", "total", "rest"), run, "cluster int, n long, sums array<long>")
    wide = [F.sum(F.col("sums")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(p.dim)]
    out = [list(c) for c in centroids]
    for r in found.groupBy("cluster").agg(F.sum("n").alias("n"), *wide).collect():  # a row for each cluster at most
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(p.dim)]
    return out


def cluster(vectors: DataFrame, p: Params = Params(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, cluster, distance (squared), cluster_inertia, inertia, centroid (integers) for each kept vector."""
    rows = park(integers(vectors, p, id_col, vec_col))
    drawn = F.sha2(F.concat(F.lit(f"{p.seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    first = rows.select(drawn.alias("h"), "v").orderBy("h", "v").limit(p.clusters).collect()
    centroids = [np.frombuffer(r["v"], np.int32).tolist() for r in first]
    for _ in range(p.rounds if centroids else 0):
        centroids = moved(rows, centroids, p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Nearest(centroids, p)
        for b in batches:
            best, least, _ = near(*parts(b, p))
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(best.astype(np.int32)), pa.array(least)], names=["_id", "cluster", "distance"])

    found = park(map_arrow(rows, run, f"_id {rows.schema['_id'].dataType.simpleString()}, cluster int, distance long"))
    unpark(rows)
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    table = [(i, inertia.get(i, 0), sum(inertia.values()), c) for i, c in enumerate(centroids)]
    ends = found.sparkSession.createDataFrame(table, "_k int, cluster_inertia long, inertia long, centroid array<long>")  # `clusters` rows
    out = found.join(F.broadcast(ends), F.col("cluster") == F.col("_k"))
    return out.select(F.col("_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")
