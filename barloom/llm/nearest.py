"""Nearest neighbours by a block matrix join: int8 tiles with error bounds, exact floats for what survives, heaps.

Queries and candidates meet in the cells of a grid. Queries are dealt to stripes, candidates to stripes across, by a hash of their place; a cell
gets one stripe of each, so every pair meets in exactly one cell and no key, id or vector decides who meets where. A cell holds its queries
(`queries` at most on average) and streams its candidates in tiles, in the order of their ids.

A unit vector u is quantised to int8 codes with a scale of its own; e_u is the norm of what rounding leaves. Of the cosine of u and v the product
of codes over both scales is off by at most e_u * (1 + e_v) + e_v. A pair whose upper bound stays below the query's k-th best score so far (in a first tile: below the k-th
best lower bound) can't matter. The others get their cosine from the original vectors in double precision, added up in the order of components, and go to the query's heap
of k. Heaps of the cells are merged by a ranked window, k rows a query and cell. Of equal vectors in a tile only the k + 1 with the least ids can be among
the k nearest of anything, so copies never fill a heap's work: this loses nothing.

Exact: no candidate is skipped without a bound. A vector that is null, zero, or holds a null or non-finite component takes no part. Vectors of different lengths
don't meet. Each row is its own candidate set's exception, by place, not by id: repeated rows find each other. Ties go to the smaller id, null ids last. Fewer candidates than k: all of
them. An empty table gives an empty result. Only the id and the vector are read, whatever else the table holds; long vectors need memory for a tile of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import map_arrow
from .clustering import finite


@dataclass(frozen=True)
class Params:
    """k: neighbours. queries: most queries of a cell. candidates: most candidates of a cell; with fewer rows than cells for all cores, cells are smaller,
    of `least` candidates. tile: queries and candidates that are multiplied at once."""

    k: int = 5
    queries: int = 1 << 16
    candidates: int = 1 << 20
    least: int = 1024
    tile: tuple[int, int] = (512, 4096)


class Block:
    """Vectors of one length: exact doubles, int8 codes as floats (products of up to 1,024 components stay exact integers), scales and rounding norms."""

    SEGMENT = 1024

    def __init__(self, vecs: np.ndarray):
        top = np.abs(vecs).max(1)
        self.v = np.ldexp(vecs, -np.frexp(top)[1][:, None])  # by powers of two: exact, and no square overflows
        self.square = np.add.accumulate(self.v * self.v, axis=1)[:, -1]
        unit = self.v / np.sqrt(self.square)[:, None]
        self.scale = 127 / np.abs(unit).max(1)
        code = np.rint(unit * self.scale[:, None])
        self.rest = np.sqrt(((unit - code / self.scale[:, None]) ** 2).sum(1)) + 1e-6
        self.code = code.astype(np.int8)

    def products(self, a: slice, other: Block) -> np.ndarray:
        """Estimated cosines of own rows and all rows of the other."""
        out: np.ndarray | float = 0.0
        for at in range(0, self.code.shape[1], self.SEGMENT):
            part = slice(at, at + self.SEGMENT)
            out = out + self.code[a, part].astype(np.float32) @ other.code[:, part].astype(np.float32).T
        return out * (1 / self.scale[a]).astype(np.float32)[:, None] * (1 / other.scale).astype(np.float32)

    def cosines(self, i: np.ndarray, other: Block, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i))
        step = max(1, (1 << 20) // self.v.shape[1])
        for at in range(0, len(i), step):
            a, b = i[at : at + step], j[at : at + step]
            dot = np.add.accumulate(self.v[a] * other.v[b], axis=1)[:, -1]
            out[at : at + step] = dot / np.sqrt(self.square[a] * other.square[b])
        return np.clip(out, -1, 1)


def ranks(groups: np.ndarray) -> np.ndarray:
    """Place of each entry within its run of equal values."""
    first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]][: len(groups)])
    return np.arange(len(groups)) - np.repeat(first, np.diff(np.r_[first, len(groups)]))


class Cell:
    """The queries of one cell and of one length, with a heap each."""

    def __init__(self, rows: np.ndarray, ids: list, vecs: np.ndarray, p: Params):
        self.rows, self.ids, self.p, self.block = rows, ids, p, Block(vecs)
        self.heaps: list[list[tuple]] = [[] for _ in ids]
        self.least = np.full(len(ids), -np.inf)  # the k-th best score so far
        self.seen = self.exact = 0

    def meet(self, rows: np.ndarray, ids: list, vecs: np.ndarray) -> None:
        """One tile of candidates, in the order of their ids."""
        k = self.p.k
        _, same = np.unique(np.ascontiguousarray(vecs + 0.0).view(f"V{vecs.shape[1] * 8}").ravel(), return_inverse=True)
        order = np.argsort(same, kind="stable")
        keep = np.sort(order[ranks(same[order]) <= k])
        rows, vecs = rows[keep], vecs[keep]
        block, width = Block(vecs), self.p.tile[0]
        at_row = np.argsort(rows)
        for a in range(0, len(self.rows), width):
            part = slice(a, a + width)
            up = self.block.products(part, block)
            spread = self.block.rest[part, None] * (1 + block.rest).astype(np.float32) + block.rest.astype(np.float32)
            own = at_row[np.minimum(np.searchsorted(rows, self.rows[part], sorter=at_row), len(rows) - 1)]
            own_q = np.flatnonzero(rows[own] == self.rows[part])
            up[own_q, own[own_q]] = -np.inf
            floor = self.least[part].copy()
            new = np.flatnonzero(floor == -np.inf)
            if len(new) and len(rows) > k:
                floor[new] = np.partition(up[new] - spread[new], -k, axis=1)[:, -k]
            up += spread
            i, j = np.nonzero(up >= (floor - 1e-6)[:, None])
            real = up[i, j] > -np.inf
            self.push(i[real] + a, j[real], block, [ids[x] for x in keep])

    def push(self, i: np.ndarray, j: np.ndarray, block: Block, ids: list) -> None:
        k, self.exact = self.p.k, self.exact + len(i)
        score = self.block.cosines(i, block, j)
        order = np.lexsort((j, -score, i))
        order = order[ranks(i[order]) < k]
        order = order[score[order] >= self.least[i[order]]]
        for q, c, s in zip(i[order].tolist(), j[order].tolist(), score[order].tolist()):
            heap, self.seen = self.heaps[q], self.seen + 1
            entry = (s, -self.seen, ids[c])  # of equal scores the earlier one, which has the smaller id, is kept
            if len(heap) < k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == k:
                self.least[q] = heap[0][0]


def vectors_of(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and doubles of the vectors of each length in a batch."""
    length = b.column("_v").value_lengths().to_numpy()
    for d in np.unique(length):
        at = np.flatnonzero(length == d)
        yield at, b.column("_v").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), d)


class Held:
    """Rows of one length that wait to be used together."""

    def __init__(self):
        self.rows, self.ids, self.vecs, self.n = [], [], [], 0

    def add(self, rows: np.ndarray, ids: list, vecs: np.ndarray) -> None:
        self.rows.append(rows)
        self.ids += ids
        self.vecs.append(vecs)
        self.n += len(ids)

    def take(self) -> tuple[np.ndarray, list, np.ndarray]:
        return np.concatenate(self.rows), self.ids, np.concatenate(self.vecs)


def search(vectors: DataFrame, is_query: Column, p: Params = Params(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), id, score: the k nearest rows of each row for which is_query (over _id) holds."""
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(vectors[id_col].alias("_id"), vectors[vec_col].alias("_v"))
    n, nq = rows.select(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    down = max(1, -(-nq // p.queries))
    across = max(1, -(-n // p.candidates), min(-(-n // p.least), -(-tasks // down)))

    place = F.monotonically_increasing_id()  # of a row in its file split, so a task that runs again gives the same
    rows = rows.withColumn("_row", place).filter(finite(F.col("_v")) & F.exists("_v", lambda x: x != 0))
    mine = lambda salt, m: F.pmod(F.xxhash64("_row", F.lit(salt)), F.lit(m)).cast("int")
    as_candidate = F.transform(F.sequence(F.lit(0), F.lit(down - 1)), lambda r: F.struct((r * across + mine(1, across)).alias("cell"), F.lit(1).alias("role")))
    as_query = F.transform(F.sequence(F.lit(0), F.lit(across - 1)), lambda s: F.struct((mine(2, down) * across + s).alias("cell"), F.lit(0).alias("role")))
    roles = F.when(F.coalesce(is_query, F.lit(False)), F.concat(as_query, as_candidate)).otherwise(as_candidate)
    dealt = rows.select("_id", "_row", "_v", F.explode(roles).alias("_r")).select("_r.cell", "_r.role", "_id", "_row", "_v")
    dealt = dealt.repartitionById(down * across, F.col("cell")).sortWithinPartitions("role", F.col("_id").asc_nulls_last(), "_row").drop("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, Held] = {}
        tiles: dict[int, Held] = {}
        cells: dict[int, Cell] = {}

        def meet(d: int) -> None:
            if d not in cells:
                cells[d] = Cell(*asked[d].take(), p)
            cells[d].meet(*tiles.pop(d).take())

        for b in batches:
            role, row, ids = b.column("role").to_numpy(), b.column("_row").to_numpy(), b.column("_id").to_pylist()
            for at, vecs in vectors_of(b):
                d = vecs.shape[1]
                for which, held in ((0, asked), (1, tiles)):
                    of = np.flatnonzero(role[at] == which)
                    if len(of) and (held is asked or d in asked):
                        held.setdefault(d, Held()).add(row[at[of]], [ids[x] for x in at[of]], vecs[of])
                if d in tiles and tiles[d].n >= p.tile[1]:
                    meet(d)
        for d in list(tiles):
            meet(d)
        for cell in cells.values():
            for at in range(0, len(cell.ids), 4096):
                found = [(q, cell.ids[q], c, s) for q in range(at, min(at + 4096, len(cell.ids))) for s, _, c in cell.heaps[q]]
                cols = list(zip(*found)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.rows[list(cols[0])], pa.int64()), pa.array(cols[1], out_id), pa.array(cols[2], out_id), pa.array(cols[3], pa.float64())], names=["_q", "query_id", "id", "score"]
                )

    out_id = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind)
    if out_id is None:
        raise TypeError(f"ids are of type bigint, int or string, not {kind}")
    found = map_arrow(dealt, run, f"_q long, query_id {kind}, id {kind}, score double")
    best = Window.partitionBy("_q").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= p.k).select("query_id", "rank", "id", "score")
