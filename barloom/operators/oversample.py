"""Oversampling of a minority class: rows between a row and one of its nearest neighbours, until the classes are even.

Neighbours are found exactly. Rows are cut into cells by their distance from the class's mean, and large cells by a hash, so that copies don't fill one. Each row's k-th best distance within
its own cell bounds its search: by the triangle inequality nearer rows lie in cells whose distances from the mean differ by no more. A task holds the rows of one
cell, whose number is bounded, and streams the rows that ask for it; k rows for each row and cell come out and are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship


@dataclass(frozen=True)
class SmoteParams:
    """k: neighbours to choose from. cell: rows of a cell, about. cells: ranges of distance at most; beyond that cells are cut by hash. seed: of the draws."""

    k: int = 5
    cell: int = 4096
    cells: int = 2048
    seed: int = 42


FOUND = "q string, d double, id string, v array<double>"


def asked(rows: DataFrame, parts: int, k: int) -> DataFrame:
    """q, d, id, v: the k nearest rows (role 0) of the part for each asking row (role 1). rows: part, role, id, v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = [], []
        there = None
        for b in batches:
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 0))
            role, names = b.column("role").to_numpy(), b.column("id").to_pylist()
            own = np.flatnonzero(role == 0)
            if len(own):
                ids += [names[i] for i in own]
                held.append(v[own])
            asks = np.flatnonzero(role == 1)
            if not len(asks) or not held:
                continue
            if there is None:
                there, order = np.concatenate(held), np.argsort(np.array(ids, object))
                there, ids = there[order], [ids[i] for i in order]  # so that ties go to the smaller id
            step = max(1, (1 << 22) // max(1, there.size))
            out: list[tuple] = []
            for at in range(0, len(asks), step):
                some = asks[at : at + step]
                d = ((v[some][:, None, :] - there[None, :, :]) ** 2).sum(2)
                for i, row in zip(some, d):
                    best = np.argsort(row, kind="stable")[: k + 1]
                    best = [j for j in best if ids[j] != names[i]][:k]
                    out += [(names[i], float(np.sqrt(row[j])), ids[j], there[j].tolist()) for j in best]
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.list_(pa.float64()))], names=["q", "d", "id", "v"])

    ship(rows.sparkSession)
    dealt = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("role", "id").select("role", "id", "v")
    return dealt.mapInArrow(run, FOUND)


def neighbours(rows: DataFrame, p: SmoteParams = SmoteParams()) -> DataFrame:
    """id, v, near (d, id, v of the k nearest other rows, nearest first, ties by id; fewer rows: all). rows: id (string, distinct) and v (array<double>, all as long)."""
    width = rows.select(F.size("v").alias("w")).first()
    if width is None:
        return rows.withColumn("near", F.array().cast("array<struct<d:double,id:string,v:array<double>>>"))
    stats = rows.agg(F.count("*").alias("n"), *[F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(width["w"])]).first()
    mean = F.array(*[F.lit(float(stats[f"m{i}"])) for i in range(width["w"])])
    r = F.sqrt(F.aggregate(F.zip_with("v", mean, lambda a, m: (a - m) * (a - m)), F.lit(0.0), lambda s, x: s + x))
    rows = rows.withColumn("r", r)
    cells = int(min(p.cells, max(1, stats["n"] // p.cell)))
    edges = rows.agg(F.percentile_approx("r", [i / cells for i in range(1, cells)], 10 * cells)).first()[0] if cells > 1 else []
    edges = sorted(set(edges))  # `cells` numbers at most
    bounds = F.array(*map(F.lit, edges)) if edges else F.array().cast("array<double>")
    at = lambda x: F.size(F.filter(bounds, lambda e: e < x))
    rows = rows.withColumn("cell", at(F.col("r")))
    sizes = {x["cell"]: x["n"] for x in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # `cells` rows at most
    salts = [max(1, -(-sizes.get(c, 0) // p.cell)) for c in range(len(edges) + 1)]
    first = np.concatenate([[0], np.cumsum(salts)]).tolist()
    firsts, many = F.array(*map(F.lit, first)), F.array(*map(F.lit, salts))
    part = lambda c, salt: (F.get(firsts, c) + salt).cast("int")
    rows = rows.withColumn("part", part(F.col("cell"), F.pmod(F.xxhash64("id", F.lit(p.seed)), F.get(many, F.col("cell")))))
    parts, own = first[-1], rows.select("part", F.lit(0).alias("role"), "id", "v")
    home = asked(own.unionByName(own.withColumn("role", F.lit(1))), parts, p.k)
    reach = home.groupBy("q").agg(F.when(F.count("*") >= p.k, F.max("d")).alias("reach"))
    asks = rows.join(reach, rows["id"] == reach["q"], "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))) * (1 + 1e-9) + 1e-9)
    span = F.sequence(F.get(firsts, at(F.col("r") - F.col("reach"))), F.get(firsts, at(F.col("r") + F.col("reach")) + 1) - 1)
    away = asks.select(F.explode(F.filter(span.cast("array<int>"), lambda x: x != F.col("part"))).alias("part"), F.lit(1).alias("role"), "id", "v")
    every = home.unionByName(asked(own.unionByName(away), parts, p.k))
    near = every.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "id", "v"))), 1, p.k).alias("near"))  # k rows a part
    return rows.join(near, rows["id"] == near["q"], "left").select(rows["id"], rows["v"], F.coalesce("near", F.array().cast("array<struct<d:double,id:string,v:array<double>>>")).alias("near"))


def oversampled(rows: DataFrame, features: list[str], keys: list[str], label: str = "target", p: SmoteParams = SmoteParams()) -> DataFrame:
    """keys, features, label and synthetic: the rows, and as many new ones of the smaller of two classes (0, 1) as it lacks. New rows carry the keys of the row that they begin from, and lie
    on the way to one of its neighbours, where and to which one is drawn by a hash; a row without neighbours is repeated. Rows are told apart by their keys; features must not be null."""
    base = rows.select(*keys, *[F.col(f).cast("double").alias(f) for f in features], label)
    n = {r[label]: r["n"] for r in base.groupBy(label).agg(F.count("*").alias("n")).collect()}  # two rows
    plain = base.withColumn("synthetic", F.lit(False))
    if len(n) < 2 or len(set(n.values())) < 2:
        return plain
    few, lacks = min(n, key=n.get), max(n.values()) - min(n.values())
    small = base.filter(F.col(label) == few).withColumn("_id", F.to_json(F.struct(*keys)))
    near = neighbours(small.select(F.col("_id").alias("id"), F.array(*features).alias("v")), p)
    extra = near.select("id").orderBy(F.xxhash64("id", F.lit(p.seed + 1)), "id").limit(lacks % n[few]).withColumn("more", F.lit(1))
    times = F.lit(lacks // n[few]) + F.coalesce("more", F.lit(0))
    near = near.join(extra, "id", "left").withColumn("j", F.explode(F.when(times > 0, F.sequence(F.lit(1), times.cast("int"))).otherwise(F.array().cast("array<int>"))))
    which = F.pmod(F.xxhash64("id", "j", F.lit(p.seed + 2)), F.greatest(F.size("near"), F.lit(1))).cast("int")
    gap = F.pmod(F.xxhash64("id", "j", F.lit(p.seed + 3)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    to = F.coalesce(F.get(F.col("near"), which)["v"], F.col("v"))
    near = near.withColumn("_g", gap).withColumn("_new", F.zip_with("v", to, lambda a, b: a + (b - a) * F.col("_g")))
    new = near.join(small.select("_id", *keys), near["id"] == small["_id"]).select(*keys, *[F.col("_new")[i].alias(f) for i, f in enumerate(features)], F.lit(few).cast(base.schema[label].dataType).alias(label), F.lit(True).alias("synthetic"))
    return plain.unionByName(new)
