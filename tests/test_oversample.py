"""Exact neighbours and new rows on the way to them, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import oversample as V


def made(rng, n, d=4):
    hot = [rng.gauss(0, 1) for _ in range(d)]
    return [(f"r{i:04}", hot if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(d)]) for i in range(n)]


@pytest.mark.parametrize("n, p", [(1, V.SmoteParams()), (4, V.SmoteParams()), (300, V.SmoteParams()), (300, V.SmoteParams(k=3, cell=16)), (200, V.SmoteParams(cell=9, cells=4))])
def test_neighbours_are_exact(spark, n, p):
    rows = made(random.Random(n), n)
    got = {r["id"]: [(round(x["d"], 9), x["id"]) for x in r["near"]] for r in V.neighbours(spark.createDataFrame(rows, "id string, v array<double>").repartition(3), p).collect()}
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5
    assert got == {i: sorted((round(dist(v, w), 9), j) for j, w in rows if j != i)[: p.k] for i, v in rows}


def test_new_rows_lie_between_neighbours(spark):
    rng = random.Random(9)
    rows = [(i, *[rng.gauss(3 * (i % 5 == 0), 1) for _ in range(3)], int(i % 5 == 0)) for i in range(203)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, target int")
    out = V.oversampled(df, ["a", "b", "c"], ["k"], p=V.SmoteParams(cell=20)).collect()
    assert [sum(r["target"] == t for r in out) for t in (0, 1)] == [162, 162] and sum(r["synthetic"] for r in out) == 121
    own = {r[0]: r[1:4] for r in rows if r[4]}
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5
    for r in out:
        if r["synthetic"]:
            x, new = own[r["k"]], (r["a"], r["b"], r["c"])
            near = sorted((dist(x, v), j) for j, v in own.items() if j != r["k"])[:5]
            assert any(abs(dist(x, new) + dist(new, own[j]) - d) < 1e-9 for d, j in near)
    assert sorted(map(str, out)) == sorted(map(str, V.oversampled(df.repartition(7), ["a", "b", "c"], ["k"], p=V.SmoteParams(cell=20)).collect()))


def test_even_one_class_and_empty(spark):
    df = spark.createDataFrame([(1, 0.0, 0), (2, 1.0, 1), (3, 2.0, 0)], "k int, a double, target int")
    assert V.oversampled(df.filter("k < 3"), ["a"], ["k"]).count() == 2
    assert V.oversampled(df.filter("target = 0"), ["a"], ["k"]).count() == 2
    assert V.oversampled(df.filter("false"), ["a"], ["k"]).count() == 0
    assert V.oversampled(df, ["a"], ["k"]).filter("synthetic").select("a").first()[0] == 1.0  # no neighbour: repeated
    assert V.neighbours(df.filter("false").select(F.col("k").cast("string").alias("id"), F.array("a").alias("v"))).count() == 0
