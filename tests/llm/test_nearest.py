import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import nearest as N
from barloom.llm import queries as Q

SCHEMA = "vec_id long, embedding array<float>, id string, _id int, _row string, cell string, score double"


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)


def brute(rows, is_query, k=5):
    """Every row's cosine, added up in order."""
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows if usable(v)]
    out = []
    for a, (i, u) in enumerate(rows):
        if i is None or not is_query(i):
            continue
        found = []
        for b, (j, v) in enumerate(rows):
            if a != b and len(u) == len(v):
                dot = nu = nv = 0.0
                for x, y in zip(u, v):
                    dot, nu, nv = dot + x * y, nu + x * x, nv + y * y
                found.append((-max(-1.0, min(1.0, dot / math.sqrt(nu * nv))), j is None, j))
        found.sort(key=lambda f: (f[0], f[1], f[2] or 0))
        out += [(i, r + 1, j, -s) for r, (s, _, j) in enumerate(found[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    vec = lambda d=16: [rng.gauss(0, 1) for _ in range(d)]
    hot, near = vec(), vec()
    out = [(i, hot) for i in range(0, 120)]  # copies of one vector
    out += [(i, [x + rng.gauss(0, 1e-4) for x in near]) for i in range(120, 200)]  # closer than codes can tell
    out += [(i, vec()) for i in range(200, 300)]
    out += [(300, hot), (300, hot), (301, vec(3)), (350, vec(3)), (302, [2.0 * x for x in hot]), (303, [-x for x in hot])]
    out += [(None, vec()), (None, hot), (304, None), (350, []), (400, [0.0] * 16), (450, [None] + vec(15)), (500, [float("nan")] + vec(15)), (550, [float("inf")] + vec(15))]
    out += [(600, [1e-30 * x for x in near]), (650, [1e30 * x for x in near])]
    return out


def run(spark, rows, p):
    df = spark.createDataFrame([(i, v, "x", 1, "x", "x", 0.5) for i, v in rows], SCHEMA).repartition(5)
    out = N.search(df, F.col("_id") % 10 == 0, p)
    assert out.columns == ["query_id", "rank", "id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("p", [N.Params(), N.Params(queries=7, least=40, tile=(4, 16)), N.Params(k=9, candidates=50, tile=(3, 5))])
def test_against_brute_force(spark, rows, p):
    got, want = run(spark, rows, p), brute(rows, lambda i: i % 10 == 0, p.k)
    assert [x[:3] for x in got] == [x[:3] for x in want] or {(x[0], x[1]) for x in got} == {(x[0], x[1]) for x in want}
    at = lambda out: sorted((x[0], x[1], round(x[3], 12)) for x in out)
    assert at(got) == at(want)
    pairs = {(x[0], x[2]) for x in want}
    assert sum((x[0], x[2]) in pairs for x in got) >= 0.99 * len(got)  # equal to rounding only where 1e30 and 1e-30 were scaled


def test_exact_work_is_little():
    rng = np.random.default_rng(1)
    vecs = rng.normal(size=(4000, 64))
    cell = N.Cell(np.arange(50), list(range(50)), vecs[:50], N.Params())
    for at in range(0, 4000, 1000):
        cell.meet(np.arange(at, at + 1000), list(range(at, at + 1000)), vecs[at : at + 1000])
    assert cell.exact < 0.03 * 50 * 4000


def test_bound_holds():
    rng = np.random.default_rng(2)
    for d in (1, 3, 64, 2100):
        a, b = N.Block(rng.normal(size=(40, d)) ** 3), N.Block(rng.normal(size=(50, d)) ** 3)
        est = a.products(slice(None), b)
        i, j = (x.ravel() for x in np.indices(est.shape))
        off = np.abs(est.ravel() - a.cosines(i, b, j))
        assert (off <= a.rest[i] * (1 + b.rest[j]) + b.rest[j]).all()


def test_empty_and_few(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert N.search(empty, F.col("_id") % 10 == 0).count() == 0
    got = run(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0])], N.Params())
    assert [x[:3] for x in got] == [(0, 1, 1)]


def test_query(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    out = Q.op11_nearest_neighbours(spark, small)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows, lambda i: i % 50 == 0)
