import hashlib
import math
import random

import numpy as np
import pytest

from barloom.llm import clustering as C
from barloom.llm import queries as Q

SCHEMA = "vec_id long, embedding array<float>, v string, rest string, cluster string, _id string"


def brute(rows, p=C.Params()):
    """id, cluster, distance, the cluster's and the whole inertia, centroid, in plain integers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == p.dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(p.scale * float(np.float32(x))) for x in v]))
    drawn = sorted(kept, key=lambda r: (hashlib.sha256(f"{p.seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], np.int32).tobytes()))
    cents = [v for _, v in drawn[: p.clusters]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(cents))

    for _ in range(p.rounds):
        of = [near(v)[1] for _, v in kept]
        for k in range(len(cents)):
            mine = [v for (_, v), o in zip(kept, of) if o == k]
            if mine:
                cents[k] = [sum(x) // len(mine) for x in zip(*mine)]
    ends = [(i, *near(v)) for i, v in kept]
    total = [sum(d for _, d, k in ends if k == c) for c in range(len(cents))]
    return sorted(((i, k, d, total[k], sum(total), cents[k]) for i, d, k in ends), key=str)


def run(spark, rows, p):
    df = spark.createDataFrame([(i, v, "x", "x", "x", "x") for i, v in rows], SCHEMA).repartition(4)
    return sorted(((*r[:5], r[5]) for r in (tuple(x) for x in C.cluster(df, p).collect())), key=str)


@pytest.mark.parametrize("p", [C.Params(clusters=5, rounds=3, dim=10, segment=4), C.Params(clusters=40, rounds=2, dim=10, segment=8), C.Params(clusters=3, rounds=0, dim=10, segment=1)])
def test_against_brute_force(spark, p):
    rng = random.Random(4)
    vec = lambda: [rng.gauss(0, 1) for _ in range(10)]
    hot = vec()
    rows = [(i, hot) for i in range(60)] + [(i, vec()) for i in range(60, 160)] + [(7, vec()), (7, hot), (None, vec()), (None, vec())]
    rows += [(200, None), (201, vec()[:9]), (202, []), (203, [None] + vec()[:9]), (204, [float("nan")] + vec()[:9]), (205, [float("-inf")] + vec()[:9]), (206, [0.0] * 10), (207, [-0.001] * 10), (208, [1000.0] * 10)]
    assert run(spark, rows, p) == brute(rows, p)


def test_few_and_empty(spark):
    p = C.Params(clusters=5, rounds=2, dim=2)
    rows = [(1, [0.5, 1.0]), (2, [0.5, -1.0])]
    assert run(spark, rows, p) == brute(rows, p)
    assert run(spark, [(1, None)], p) == []
    assert C.cluster(spark.createDataFrame([], SCHEMA), p).count() == 0


def test_too_large_components_are_refused(spark):
    with pytest.raises(Exception, match="beyond 64 bits"):
        run(spark, [(1, [1e30, 0.0])], C.Params(clusters=1, dim=2))


def test_bounds_screen_and_lose_nothing():
    rng, p = np.random.default_rng(5), C.Params()
    cents = rng.integers(-3000, 3000, (40, 64)).tolist()
    v = (np.array(cents)[rng.integers(0, 40, 3000)] + rng.integers(-300, 300, (3000, 64))).astype(np.int32)
    best, least, exact = C.Nearest(cents, p)(v, *C.compressed(v, p.segment))
    full = ((v[:, None, :].astype(np.int64) - np.array(cents)) ** 2).sum(2)
    assert (best == full.argmin(1)).all() and (least == full.min(1)).all()
    assert exact < 0.2 * full.size


def test_query(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    want = [(*r[:5], hashlib.sha256(",".join(map(str, r[5])).encode()).hexdigest()) for r in brute(rows)]
    out = Q.op13_centroid_clustering(spark, small)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(want, key=str)
