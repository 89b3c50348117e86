import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from barloom.llm import simhash as S
from barloom.llm.components import connected


def plain(text):
    words = (text or "").encode().lower().split()
    grams = [words[i : i + 3] for i in range(len(words) - 2)] or ([words] if words else [])
    hs = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(pairs):
    """pairs: id, fingerprint. The least id reachable through at most 2 differing bits."""
    fps = sorted({f for _, f in pairs})
    root = {f: f for f in fps}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    x = np.array(fps, np.uint64)
    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(x[:i] ^ x[i]) <= 2):
            root[top(f)] = top(fps[j])
    least = {}
    for d, f in pairs:
        t = top(f)
        least[t] = min([v for v in (least.get(t), d) if v is not None], default=None)
    return sorted(((d, f"{f:016x}", least[top(f)]) for d, f in pairs), key=str)


def got(df, p=S.Params()):
    out = S.groups(df, p).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id")
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_fingerprints_use_sparks_hash(spark):
    assert [r[0] & (1 << 64) - 1 for r in spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t")).collect()] == [xxhash.xxh64_intdigest(b"a b c", 42)]


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got(df) == components([(r["doc_id"], plain(r["text"])) for r in df.collect()])


def test_odd_tables(odd, empty, odd_rows):
    want = components([(r[0], plain(r[1])) for r in odd_rows])
    assert got(odd) == want
    assert got(odd, S.Params(bucket=1)) == want
    assert got(odd, S.Params(parts=(2,))) == want
    assert got(empty) == []


def test_links_lose_no_pair(spark):
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:60]:
        fps |= {f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(40)}
    df = spark.createDataFrame([(S.signed(f),) for f in fps], "fp long")
    pairs = [(i, f) for i, f in enumerate(fps)]
    for p in (S.Params(), S.Params(bucket=4), S.Params(parts=(2,)), S.Params(parts=(4,))):
        roots = {r["node"]: r["root"] for r in connected(S.links(df, len(fps), p)).collect()}
        groups = {}
        for i, f in pairs:
            groups.setdefault(roots.get(S.signed(f), S.signed(f)), []).append(i)
        want = {}
        for i, _, least in components(pairs):
            want.setdefault(least, []).append(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_plan_covers_the_threshold():
    rng = np.random.default_rng(0)
    for n in (10, 10_000, 10**9):
        chosen = S.plan(rng.integers(0, 1 << 63, 200).astype(np.uint64), n, S.Params())
        m = {2: 2, 3: 3, 4: 4}
        assert any(sum(t for _, t in chosen) - (k - len(chosen)) == 2 - k + 1 for k in m)


def test_chain_and_star_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)], "u long, v long")
    got = {r["node"]: r["root"] for r in connected(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1300)}}
