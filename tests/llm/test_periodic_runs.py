import hashlib
import random
import re
import zlib

import numpy as np

from barloom.llm import periodic_runs as R
from barloom.llm import queries as Q
from barloom.llm.base import Texts


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(w, times=4, least=6):
    """(start, length, period) of every run, period by period."""
    names = {x: i for i, x in enumerate(dict.fromkeys(w))}
    v, out = np.array([names[x] for x in w], int), []
    for q in range(1, len(w) // times + 1):
        same = np.r_[False, v[:-q] == v[q:], False]
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2], edges[1::2]):
            n = b - a + q
            smaller = (r for r in range(1, q) if (v[a : a + n - r] == v[a + r : a + n]).all())
            if n >= max(least, times * q) and next(smaller, None) is None:
                out.append((int(a), int(n), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def without(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def made(rng):
    w = [rng.choice("abcdefghij"[: rng.randrange(2, 11)]) for _ in range(rng.randrange(0, 100))]
    for _ in range(rng.randrange(3)):
        unit, at = [rng.choice("abcxyz") for _ in range(rng.randrange(1, 9))], rng.randrange(0, len(w) + 1)
        w[at:at] = (unit * rng.randrange(2, 9))[rng.randrange(len(unit)) :]
    return w


def test_chunks_against_brute_force():
    rng = random.Random(3)
    for times, least in ((4, 6), (2, 1), (3, 9)):
        for _ in range(60):
            docs = [made(rng) for _ in range(rng.randrange(1, 8))]
            t = Texts.of([("\n\t" if rng.random() < 0.2 else " ").join(w) + "  " * rng.randrange(2) for w in docs])
            text, *run, spans = R.runs_of(t, R.Params(times, least))
            got = [[] for _ in docs]
            for d, *r in zip(text, *run):
                got[d].append(tuple(int(x) for x in r))
            want = [brute(w, times, least) for w in docs]
            assert got == want
            assert R.collapsed(t, spans, text, *run).to_pylist() == [without(w, r) for w, r in zip(docs, want)]


def test_only_smaller_halves_are_looked_at():
    """A text of n words of period 3 takes levels in proportion to n, with a few positions each, not n positions each."""
    t = Texts.of([" ".join("abc"[i % 3] for i in range(3000))])
    _, _, words_ = t.spans()
    r = R.Refinement(np.array([*(i % 3 for i in range(3000)), 9], np.uint64), np.full(3001, 750, np.int32))
    looked = 0
    while len(r.small):
        looked += len(r.small)
        r.step()
        r.level += 1
    assert r.level > 700 and looked < 3000 + 3 * 750


def test_odd_rows(spark, odd, odd_rows):
    long = "x y " * 50_000
    more = spark.createDataFrame([(500, long), (500, long), (501, " ".join(str(i) for i in range(50_000)))], "doc_id long, text string")
    for df, rows in ((odd, [(r[0], r[1]) for r in odd_rows]), (more, [(500, long), (500, long), (501, " ".join(map(str, range(50_000))))])):
        found = R.find(df, ["doc_id"], R.Params(chunk=5000)).collect()
        got = sorted(((r["_c0"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found), key=str)
        want = []
        for d, text in rows:
            w = words(text)
            runs = [(0, len(w), 2)] if text == long else [] if len(w) > 30_000 else brute(w)
            want.append((d, len(w), runs, without(w, runs)))
        assert got == sorted(want, key=str)


def test_empty_table(spark, empty):
    assert R.find(empty, ["doc_id"]).count() == 0


def test_longest(spark):
    rows = [([(5, 8, 2), (1, 8, 2), (1, 8, 1)],), ([(0, 6, 1), (9, 12, 3)],), ([],), (None,)]
    df = spark.createDataFrame(rows, f"runs {R.RUNS}")
    assert [r[0] and tuple(r[0]) for r in df.select(R.longest(df["runs"])).collect()] == [(1, 8, 1), (9, 12, 3), None, None]


def planted(doc_id, text):
    w, h = words(text), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not w:
        return w
    n, g = len(w), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_query(spark, small):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    out = {r["doc_id"]: r for r in Q.op12_periodic_runs(spark, small).collect()}
    assert out.keys() == docs.keys() and sum(r["n_runs"] > 0 for r in out.values()) >= 10
    for d, r in out.items():
        w = planted(d, docs[d])
        runs = brute(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(without(w, runs).encode()).hexdigest()


def test_planting_of_odd_rows(spark, odd, odd_rows):
    got = sorted(((r["doc_id"], words(r["text"])) for r in Q.planted(odd).collect()), key=str)
    assert got == sorted(((r[0], planted(r[0], r[1])) for r in odd_rows), key=str)
