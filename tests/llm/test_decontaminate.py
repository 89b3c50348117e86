import random
import re

import numpy as np

from barloom.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, bench, window=10):
    found = {}
    for item, text in bench:
        w = words(text)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            found.setdefault(tuple(w[i : i + window]), set()).add("" if item is None else str(item))
    sizes, out = {len(k) for k in found}, []
    for d, text in docs:
        w, hit, items = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in found:
                    hit.update(range(i, i + n))
                    items |= found[k]
        out.append((d, len(w), len(hit), ",".join(sorted(items))))
    return sorted(out, key=str)


def got(docs, bench, p=D.Params()):
    rows = D.search(docs, bench, ["doc_id"], p).collect()
    return sorted(((r["_c0"], r["n_words"], r["n_hit"], ",".join(r["items"])) for r in rows), key=str)


def pairs(df, a):
    return [(r[0], r[1]) for r in df.select(a, "text").collect()]


def test_whole_table(spark, small):
    docs, bench = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute(pairs(docs, "doc_id"), pairs(bench, "item_id"))
    assert sum(r[2] for r in want)
    assert got(docs, bench) == want
    assert got(docs, bench, D.Params(shard_words=50, sample=3, block_words=100, piece_words=15, windows=7)) == want


def test_odd_tables(spark, odd, empty, odd_rows, bench_text):
    bench = spark.createDataFrame([("b", bench_text), ("a", bench_text), ("s", "the Le"), ("one", "X"), (None, "naïve it's"), ("e", ""), ("n", None), ("s", "the Le"), ("z", "alpha beta gamma delta")], "item_id string, text string")
    want = brute([(r[0], r[1]) for r in odd_rows], pairs(bench, "item_id"))
    assert got(odd, bench) == want
    assert got(empty, bench) == []
    assert all(r[2] == 0 for r in got(odd, bench.limit(0)))


def test_cut_removes_the_spans(spark):
    docs = spark.createDataFrame([(1, "Keep this. alpha, BETA\ngamma delta! And this é"), (2, "alpha beta gamma delta"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "alpha beta gamma delta")], "item_id long, text string")
    rows = {r["_c0"]: r["_text"] for r in D.search(docs, bench, ["doc_id"], cut=True).collect()}
    assert rows == {1: "Keep this. ! And this é", 2: "", 3: ""}


def test_index_counts_and_locates():
    rng = random.Random(4)
    x = np.array([rng.choice([1, 1, 2, 3, 0]) for _ in range(3000)] + [1, 2] * 200 + [0], np.int32)
    index = D.FMIndex(x, 7)
    phrases = [[rng.choice([1, 2, 3]) for _ in range(rng.randrange(1, 6))] for _ in range(60)] + [[9], [1, 2] * 4]
    sizes = np.array([len(f) for f in phrases])
    lo, hi = index.search(np.array(sum(phrases, []), np.int32), np.cumsum(sizes) - sizes, sizes)
    for f, a, b in zip(phrases, lo, hi):
        want = [i for i in range(len(x)) if list(x[i : i + len(f)]) == f]
        assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


def test_words_that_the_benchmark_does_not_know_are_not_kept():
    block = D.Block.build([("a", np.arange(1, 40, dtype=np.uint64))], D.Params())
    shard = D.Shard(D.Params(), [], [], [], [])
    rng = np.random.default_rng(1)
    for k in range(50):
        number = np.where(rng.random(100_000) < 0.5, rng.integers(1, 40, 100_000), 0).astype(np.int32)
        number[5000:5012] = np.arange(3, 15)
        number[4999] = number[5012] = 0
        shard.add(number, np.array([0, 5000, 100_000]), 2 * k, 10)
    assert shard.words < 50 * 100_000 / 50
    found = list(shard.hits(block))
    assert [x[0] for x in found] == [2 * k + 1 for k in range(50)] and all(x[1:] == ([0, 12], ["a"]) for x in found)


def test_a_large_benchmark_in_several_blocks(spark):
    """50 MB of benchmark: 200,000 items, 8 million words, in two blocks and more."""
    from pyspark.sql import functions as F

    words = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(50_000)).cast("string")))
    items = spark.range(200_000).select(F.col("id").alias("item_id"), F.array_join(words, " ").alias("text"))
    some = items.filter("item_id % 1000 = 7").select(F.col("item_id").alias("doc_id"), F.concat(F.lit("own words here: "), "text", F.lit(" and an end")).alias("text"))
    rest = items.filter("item_id % 1000 = 8").select(F.col("item_id").alias("doc_id"), F.reverse("text").alias("text"))
    out = {r["_c0"]: (r["n_words"], r["n_hit"], r["items"]) for r in D.search(some.union(rest), items, ["doc_id"]).collect()}
    assert len(out) == 400
    assert all(v == (46, 40, [str(d)]) if d % 1000 == 7 else v[1] == 0 for d, v in out.items())
