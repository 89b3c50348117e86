import hashlib

import numpy as np

from pyspark.sql import functions as F

from barloom.llm import line_dedup as L

LAST = 1 << 63


def key(line):
    k = line.strip(" \t\n\r\x0b\x0c")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)


def brute(rows):
    holders = {}
    for d, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(LAST if d is None else d)
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if not (len(key(x)) >= 10 and len(h := holders[key(x)]) > 1 and min(h) != (LAST if d is None else d))]
        out.append((d, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df, index):
    rows = L.dedup(df, index, ["doc_id"]).select("_c0", "_lines", "_dropped", "_text").collect()
    return sorted(((r[0], r[1], r[2], hashlib.sha256(r[3].encode()).hexdigest()) for r in rows), key=str)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_whole_table(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    want = brute(rows_of(df))
    assert sum(r[2] for r in want)
    assert got(df, L.LineIndex.build(df)) == want


def test_many_shards_and_odd_tables(odd, empty):
    want = brute(rows_of(odd))
    assert got(odd, L.LineIndex.build(odd)) == want
    assert got(odd, L.LineIndex.build(odd, L.Params(shard_keys=20, probe_rows=5))) == want
    assert got(empty, L.LineIndex.build(empty)) == []


def test_insertions_and_deletions_are_reversible(spark, odd):
    docs = odd.select("doc_id", "text").filter("doc_id is not null")
    first, second = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    p = L.Params(shard_keys=64)
    alone = L.LineIndex.build(first, p)
    both = alone.insert(second)
    assert got(docs, both) == brute(rows_of(docs))
    back = both.delete(second.select("doc_id"))
    assert got(first, back) == brute(rows_of(first))
    tally = lambda x: {r["shard"]: r["n"] for r in x.filters.collect() if r["n"]}
    assert tally(back) == tally(alone)
    assert sum(r["n"] for r in both.filters.collect()) == L.repeated(both.references()).count()


def test_an_insertion_far_larger_than_the_index(spark):
    few = [(i, f"the very first line of text {i}\nanother shared line") for i in range(3)]
    many = [(10 + i, "\n".join(f"a shared line of text, number {j}" for j in range(400))) for i in range(8)]
    schema = "doc_id long, text string"
    for p in (L.Params(), L.Params(shard_keys=256, probe_rows=100)):  # the one filter grows, then shards are dealt anew
        index = L.LineIndex.build(spark.createDataFrame(few, schema), p)
        grown = index.insert(spark.createDataFrame(many, schema))
        assert got(spark.createDataFrame(few + many, schema), grown) == brute(few + many)
        back = grown.delete(spark.createDataFrame([(d,) for d, _ in many], "d long"))
        assert got(spark.createDataFrame(few, schema), back) == brute(few)


def test_a_line_of_every_document_is_probed_in_many_groups(spark):
    rows = [(i, f"this line stands in every document\nown line of document {i}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = L.LineIndex.build(df, L.Params(shard_keys=1000, probe_rows=500))
    most = index.references().groupBy("shard").count().agg({"count": "max"}).first()[0]
    assert most > 4000 and got(df, index) == brute(rows)


def test_a_frequent_line_beyond_the_broadcast_bound_meets_in_no_single_task(spark):
    rows = [(i, ("this line stands in nearly every document\n" if i % 10 else "") + f"a line of two documents, {i // 2}\nown line of document {i}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = L.LineIndex.build(df, L.Params(few=64, probe_rows=500))
    assert got(df, index) == brute(rows)
    found = index.firsts(index.references().select("k1", "k2", "doc"))
    top = found.groupBy("k1", "k2").count().orderBy(F.desc("count")).first()
    assert top["count"] == 5400
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = [r["count"] for r in found.filter((F.col("k1") == top["k1"]) & (F.col("k2") == top["k2"])).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(tasks) == 5400 and max(tasks) < 5400 / 2


def test_repeated_ids_deltas_and_string_ids(spark):
    rows = [(f"d{i // 2}", f"a line that two rows of document {i // 2} hold\nline of every document\nline number {i % 7} of seven") for i in range(40)]
    schema = "doc_id string, text string"
    index = L.LineIndex.build(spark.createDataFrame(rows[:30], schema), L.Params(most_parts=2))
    for at in range(30, 40, 2):
        index = index.insert(spark.createDataFrame(rows[at : at + 2], schema))
        assert len(index.parts) <= 2
    every = {}
    for d, t in rows:
        every.setdefault(d, []).append(t)
    keys = {}
    for d, ts in every.items():
        for t in ts:
            for x in t.split("\n"):
                keys.setdefault(x, set()).add(d)
    df = L.dedup(spark.createDataFrame(rows, schema), index, ["doc_id"]).select("_c0", "_text").collect()
    want = sorted((d, "\n".join(x for x in t.split("\n") if min(keys[x]) == d)) for d, t in rows)
    assert sorted((r[0], r[1]) for r in df) == want
    back = index.delete(spark.createDataFrame([("d19",), ("d0",)], "d string"))
    assert {r["doc"] for r in back.references().select("doc").distinct().collect()} == set(every) - {"d19", "d0"}


def test_cuckoo_filter():
    rng = np.random.default_rng(2)
    k1, k2, other = (rng.integers(-(1 << 62), 1 << 62, 50_000) for _ in range(3))
    f = L.CuckooFilter.sized(len(k1))
    assert f.insert(k1, k2) and f.contains(k1, k2).all()
    assert f.contains(other, k1).mean() < 0.001
    f.delete(k1[:40_000], k2[:40_000])
    assert f.contains(k1[40_000:], k2[40_000:]).all()
    assert f.contains(k1[:40_000], k2[:40_000]).mean() < 0.001
    assert not L.CuckooFilter.sized(10).insert(k1[:1000], k2[:1000])
