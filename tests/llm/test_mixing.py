import hashlib
import re

from pyspark.sql import functions as F

from barloom.llm import mixing as M


def digest(i, text):
    return hashlib.md5(f"{'' if i is None else i} {hashlib.md5(text.encode()).hexdigest()}".encode()).hexdigest()


def brute(rows, weights=(5.0, 2.0, 1.0), cap=3):
    """rows: id, source, size, text. Targets by sharing out again and again, words by walking through the shuffle."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(r[2] for r in rows if r[1] == s) for s in sources}
    w = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    full, total = set(), sum(size.values())
    while True:
        left, free = total - sum(cap * size[s] for s in full), [s for s in sources if s not in full]
        target = {s: cap * size[s] if s in full else left * w[s] / sum(w[x] for x in free) for s in sources}
        over = {s for s in free if target[s] > cap * size[s]}
        if not over:
            break
        full |= over
    out = []
    for s in sources:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (digest(r[0], r[3]), r[0] is not None, r[0], r[2]))
        at, want = 0, round(target[s])
        for i, _, n, _ in own:
            t = want // size[s] * n + min(max(want % size[s] - at, 0), n) if size[s] else 0
            out.append((i, n, size[s], target[s], t))
            at += n
    return out


def norm(rows):
    return sorted((str(r[0]), r[1], r[2], round(r[3], 4), r[4]) for r in rows)


def sizes(df):
    return [(r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")), r["text"] or "") for r in df.select("doc_id", "source", "text").collect()]


def got(df, p):
    return [tuple(r) for r in M.mix(df, p).select("doc_id", "size", "source_size", "target", "taken").collect()]


def test_equals_brute_force(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    want = brute(sizes(df))
    for p in (M.Params(), M.Params(block_words=7, rows_per_bucket=3, slots_per_bucket=11)):
        assert norm(got(df, p)) == norm(want)


def test_odd_tables(odd, empty):
    want = norm(brute(sizes(odd)))
    assert [r for r in norm(got(odd, M.Params(block_words=16))) if r[0] != "9"] == [r for r in want if r[0] != "9"]
    assert got(empty, M.Params()) == []
    blank = odd.withColumn("text", F.lit(" "))
    assert {r[4] for r in got(blank, M.Params())} == {0}


def test_schedule_is_spread(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet").withColumn("source", F.col("source").cast("string"))
    p = M.Params(block_words=64)
    per = M.targets(M.word_counts(df, ["source"]), p)
    slots = M.schedule(spark, per, p).toPandas().sort_values("slot")
    words, target = slots.groupby("source").words.sum(), per.toPandas().set_index("source").target
    assert (words - target).abs().max() <= 1
    assert not slots.duplicated(["source", "rank"]).any() and not slots.duplicated("slot").any()
    half = slots.head(len(slots) // 2).groupby("source").words.sum()
    assert (half / half.sum() - target / target.sum()).abs().max() < 0.02


def test_rows_without_ids_are_spread_over_buckets(spark):
    rows = [(None if i % 10 else i, f"text number {i} has words", "a") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    p = M.Params(block_words=16, rows_per_bucket=8)
    assert norm(got(df, p)) == norm(brute(sizes(df)))
    digests = df.select(M.digest(F.col("doc_id"), F.col("text")).alias("d"))
    assert digests.groupBy(F.substring("d", 1, 2)).count().agg(F.max("count")).first()[0] < 3000 / 64
