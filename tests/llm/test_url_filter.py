import hashlib

from pyspark.sql import functions as F

from barloom.llm import url_filter as U

URLS = [
    None, "", "no scheme", "http://A.Example.COM/en/75?x=1#y", "https://example.net/de/81", "https://x.example.net/de/1", "ftp://example.org/es/",
    "http://org/es/a", "http://notcom/en/", "http://com/en/", "http://a.com", "http://a.com?x://b.net/de/", "http://a.com#/en/", "x://y://z/de/", "http:///en/", "HTTP://ÀÉ.net/de/8",
    "http://spam-farm.b.org/q", "http://www.spam-farm.b.org/es/1", "http://spam-farmer.b.org/q", "line\nbreak://cheap-pills.x/\n/en?",
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))]
    fits = [(len(h + p), h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    listed = host + path != "" and (any(label in U.SITES for label in host.split(".")) or hashlib.md5((host + path).encode()).hexdigest()[0] == "0")
    best = max(fits, default=(0, None, "block" if listed else "allow"))
    return host, path, best[1], best[2]


def test_rules_and_listed_addresses(spark):
    urls = URLS + [f"https://www.example.edu/{i}" for i in range(100)] + ["https://long.example.edu/" + "x" * 200_000] + URLS[:8]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1)).withColumn("key", F.lit(1))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge(df).collect()}
    assert got == {i: brute(u) for i, u in enumerate(urls)}


def test_cascade_is_exact_over_the_universe(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("host"), "id").alias("key"))
    listed = universe.filter(F.substring("key", -1, 1) == "7")
    for p in (U.Params(bits=4, hashes=2), U.Params(), U.Params(shard_bits=1024), U.Params(shard_bits=1024, pass_bits=4096)):
        c = U.Cascade.build(universe, listed, p)
        got = c.member(universe.union(universe.limit(10)), "key", "hit")
        assert got.filter(F.col("hit") != (F.substring("key", -1, 1) == "7")).count() == 0
        assert got.count() == 20_010
        assert (c.shards > 1) == (p.shard_bits == 1024) and (c.passes > 1) == (p.pass_bits == 4096)


def test_many_listed_keys_in_several_shards_without_a_join(spark):
    universe = spark.range(100_000).select(F.col("id").cast("string").alias("key"))
    c = U.Cascade.build(universe, universe.filter("key % 5 <> 0"), U.Params(shard_bits=1 << 16))
    got = c.member(universe, "key", "hit")
    assert c.shards > 10 and got.filter("hit <> (key % 5 <> 0)").count() == 0
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_plan_has_no_python_and_no_join(spark, small):
    plan = U.judge(spark.read.parquet(f"{small}/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan


def test_empty(spark):
    assert U.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_generated_code_is_short_enough_to_be_compiled(spark):
    universe = spark.range(20_000).select(F.col("id").cast("string").alias("key"))
    c = U.Cascade.build(universe, universe.filter("key % 2 = 0"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = c.member(universe, "key", "hit")
        plan = got._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    stats = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenStringSeq(plan)
    sizes = [stats.apply(i)._3().maxMethodCodeSize() for i in range(stats.length())]
    assert sizes and max(sizes) < 8000


def test_columns_of_any_name_stay_and_null_ids_and_repeated_rows_are_judged(spark):
    rows = [(i, f"key {i}", "a", "b") for i in range(300)] * 2 + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, key string, _h1 string, _h2 string")
    c = U.Cascade.build(df.select("key"), df.select("key").filter("key like '%7'"), U.Params(shard_bits=128, pass_bits=256))
    got = c.member(df, "key", "hit")
    assert c.passes > 1 and got.columns == [*df.columns, "hit"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((*r, r[1] is not None and r[1].endswith("7")) for r in rows), key=str)
