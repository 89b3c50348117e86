"""URL filters, with SQL functions only: rules on host and path, and a Bloom filter cascade for listed keys.

The cascade's first filter encodes the listed keys, the second those keys of the universe that pass the first without
being listed, the third the listed keys that pass the second, and so on until no key is left. For every key of the universe the first filter that
it fails tells whether it is listed, without a join of rows and keys and without error. Keys are dealt by their hash to shards, each with filters of its own of about
`shard_bits`; the filters of a level are arrays of 64-bit words, read as a scalar subquery of at most `pass_bits`. A list that needs more is judged in several passes, each over the
rows of its own shards, whose results are written before the next pass begins. Keys are told apart by 128 bits of hashes.

Keys are addresses, host and path. Null URLs and URLs without `://` have an empty host and path, fit no rule, and have the empty key, which is never
listed. Of rules of equal length that fit, the one that stands last wins. Repeated rows are each judged; very long URLs are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import park, park_all, unpark

UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: host, path, verdict. A rule fits its host and all subdomains, on paths that start with its own; the longest wins.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Site names whose hosts' addresses the query lists.
SITES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOW)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; nulls if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


@dataclass(frozen=True)
class Params:
    """bits: of a filter for each key that it encodes; later filters of few keys take up to most_bits. hashes. shard_bits: of a shard's first filter, about. pass_bits: of the first filters that one pass
    over the rows reads, a bound on what the driver and a plan carry. most_levels: a guard that the halving of levels never meets."""

    bits: int = 10
    most_bits: int = 64
    hashes: int = 3
    shard_bits: int = 1 << 20
    pass_bits: int = 1 << 26
    most_levels: int = 60


def hashes_of(key: Column) -> dict[str, Column]:
    """128 bits that stand for a key from here on."""
    return {"_h1": F.xxhash64(key), "_h2": F.xxhash64(F.lit(1), key)}


def fresh(df: DataFrame, name: str) -> str:
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def mask(h2: Column, level: int, p: Params) -> Column:
    """The bits of a key in its word: three times six bits of its second hash, others for each level."""
    begin = 11 * level % (64 - 6 * p.hashes)
    return reduce(Column.bitwiseOR, (F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h2, begin + 6 * k).bitwiseAND(F.lit(63).cast("long")).cast("int")) for k in range(p.hashes)))


def word(h1: Column, level: int, words: int) -> Column:
    return F.pmod(F.xxhash64(h1, F.lit(level)), F.lit(words)).cast("int")


@dataclass
class Cascade:
    """levels: for each, its filters (pass, cells; a row for each pass) and the words of a shard's filter."""

    shards: int
    per_pass: int
    p: Params
    levels: list[tuple[DataFrame, int]] = field(default_factory=list)

    @classmethod
    def build(cls, universe: DataFrame, listed: DataFrame, p: Params = Params()) -> Cascade:
        """universe, listed: tables with one string column, key. Keys are distinct after this; nulls are left out."""
        flagged = [df.filter("key is not null").select(*[c.alias(n) for n, c in hashes_of(F.col("key")).items()], F.lit(inside).alias("_in")) for df, inside in ((listed, True), (universe, False))]
        keys = park(flagged[0].union(flagged[1]).groupBy("_h1", "_h2").agg(F.max("_in").alias("_in")), ["_in"])
        encode, against = (keys.filter(F.col("_in") == inside).drop("_in") for inside in (True, False))
        shards = max(1, -(-encode.count() * p.bits // p.shard_bits))
        out = cls(shards, max(1, p.pass_bits // p.shard_bits), p)
        for level in range(p.most_levels):
            most = encode.groupBy(out.shard(F.col("_h2"))).count().agg(F.max("count")).first()[0]
            if not most:
                return out
            # a level of few keys may take a quarter of the first filter's bits, which ends the cascade sooner
            bits = max(p.bits, min(p.most_bits, out.levels[0][1] * 16 // most)) if level else p.bits
            words = max(4, -(-most * bits // 64))
            out.levels.append((park(out.filters_of(encode, level, words)), words))
            rest = out.each_pass(against, "_h2", lambda df, turn, level=level: df.filter(out.hit(F.col("_h1"), F.col("_h2"), level, turn)))
            encode, against = (rest if out.passes > 1 else park(rest)), encode
        raise RuntimeError(f"the cascade did not end in {p.most_levels} levels")

    @property
    def passes(self) -> int:
        return -(-self.shards // self.per_pass)

    def shard(self, h2: Column) -> Column:
        return F.pmod(h2, F.lit(self.shards)).cast("int")

    def each_pass(self, df: DataFrame, h2: str, step: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
        """step(rows, pass) for the rows of each pass. Several passes each read their own rows only, and are written one after the other,
        so that never more than one pass's filters are held."""
        if self.passes == 1:
            return step(df, 0)
        turn = fresh(df, "_pass")
        dealt = park(df.withColumn(turn, F.floor(self.shard(F.col(h2)) / self.per_pass).cast("int")), [turn])
        done = park_all(step(dealt.filter(F.col(turn) == t).drop(turn), t) for t in range(self.passes))
        unpark(dealt)
        return done

    def filters_of(self, keys: DataFrame, level: int, words: int) -> DataFrame:
        """pass, cells: the filters of its shards, one after the other."""
        bits = keys.select(self.shard(F.col("_h2")).alias("shard"), word(F.col("_h1"), level, words).alias("word"), mask(F.col("_h2"), level, self.p).alias("bits"))
        per = bits.groupBy("shard", "word").agg(F.bit_or("bits").alias("bits"))
        every = keys.sparkSession.range(self.shards * words).select((F.col("id") / words).cast("int").alias("shard"), (F.col("id") % words).alias("word"))
        cells = F.transform(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))), lambda r: r["bits"])
        rows = every.join(per, ["shard", "word"], "left").groupBy("shard").agg(cells.alias("cells"))  # about shard_bits / 64
        row = F.array_sort(F.collect_list(F.struct("shard", "cells")))  # at most per_pass
        return rows.groupBy(F.floor(F.col("shard") / self.per_pass).alias("pass")).agg(F.flatten(F.transform(row, lambda r: r["cells"])).alias("cells"))

    def hit(self, h1: Column, h2: Column, level: int, turn: int) -> Column:
        """Whether the level's filter of the key's shard, one of pass `turn`, has all the key's bits.

        A key's bits stand in one word, which keeps the generated code short: with a test for each bit, all levels' tests made one method
        that is too long for the JVM to compile (8,000 bytes) and ran interpreted.
        """
        filters, words = self.levels[level]
        cells = filters.filter(F.col("pass") == turn).select("cells").scalar()
        found = F.get(cells, (self.shard(h2) - turn * self.per_pass) * words + word(h1, level, words))
        return F.bitwise_not(found).bitwiseAND(mask(h2, level, self.p)) == 0

    def member(self, df: DataFrame, key: str, out: str) -> DataFrame:
        """Adds `out`: whether the key is listed. Exact for all keys of the universe."""
        if not self.levels:
            return df.withColumn(out, F.lit(False))
        h1, h2 = fresh(df, "_h1"), fresh(df, "_h2")

        def judged(rows: DataFrame, turn: int) -> DataFrame:
            v = F.lit(len(self.levels) % 2 == 1)
            for level in reversed(range(len(self.levels))):
                v = F.when(~self.hit(F.col(h1), F.col(h2), level, turn), F.lit(level % 2 == 1)).otherwise(v)
            return rows.withColumn(out, F.coalesce(v, F.lit(False)) & F.col(key).isNotNull())

        hashed = df.withColumns(dict(zip((h1, h2), hashes_of(F.col(key)).values())))
        return self.each_pass(hashed, h2, judged).drop(h1, h2)


def listed_addresses(universe: DataFrame) -> DataFrame:
    """The query's list, as no table of listed keys is at hand: the addresses of hosts with one of SITES in their names, and every address whose MD5 starts with
    a zero, a sixteenth of all, for a list that nothing about a key gives away."""
    name = F.arrays_overlap(F.split(F.substring_index("key", "/", 1), r"\."), F.array(*map(F.lit, SITES)))
    return universe.filter((F.col("key") != "") & (name | F.md5("key").startswith("0")))


def judge(pages: DataFrame, listed: DataFrame | None = None, rules=RULES, p: Params = Params(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, listed, verdict for each row. listed: a table of addresses, key; by default `listed_addresses`."""
    url = pages[url_col].cast("string")
    rows = pages.select(pages[id_col].alias("_id"), host(url).alias("host"), path(url).alias("path"))
    text, verdict = rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("_id", "host", "path", F.concat("host", "path").alias("_key"), text.alias("rule"), verdict.alias("_verdict"))
    universe = rows.select(F.col("_key").alias("key"))
    listed = listed_addresses(universe) if listed is None else listed.filter("key <> ''")
    out = Cascade.build(universe, listed, p).member(rows, "_key", "listed")
    verdict = F.coalesce("_verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule", "listed", verdict.alias("verdict"))
