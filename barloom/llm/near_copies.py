"""Near-copies by SimHash and counted shingles: every pair of texts with a similarity of `similarity` or more is linked.

The similarity of two texts is that of their sets of five-word shingles (Jaccard), words split at white space, A-Z lower-cased.

1. Fingerprints of 64 bits over the distinct shingles go through `simhash.links`: parts of correlated bits, thresholds planned by dynamic
   programming, buckets probed. That finds the closest copies, up to `tau` differing bits.
2. A similarity of 0.8 means some 15 % of differing bits, more than any plan of thresholds can probe, so the shingles themselves find the rest, with none lost (prefix
   filter): two sets that are similar enough both hold a common shingle among their first n - ceil(s n) + 1 in any one order of all shingles. The order
   here puts shingles last that a bounded sample finds frequent. The texts that share such a shingle first meet the least of them.
3. The pairs so far are verified by counting common shingles, and connected. Texts of different components that share a first shingle are
   paired, each pair once and only if its prefixes leave enough room, and verified.
4. Before a pair's shingles are counted, bitmaps of both texts are compared, in which each shingle turns one bit: two sets differ in no fewer shingles than their bitmaps in bits.
   A bitmap takes a thirtieth to a sixtieth of the set, and few pairs that aren't similar get past it, so the sets that go to disk follow the links, not the pairs, which grow faster than the texts.

So groups whose members are similar to their bucket's least are never paired; what is paired is what may be similar and isn't connected, as
single linkage asks. Only the hashes of shingles (52 bits in prefixes, 64 in counts) are a matter of probability.

Null and empty texts have no shingle and are copies of each other. Texts of fewer than five words are one shingle. Equal sets of shingles are one node, so exact copies, however many, are
never paired. Null ids come last; rows of equal id are told apart by their texts. Repeated rows get the same group. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .base import as_text, chunks, few, map_arrow, mix, park, Texts, tidy, unpark
from .components import connected

_STEP = [np.uint64(pow(0x9E3779B97F4A7C15, 2 * j + 1, 1 << 64)) for j in range(64)]
#: Texts of a chunk, at most, so that a text's number and 52 bits of a hash fit in 64.
TEXTS = 1 << 12
LOW = np.uint64((1 << 52) - 1)


@dataclass(frozen=True)
class Params:
    """similarity: least Jaccard similarity of a link. shingle: words. sample_texts, common: texts in which frequent shingles are looked for, and how many
    are put last, bounds. shown: first shared shingles that a text's rows carry to tell earlier meetings."""

    similarity: float = 0.8
    shingle: int = 5
    sample_texts: int = 10_000
    common: int = 1 << 17
    shown: int = 24
    fingerprint: simhash.Params = simhash.Params()


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def shingles(t: Texts, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, repeats included, and their number before each text."""
    low = t.lowered()
    starts, ends, off = low.spans()
    h, k = low.hashes(starts, ends), p.shingle
    n = np.diff(off)
    size = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_off = np.concatenate([[0], np.cumsum(size)])
    total = np.zeros(len(h), np.uint64)
    left = np.repeat(off[1:], n) - np.arange(len(h))  # words from here to the text's end
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    for j in range(k):
        total += np.where(left > j, padded[j : j + len(h)] * _STEP[j], np.uint64(0))
    at = np.repeat(off[:-1] - out_off[:-1], size) + np.arange(out_off[-1])
    return mix(total[at]), out_off


def distinct_shingles(t: Texts, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of distinct shingles in order within each text, the number of each one's text, and the number before each text."""
    h, off = shingles(t, p)
    owner = np.repeat(np.arange(t.n, dtype=np.uint64), np.diff(off))
    order = np.argsort((owner << np.uint64(52)) | (h & LOW), kind="stable")
    h, owner = h[order], owner[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] & LOW != h[:-1] & LOW) | (owner[1:] != owner[:-1])
    h, owner = h[fresh], owner[fresh].astype(np.int64)
    return h, owner, np.searchsorted(owner, np.arange(t.n + 1))


def nodes(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A number for each set of shingles."""
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
    return mix(total[off[1:]] - total[off[:-1]] + np.diff(off).astype(np.uint64)).view(np.int64)


def majority(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Fingerprints: each bit the majority of the text's hashes; 0 for no shingle."""
    n = np.diff(off)
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        count = np.zeros((len(some), 64), np.int64)
        for a in range(0, len(h), 1 << 18):  # bounds the unpacked bits of a long text
            b = min(a + (1 << 18), len(h))
            bits = np.unpackbits(h[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            first, last = np.searchsorted(off[some], a, "right") - 1, np.searchsorted(off[some], b, "left")
            cuts = np.maximum(off[some[first:last]] - a, 0)
            count[first:last] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * count > n[some, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out.view(np.int64)


def bitmaps(h: np.ndarray, owner: np.ndarray, off: np.ndarray) -> pa.Array:
    """For each text as many bits as the next power of two holds its shingles, 64 at least: the parity of the shingles that fall on each."""
    size = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(1, np.diff(off)))).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(size)])
    at = base[owner] + (h & (size[owner] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(at, minlength=base[-1]).astype(np.uint8) & 1
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((base // 8).astype(np.int32)), pa.py_buffer(np.packbits(odd, bitorder="little"))])


def differing(a: Texts, b: Texts) -> np.ndarray:
    """Bits in which the bitmaps of each pair differ, the longer one folded to the shorter one's length: no more than the sets' differing shingles."""
    la, lb = np.diff(a.off), np.diff(b.off)
    out = np.zeros(a.n, np.int64)
    for x, y in set(zip(la.tolist(), lb.tolist())):
        rows, least = np.flatnonzero((la == x) & (lb == y)), min(x, y)
        folded = [np.bitwise_xor.reduce(t.data[t.off[rows][:, None] + np.arange(z)].reshape(len(rows), z // least, least), axis=1) for t, z in ((a, x), (b, y))]
        out[rows] = np.bitwise_count(folded[0] ^ folded[1]).sum(1, dtype=np.int64)
    return out


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    for batch in batches:
        for a in range(0, batch.num_rows, TEXTS):
            yield from chunks(iter([batch.slice(a, TEXTS)]), "_text")


def lists(values: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values.view(np.int64)))


def frequent(rows: DataFrame, total: int, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """The hashes (52 bits, in order) most frequent in a bounded sample of texts, and their classes, from 1 to 15."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in pieces(batches):
            keys, n = np.unique(distinct_shingles(t, p)[0] & LOW, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["h", "n"])

    draw = F.pmod(F.hash("_key"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, p.sample_texts / max(1, total)))
    each = map_arrow(rows.filter(draw).select("_text"), run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = each.filter("n > 1").orderBy(F.desc("n"), "h").limit(p.common).toArrow()
    h, n = top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()
    order = np.argsort(h)
    return h[order], np.minimum(15, np.floor(np.log2(n[order])).astype(np.int64) + 1)


def sketches(rows: DataFrame, common: tuple[np.ndarray, np.ndarray], p: Params) -> DataFrame:
    """_id, _key, node, n, fp, bits, and pre (the first shingles, 52 bits each) with last (the class of the last of these) for each row."""
    held = rows.sparkSession.sparkContext.broadcast(common)  # bounded by `common`
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, level = held.value
        for batch, t in pieces(batches):
            h, owner, off = distinct_shingles(t, p)
            n, short = np.diff(off), h & LOW
            rank = np.zeros(len(h), np.int64)
            if len(often):
                at = np.minimum(np.searchsorted(often, short), len(often) - 1)
                rank = np.where(often[at] == short, level[at], 0)
            order = np.argsort((owner * 16 + rank).astype(np.uint16), kind="stable")  # within a class by hash
            most = np.where(n > 0, n - np.ceil(p.similarity * n - 1e-9).astype(np.int64) + 1, 0)
            pre_off = np.concatenate([[0], np.cumsum(most)])
            take = order[np.repeat(off[:-1] - pre_off[:-1], most) + np.arange(pre_off[-1])]
            last = np.zeros(t.n, np.int64)
            last[most > 0] = rank[take[pre_off[1:][most > 0] - 1]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_key"), pa.array(nodes(h, off)), pa.array(n), pa.array(majority(h, off)), bitmaps(h, owner, off), lists(short[take], pre_off), pa.array(last.astype(np.int32))],
                names=["_id", "_key", "node", "n", "fp", "bits", "pre", "last"],
            )

    return map_arrow(rows, run, f"_id {kind}, _key long, node long, n long, fp long, bits binary, pre array<long>, last int")


def possible(pairs: DataFrame, distinct: DataFrame, p: Params) -> DataFrame:
    """Those of the pairs (u, v) that may be similar by their sizes and bitmaps, every similar one among them."""
    a, b = (distinct.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"b{x}")) for x in "uv")
    both = pairs.join(a, "u").join(b, "v").filter(enough(F.least("nu", "nv"), "nu", "nv", p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in chunks(batches, "bu"):
            bits = differing(t, Texts.from_arrow(batch.column("bv")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("u", "v", "nu", "nv")), pa.array(bits)], names=["u", "v", "nu", "nv", "bits"])

    out = map_arrow(both, run, "u long, v long, nu long, nv long, bits long")
    return park(out.filter(enough((F.col("nu") + F.col("nv") - F.col("bits")) / 2, "nu", "nv", p)).select("u", "v"))


def verified(pairs: DataFrame, texts: DataFrame, keys: DataFrame, p: Params) -> DataFrame:
    """Those of the pairs (u, v) whose sets are similar, by counting. texts: _text, _key. keys: node and _key of one text for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in pieces(batches):
            h, _, off = distinct_shingles(t, p)
            yield pa.RecordBatch.from_arrays([pa.array(nodes(h, off)), pa.array(np.diff(off)), lists(h, off)], names=["node", "n", "h"])

    need = pairs.select(F.col("u").alias("_n")).union(pairs.select("v")).distinct()
    tidy(pairs.sparkSession)
    need = park(keys.join(need, F.col("node") == F.col("_n"), "left_semi").select(F.col("_key").alias("_k")).distinct())
    sets = map_arrow(texts.join(few(need), F.col("_key") == F.col("_k"), "left_semi").select("_text"), run, "node long, n long, h array<long>")
    sets = park(sets.groupBy("node").agg(F.first("n").alias("n"), F.first("h").alias("h")))
    unpark(need)
    a, b = (sets.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("h").alias(f"h{x}")) for x in "uv")
    both = F.size(F.array_intersect("hu", "hv"))
    out = park(pairs.join(a, "u").join(b, "v").filter(enough(both, "nu", "nv", p)).select("u", "v"))
    unpark(sets)
    return out


def enough(both: Column, na: str, nb: str, p: Params) -> Column:
    """Whether so many common shingles make two sets similar."""
    return both * (1 + p.similarity) >= p.similarity * (F.col(na) + F.col(nb)) - 1e-6


def shared(distinct: DataFrame, p: Params) -> DataFrame:
    """h, node, n, at (place in the prefix): first shingles that several sets have. One row for each."""
    rows = distinct.select("node", "n", "last", F.size("pre").alias("k"), F.posexplode("pre").alias("at", "h"))
    several = park(rows.groupBy("h").count().filter("count > 1").select(F.col("h").alias("_h")))
    tidy(rows.sparkSession)
    out = park(rows.join(few(several), F.col("h") == F.col("_h"), "left_semi"))
    unpark(several)
    return out


def room(x: str, y: str, p: Params) -> Column:
    """Whether what follows a first common shingle is enough, if none stands before it in either prefix."""
    return enough(1 + F.least(F.col(f"n{x}") - F.col(f"at{x}") - 1, F.col(f"n{y}") - F.col(f"at{y}") - 1), f"n{x}", f"n{y}", p)


def first_meetings(rows: DataFrame, p: Params) -> DataFrame:
    """u, v: each set and the least of those with which it shares a first shingle."""
    least = rows.groupBy("h").agg(F.min(F.struct("node", "n", "at")).alias("f")).select(F.col("h").alias("_h"), *(F.col(f"f.{c}").alias(f"{c}b") for c in ("node", "n", "at")))
    a = rows.select("h", *(F.col(c).alias(f"{c}a") for c in ("node", "n", "at")))
    both = a.join(least, (F.col("h") == F.col("_h")) & (F.col("nodea") != F.col("nodeb")) & room("a", "b", p))
    return both.select(F.col("nodea").alias("u"), F.col("nodeb").alias("v")).distinct()


def meetings(rows: DataFrame, roots: DataFrame, p: Params) -> DataFrame:
    """u, v: pairs of different components (node, root) that share a first shingle and can be similar."""
    rows = rows.join(roots.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").withColumn("root", F.coalesce("root", "node")).drop("_n")
    every = park(rows)
    several = every.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select(F.col("h").alias("_h"))
    rows = park(every.join(several, F.col("h") == F.col("_h"), "left_semi"))
    unpark(every)
    # a text's shared shingles by place: the first few, and how many there are
    per = rows.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("at", "h"))).alias("s"))  # no more than a text's prefix
    per = per.select(F.col("node").alias("_n"), F.transform(F.slice("s", 1, p.shown), lambda x: x["h"]).alias("pre"), F.slice(F.transform("s", lambda x: x["at"]), 1, p.shown).alias("ats"), F.size("s").alias("held"))
    rows = rows.join(per, F.col("node") == F.col("_n")).withColumn("i", F.expr("cast(filter(ats, x -> x < at) as array<int>)"))
    rows = rows.withColumn("i", F.size("i")).drop("_n", "ats")
    a, b = (rows.select("h", *(F.col(c).alias(c + x) for c in ("node", "n", "root", "at", "last", "k", "pre", "held", "i"))) for x in "ab")
    seen = F.arrays_overlap(F.slice("prea", F.lit(1), F.col("ia")), F.slice("preb", F.lit(1), F.col("ib")))
    # all common shingles of the prefixes, and what follows the prefix that ends first
    rest = F.when(F.col("lasta") < F.col("lastb"), F.col("na") - F.col("ka")).when(F.col("lasta") > F.col("lastb"), F.col("nb") - F.col("kb")).otherwise(F.greatest(F.col("na") - F.col("ka"), F.col("nb") - F.col("kb")))
    whole = (F.col("helda") <= p.shown) & (F.col("heldb") <= p.shown)
    most = ~whole | enough(F.size(F.array_intersect("prea", "preb")) + rest, "na", "nb", p)
    pairs = a.join(b, (a["h"] == b["h"]) & (F.col("nodea") > F.col("nodeb")) & (F.col("roota") != F.col("rootb")) & room("a", "b", p) & ~seen & most)
    return pairs.select(F.col("nodea").alias("u"), F.col("nodeb").alias("v")).distinct()


def fingerprint_links(distinct: DataFrame, p: Params) -> DataFrame:
    """u, v: sets whose fingerprints differ in no more than tau bits, enough of them to connect all such."""
    of = park(distinct.groupBy("fp").agg(F.min("node").alias("first")))
    same = distinct.join(of.withColumnRenamed("fp", "_f"), F.col("fp") == F.col("_f")).filter("node != first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    near = simhash.links(of.select("fp"), of.count(), p.fingerprint)
    a, b = of.select(F.col("fp").alias("_a"), F.col("first").alias("x")), of.select(F.col("fp").alias("_b"), F.col("first").alias("y"))
    return same.union(near.join(a, F.col("u") == F.col("_a")).join(b, F.col("v") == F.col("_b")).select("x", "y"))


def groups(documents: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_key, component_id (the least id that links reach) and stays (whether the row is the first of its group by id and text) for each row."""
    texts = documents.select(documents[id_col].alias("_id"), text_key(documents[text_col]).alias("_key"), as_text(documents, text_col).alias("_text"))
    rows = park(sketches(texts, frequent(texts, documents.count(), p), p))
    one = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_key"))
    wide = park(rows.groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("last").alias("last"), F.first("bits").alias("bits"), F.first("pre").alias("pre"), one.alias("one")))
    rows_of = park(rows.select("_id", "_key", "node"))
    unpark(rows)  # prefixes take most of the disk, and are read no more once it is known which shingles are shared
    some = shared(wide.filter("n > 0"), p)
    distinct = park(wide.select("node", "n", "fp", "bits", "one"))
    unpark(wide)
    keys = distinct.select("node", F.col("one._key").alias("_key"))
    pairs = fingerprint_links(distinct, p).union(first_meetings(some, p))
    pairs = park(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    maybe = possible(pairs, distinct, p)
    near = verified(maybe, texts, keys, p)
    unpark(maybe)
    more = park(meetings(some, connected(near), p).join(pairs, ["u", "v"], "left_anti"))
    unpark(some)
    unpark(pairs)
    maybe = possible(more, distinct, p)
    unpark(more)
    roots = connected(near.union(verified(maybe, texts, keys, p)))
    unpark(maybe)
    named = distinct.select("node", "one").join(roots.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("node", "one", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("one").alias("least"))
    named = named.join(least, "root").select(F.col("node").alias("_n"), "least")
    out = rows_of.join(named, F.col("node") == F.col("_n"))
    stays = F.col("_id").eqNullSafe(F.col("least._id")) & (F.col("_key") == F.col("least._key"))
    return out.select(F.col("_id").alias(id_col), F.col("_key").alias("text_key"), F.col("least._id").alias("component_id"), stays.alias("stays"))
