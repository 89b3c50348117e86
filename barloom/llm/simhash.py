"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint holds, for each of 64 bits, the majority among the XXH64 values of its word shingles. Two
fingerprints that differ in at most tau bits must, for any split of the bits into m parts with thresholds that sum to
tau - m + 1, differ in at most the threshold of some part within that part. Correlated bits are grouped into one part
(from a bounded sample of fingerprints), and dynamic programming gives each part the threshold, -1 (never
probed) included, that makes the estimated number of probes and candidates least. Probes meet in buckets, candidates
are verified by their differing bits.

All work after fingerprinting is on distinct fingerprints, so exact copies never pair up. Buckets of more than
`bucket` fingerprints, as large groups of near copies make them, aren't paired either: their members meet at every
value that is at most one bit away from them. Two members there differ in at most two bits, members that differ in
two bits do meet, and no value has more than 65 of them, so links through the least member lose nothing (for tau = 2;
for another tau such buckets are paired).

Null and empty texts have fingerprint 0 and link like any other. Long texts are read whole; an empty table gives an empty result. Null ids are carried; a group of null ids only has a
null component. Repeated rows are each returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import as_text, chunks, map_arrow, park
from .components import connected


@dataclass(frozen=True)
class Params:
    """shingle: words. seed: of XXH64. tau: most differing bits. parts: numbers of parts to choose from.
    sample: fingerprints to estimate from, a bound. bucket: see above."""

    shingle: int = 3
    seed: int = 42
    tau: int = 2
    parts: tuple[int, ...] = (2, 3, 4)
    sample: int = 2048
    bucket: int = 24


def fingerprint(text: bytes, p: Params = Params()) -> int:
    words = text.lower().split()
    if not words:
        return 0
    h, seed, k = xxhash.xxh64_intdigest, p.seed, p.shingle
    if len(words) < k:
        hashes = [h(b" ".join(words), seed)]
    else:
        hashes = [h(b" ".join(x), seed) for x in zip(*(words[i:] for i in range(k)))]
    n = len(hashes)
    count = np.zeros(64, np.int64)
    raw = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    for at in range(0, n, 1 << 14):
        count += np.unpackbits(raw[at : at + (1 << 14)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > n, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(documents: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (a signed 64-bit number) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in chunks(batches, "_text"):
            raw = t.data.tobytes()
            got = [fingerprint(raw[a:b], p) for a, b in zip(t.off[:-1], t.off[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(got, pa.int64())], names=["_id", "fp"])

    src = documents.select(documents[id_col].alias("_id"), as_text(documents, text_col).alias("_text"))
    return map_arrow(src, run, f"_id {documents.schema[id_col].dataType.simpleString()}, fp long").withColumnRenamed("_id", id_col)


def split_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """m parts of about equal width; each takes the bits most correlated with those it has."""
    bits = np.unpackbits(sample.astype(np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    with np.errstate(all="ignore"):
        near = np.abs(np.nan_to_num(np.corrcoef(bits.T))) if len(sample) > 1 else np.zeros((64, 64))
    left, out = list(range(64)), []
    for k in range(m):
        part = [left.pop(0)]
        while len(part) < (64 - sum(map(len, out))) // (m - k) and left:
            best = max(left, key=lambda b: (near[b, part].sum(), -b))
            left.remove(best)
            part.append(best)
        out.append(sorted(part))
    return out


def mask_of(part: list[int]) -> int:
    return sum(1 << b for b in part)


def plan(sample: np.ndarray, n: int, p: Params) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part that is probed; the cheapest over the given numbers of parts."""
    x = sample.astype(np.uint64)
    differ = x[:, None] ^ x[None, :]
    best: tuple[float, list] = (math.inf, [])
    for m in p.parts:
        parts = split_bits(sample, m)
        cost = []
        for part in parts:
            apart = np.bitwise_count(differ & np.uint64(mask_of(part))) if len(x) else np.zeros((0, 0), int)
            row = [0.0]
            for t in range(p.tau + 1):
                ball = sum(math.comb(len(part), k) for k in range(t + 1))
                pairs = max(0, int((apart <= t).sum()) - len(x)) / 2
                share = max(pairs / max(1, len(x) * (len(x) - 1) / 2), ball / 2.0 ** len(part))
                row.append(n * ball + share * n * n / 2)
            cost.append(row)
        # least[s]: cost and thresholds of the parts so far whose (threshold + 1) sum to s
        least: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for row in cost:
            step: dict[int, tuple[float, list[int]]] = {}
            for s, (c, ts) in least.items():
                for t in range(-1, p.tau + 1):
                    if s + t + 1 <= p.tau + 1 and (s + t + 1 not in step or c + row[t + 1] < step[s + t + 1][0]):
                        step[s + t + 1] = (c + row[t + 1], [*ts, t])
            least = step
        if p.tau + 1 in least and least[p.tau + 1][0] < best[0]:
            best = (least[p.tau + 1][0], [(part, t) for part, t in zip(parts, least[p.tau + 1][1]) if t >= 0])
    return best[1]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def ball(part: list[int], t: int) -> list[int]:
    out = [0]
    if t >= 1:
        out += [1 << b for b in part]
    if t >= 2:
        out += [(1 << a) | (1 << b) for i, a in enumerate(part) for b in part[:i]]
    if t > 2:
        raise ValueError("a part's threshold is at most 2")
    return [signed(v) for v in out]


def links(distinct: DataFrame, n: int, p: Params = Params()) -> DataFrame:
    """u, v: pairs of distinct fingerprints (column fp) whose components are those of all pairs at most tau bits apart."""
    sample = np.array([r[0] for r in distinct.orderBy(F.xxhash64("fp")).limit(p.sample).collect()], np.int64).view(np.uint64)
    chosen = plan(sample, n, p)
    kinds = [F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(signed(mask_of(part)))).alias("sig")) for i, (part, _) in enumerate(chosen)]
    data = distinct.select("fp", F.explode(F.array(*kinds)).alias("k")).select("fp", "k.part", "k.sig")
    around = F.lit(None).cast("array<bigint>")
    for i, (part, t) in enumerate(chosen):
        around = F.when(F.col("part") == i, F.array(*[F.lit(v) for v in ball(part, t)])).otherwise(around)
    probes = data.select("fp", "part", "sig", F.explode(around).alias("d")).select("fp", "part", F.col("sig").bitwiseXOR(F.col("d")).alias("sig"))
    full = data.groupBy("part", "sig").agg(F.count("*").alias("c")).filter(F.col("c") > p.bucket).select("part", "sig") if p.tau == 2 else None
    cold = data if full is None else data.join(full, ["part", "sig"], "left_anti")
    u, v = probes.withColumnRenamed("fp", "u"), cold.withColumnRenamed("fp", "v")
    pairs = u.join(v, ["part", "sig"]).filter(F.col("u") != F.col("v")).filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= p.tau)
    pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    if full is not None:
        hot = probes.join(full, ["part", "sig"], "left_semi").select("fp").distinct()
        near = hot.select("fp", F.explode(F.array(*[F.lit(signed(d)) for d in [0, *(1 << b for b in range(64))]])).alias("d"))
        near = near.select("fp", F.col("fp").bitwiseXOR(F.col("d")).alias("at"))
        meet = near.groupBy("at").agg(F.min("fp").alias("v"), F.collect_set("fp").alias("us")).filter(F.size("us") > 1)  # 65 at most
        meet = meet.select(F.explode("us").alias("u"), "v").filter(F.col("u") != F.col("v"))
        pairs = pairs.unionByName(meet)
    return pairs.distinct()


def groups(documents: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp, component_id (the least id that links reach) for each row."""
    fps = park(fingerprints(documents, p, id_col, text_col))
    distinct = park(fps.groupBy("fp").agg(F.min(id_col).alias("first")))
    roots = connected(links(distinct.select("fp"), distinct.count(), p))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    return fps.join(named, fps["fp"] == named["_fp"]).select(id_col, "fp", "component_id")
