"""Language identification by language-bitmask n-gram filters.

Every byte 5-gram of the lower-cased words (with one blank on each side, at the ends of a text too) is looked up in a Bloom filter whose cells
hold one bit per language, so that one probe of k cells, combined by AND, returns all languages that contain the gram.
A text's set bits are counted per language, corrected for the filter's share of false positives, and the largest count
decides; score is its share of all counts, 0 if no language has a known n-gram.

An n-gram belongs to a language if at least `least` of the learned texts hold it and its rate there is at least `near` of
its highest rate in any language. Rates come from at most about `sample_rows` labelled texts of each language, those with the smallest
hash of id and text, so that null and repeated ids are drawn by their texts. All n-grams of these texts count, and the filter's cells follow their number.

Null texts and texts without a letter get `und` and score 0; ties go to the language first in order. Repeated rows are each judged, long texts read whole. If
nothing can be learned, as from an empty table, every text gets `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import as_text, chunks, LOWER, map_arrow, mix, SPACE, sums, Texts

UND = "und"


@dataclass(frozen=True)
class Params:
    """bits: log2 of the filter's least cells; there are `cells` for each n-gram at least. hashes: probes. sample_rows: texts of each language to learn from, a bound.
    least, near: see above."""

    bits: int = 20
    cells: int = 8
    hashes: int = 2
    sample_rows: int = 1500
    least: int = 3
    near: float = 0.3


BLANK = SPACE.copy()
BLANK[33:48] = BLANK[58:65] = BLANK[91:97] = BLANK[123:127] = True
BLANK[48:58] = True


def padded(t: Texts) -> Texts:
    """Each text with a blank at both ends."""
    off = t.off + 2 * np.arange(t.n + 1)
    data = np.full(off[-1], 32, np.uint8)
    at = np.arange(len(t.data)) + np.repeat(2 * np.arange(t.n) + 1, np.diff(t.off))
    data[at] = t.data
    return Texts(data, off)


def grams(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of the 5-grams that lie within a word and its two blanks, and their number before each text."""
    t = padded(t)
    n = len(t.data)
    raw = LOWER[t.data].astype(np.uint64)
    raw[BLANK[t.data]] = 32
    if n < 5:
        return np.zeros(0, np.uint64), np.zeros(t.n + 1, np.int64)
    key = np.zeros(n - 4, np.uint64)
    for k in range(5):
        key |= raw[k : n - 4 + k] << np.uint64(8 * k)
    gap = raw == 32
    ok = ~(gap[1 : n - 3] | gap[2 : n - 2] | gap[3 : n - 1])
    crossing = np.zeros(n + 1, np.int64)
    crossing[t.off[1:-1]] = 1
    crossing = np.cumsum(crossing)
    ok &= crossing[4:n] == crossing[: n - 4]
    at = np.flatnonzero(ok)
    return key[at], np.searchsorted(at, t.off)


@dataclass
class Model:
    languages: list[str]
    cells: list[np.ndarray]  # one array of bitmasks for each 8 languages
    false: np.ndarray  # share of false positives of each language
    p: Params

    @staticmethod
    def places(keys: np.ndarray, bits: int, p: Params) -> list[np.ndarray]:
        h, out = mix(keys), []
        for _ in range(p.hashes):
            out.append((h >> np.uint64(64 - bits)).astype(np.int64))
            h = mix(h)
        return out

    @classmethod
    def build(cls, languages: list[str], keys: np.ndarray, lang: np.ndarray, p: Params) -> Model:
        """keys, lang: each n-gram with each language that it belongs to, by number."""
        cells, false = [], []
        for at in range(0, len(languages), 8):
            own = (lang >= at) & (lang < at + 8)
            k, l = keys[own], lang[own] - at
            bits = max(p.bits, int(np.ceil(np.log2(max(1, p.cells * len(np.unique(k)))))))
            cell = np.zeros(1 << bits, np.uint8)
            for place in cls.places(k, bits, p):
                np.bitwise_or.at(cell, place, np.left_shift(1, l).astype(np.uint8))
            false += [float(((cell >> x) & 1).mean() ** p.hashes) for x in range(min(8, len(languages) - at))]
            cells.append(cell)
        return cls(languages, cells, np.array(false), p)

    def counts(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Corrected counts (texts x languages) and the number of grams of each text."""
        keys, off = grams(t)
        n, out = np.diff(off), np.zeros((t.n, len(self.languages)))
        for c, cell in enumerate(self.cells):
            places = self.places(keys, len(cell).bit_length() - 1, self.p)
            mask = cell[places[0]]
            for place in places[1:]:
                mask &= cell[place]
            for k in range(min(8, len(self.languages) - 8 * c)):
                l = 8 * c + k
                hits = sums(((mask >> k) & 1).astype(np.int64), off)
                out[:, l] = np.maximum(0, hits - n * self.false[l]) / (1 - min(0.99, self.false[l]))
        return out, n

    def predict(self, t: Texts, letters: np.ndarray) -> tuple[list, np.ndarray]:
        if not self.languages:
            return [UND] * t.n, np.zeros(t.n)
        count, _ = self.counts(t)
        best, total = count.argmax(1), count.sum(1)
        share = np.where(total > 0, count[np.arange(t.n), best] / np.maximum(total, 1e-12), 0.0)
        return [self.languages[b] if ok else UND for b, ok in zip(best, letters)], np.where(letters, share, 0.0)


def fit(documents: DataFrame, keep: Column | None = None, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn the filter. keep: a condition on `_id`."""
    rows = documents.select(documents[id_col].alias("_id"), as_text(documents, text_col).alias("_text"), documents[lang_col].cast("string").alias("_lang"))
    rows = rows.filter(F.col("_lang").isNotNull() & (F.lit(True) if keep is None else keep))
    found = rows.groupBy("_lang").count().orderBy("_lang").collect()  # one row per language
    if not found:
        return Model([], [], np.zeros(0), p)
    languages = [r["_lang"] for r in found]
    draw = F.pmod(F.xxhash64("_id", "_text", F.lit(10)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.lit(1.0)
    number = F.lit(-1)
    for i, r in enumerate(found):
        share = F.when(F.col("_lang") == r["_lang"], F.lit(min(1.0, p.sample_rows / r["count"]))).otherwise(share)
        number = F.when(F.col("_lang") == r["_lang"], F.lit(i)).otherwise(number)
    sample = rows.withColumn("_l", number).filter(draw < share).select("_l", "_text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush():
            keys, n = np.unique(np.concatenate(held), axis=0, return_counts=True) if held else (np.zeros((0, 2), np.uint64), np.zeros(0, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(keys[:, 0].astype(np.int64)), pa.array(keys[:, 1].astype(np.int32)), pa.array(n.astype(np.int64))], names=["g", "l", "n"])

        for batch, t in chunks(batches, "_text"):
            keys, off = grams(t)
            owner = np.repeat(np.arange(t.n), np.diff(off))
            pairs = np.stack([keys, owner.astype(np.uint64)], 1)
            order = np.lexsort((pairs[:, 1], pairs[:, 0]))
            pairs = pairs[order]
            fresh = np.ones(len(pairs), bool)
            fresh[1:] = (pairs[1:] != pairs[:-1]).any(1)
            pairs = pairs[fresh]
            lang = batch.column("_l").to_numpy(zero_copy_only=False).astype(np.uint64)
            held.append(np.stack([pairs[:, 0], lang[pairs[:, 1].astype(np.int64)]], 1))
            size += len(pairs)
            if size > 1_000_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    # documents that hold the gram, in each language
    n = map_arrow(sample, count, "g long, l int, n long").groupBy("g", "l").agg(F.sum("n").alias("n"))
    learned = F.array(*[F.lit(float(min(r["count"], p.sample_rows))) for r in found])
    n = n.withColumn("rate", F.col("n") / F.element_at(learned, F.col("l") + 1))
    best = n.groupBy("g").agg(F.max("rate").alias("best"), F.sum("n").alias("all")).filter(F.col("all") >= p.least).select(F.col("g").alias("_g"), "best")
    members = n.join(best, F.col("g") == F.col("_g")).filter(F.col("rate") >= p.near * F.col("best")).select("g", "l")
    got = members.toArrow()  # the n-grams of sample_rows texts of each language
    return Model.build(languages, got.column("g").to_numpy().astype(np.uint64), got.column("l").to_numpy().astype(np.int64), p)


def predict(documents: DataFrame, model: Model, carry: list[str], text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The carried columns, then the predicted language and its score."""
    held = documents.sparkSession.sparkContext.broadcast(model)  # bounded by bits and the number of languages
    own = f"_c{carry.index(text_col)}" if text_col in carry else "_text"
    typed = documents.select(*[documents[c].alias(f"_c{i}") for i, c in enumerate(carry)], *([] if text_col in carry else [documents[text_col].cast("string").alias("_text")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in chunks(batches, own):
            letters = pc.fill_null(pc.match_substring_regex(batch.column(own), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            lang, score = held.value.predict(t, letters)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(carry))), pa.array(lang, pa.string()), pa.array(score)], names=[*(f"_c{i}" for i in range(len(carry))), "_l", "_s"])

    kinds = "".join(f"_c{i} {documents.schema[c].dataType.simpleString()}, " for i, c in enumerate(carry))
    out = map_arrow(typed, run, f"{kinds}_l string, _s double")
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], F.col("_l").alias(names[0]), F.col("_s").alias(names[1]))
