r"""Benchmark decontamination by an FM-index of every training shard.

A shard is a run of documents that one task reads, up to `shard_words` words that matter. Its words become the numbers
of the benchmark's vocabulary; runs too short to hold a window of the benchmark, counted in words that the benchmark
knows, can't match and aren't kept, the rest is joined by separators. The shard's suffix array gives its Burrows-Wheeler
transform, held as a wavelet matrix of packed bits; the windows of the benchmark whose words all stand in the shard are searched backwards at once by rank queries, and
occurrences are located by walking to sampled suffix positions. Hit words are merged into removal spans.

Words are maximal runs of digits, letters a-z (A-Z lower-cased) and non-ASCII characters, known by 64-bit hashes. A window is `window` consecutive
words of an item; an item with fewer words is one window, one with none has none. The benchmark is cut into blocks
of at most `block_words`, each broadcast by itself and searched for in a pass of its own; a pass returns the hits of the texts that have any, by a hash
of the text (128 bits), and one last pass joins all hits with the documents. So neither the driver nor a task ever holds more than a block, a shard and a text.

Null and empty texts have no word. Long texts are read whole. Repeated rows are each judged;
items that share an id count once, items with a null id count as the empty id. Without a benchmark nothing is hit; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import as_text, chunks, few, map_arrow, park, Texts

#: Lower-cases A-Z and blanks every other ASCII character that isn't part of a word.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BLANK = np.frombuffer(WORDS, np.uint8) == 32


@dataclass(frozen=True)
class Params:
    """window: words. shard_words: words of a shard's index. sample: distance of sampled suffix positions.
    block_words: words of the benchmark that are searched for at once. piece_words: of an item that a row holds. windows: searched for in one step."""

    window: int = 10
    shard_words: int = 400_000
    sample: int = 16
    block_words: int = 1 << 22
    piece_words: int = 1 << 20
    windows: int = 1 << 18


def hashed(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and their number before each text."""
    low = t.lowered()
    starts, ends, off = low.spans(BLANK)
    return low.hashes(starts, ends), off


def encoded(benchmark: DataFrame, p: Params, id_col: str, text_col: str) -> DataFrame:
    """item, words (hashes, packed): items in pieces that overlap by a window less a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in chunks(batches, "_text"):
            h, off = hashed(t)
            items, words = [], []
            for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                for at in range(a, max(b - p.window + 1, a + 1) if b > a else a, p.piece_words):
                    items.append(i)
                    words.append(h[at : min(b, at + p.piece_words + p.window - 1)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(items, pa.int64())), pa.array(words, pa.binary())], names=["item", "words"])

    src = benchmark.select(F.coalesce(benchmark[id_col].cast("string"), F.lit("")).alias("item"), as_text(benchmark, text_col).alias("_text"))
    return map_arrow(src, run, "item string, words binary")


@dataclass
class Block:
    """A block of the benchmark: its vocabulary (hashes in order), its words as numbers (from 1, 0 between items), the start and length of each distinct window in them,
    and the items of window i, items[of[off[i]:off[i + 1]]]."""

    vocabulary: np.ndarray
    words: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    items: list[str]
    of: np.ndarray
    off: np.ndarray

    @classmethod
    def build(cls, rows: list[tuple[str, np.ndarray]], p: Params) -> Block:
        vocabulary, number = np.unique(np.concatenate([h for _, h in rows]), return_inverse=True)
        n = np.array([len(h) for _, h in rows])
        at = np.concatenate([[0], np.cumsum(n + 1)])
        words = np.zeros(at[-1], np.int32)
        words[np.arange(n.sum()) + np.repeat(np.arange(len(n)), n)] = number + 1
        length = np.minimum(n, p.window)
        count = n - length + 1
        starts = np.repeat(at[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        lengths = np.repeat(length, count)
        items, of_row = np.unique(np.array([i for i, _ in rows], object), return_inverse=True)
        owner = np.repeat(of_row, count)
        key = lengths.astype(np.uint64)
        padded = np.concatenate([words, np.zeros(p.window, np.int32)]).astype(np.uint64)
        for k in range(p.window):
            key = (key ^ np.where(lengths > k, padded[starts + k], np.uint64(0))) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        _, first, same = np.unique(key, return_index=True, return_inverse=True)
        pairs = np.unique(np.stack([same, owner], 1), axis=0)
        return cls(vocabulary, words, starts[first].astype(np.int32), lengths[first].astype(np.int32), items.tolist(), pairs[:, 1].astype(np.int32), np.searchsorted(pairs[:, 0], np.arange(len(first) + 1)))

    def present(self, x: np.ndarray) -> np.ndarray:
        """The windows whose words all stand in x."""
        here = np.zeros(len(self.vocabulary) + 1, bool)
        here[x] = True
        here[0] = False
        missing = np.concatenate([[0], np.cumsum(~here[self.words])])
        return np.flatnonzero(missing[self.starts + self.lengths] == missing[self.starts])


def blocks(benchmark: DataFrame, p: Params, id_col: str, text_col: str) -> Iterator[Block]:
    """The benchmark, hashed on the executors, block by block."""
    rows, size = [], 0
    for item, words in encoded(benchmark, p, id_col, text_col).toLocalIterator(prefetchPartitions=False):
        rows.append((item, np.frombuffer(bytes(words), np.uint64)))
        size += len(rows[-1][1])
        if size >= p.block_words:
            yield Block.build(rows, p)
            rows, size = [], 0
    if rows:
        yield Block.build(rows, p)


def suffix_array(x: np.ndarray) -> np.ndarray:
    """By doubling; zeros (separators) differ from each other and rank by place."""
    n = len(x)
    rank = x.astype(np.int64)
    zero = np.flatnonzero(x == 0)
    rank = np.where(x == 0, 0, rank + len(zero))
    rank[zero] = np.arange(len(zero))
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        ahead = np.full(n, -1, np.int64)
        ahead[: n - step] = rank[step:] if step < n else ahead[: n - step]
        key = rank * (n + len(zero) + int(x.max(initial=0)) + 2) + ahead + 1
        order = np.argsort(key, kind="stable")
        fresh = np.ones(n, np.int64)
        fresh[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh) - 1
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class Bits:
    """Packed bits with the ones before each 64 of them."""

    def __init__(self, bit: np.ndarray):
        padded = np.zeros((len(bit) // 64 + 1) * 64, bool)
        padded[: len(bit)] = bit
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)
        self.ones = int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        w = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w].astype(np.int64) + np.bitwise_count(self.words[w] & below)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class FMIndex:
    def __init__(self, x: np.ndarray, sample: int):
        """x: word numbers, 0 for separators; x ends with a separator."""
        sa = suffix_array(x)
        last = x[sa - 1]
        top = int(x.max(initial=0))
        self.n, self.bits = len(x), max(1, top.bit_length())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(x, minlength=top + 1))])
        self.levels: list[tuple[Bits, int]] = []
        level = last
        for b in range(self.bits - 1, -1, -1):
            bit = ((level >> b) & 1).astype(bool)
            self.levels.append((Bits(bit), len(x) - int(bit.sum())))
            level = np.concatenate([level[~bit], level[bit]])
        # places after a separator are sampled too, so that a walk never steps onto one
        marked = (sa % sample == 0) | (last == 0)
        self.marked, self.places = Bits(marked), sa[marked].astype(np.int32)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often word c stands in the first i cells of the transform."""
        lo, hi = np.zeros(len(i), np.int64), i.astype(np.int64)
        for k, (ones, zeros) in enumerate(self.levels):
            bit = ((c >> (self.bits - 1 - k)) & 1).astype(bool)
            a, b = ones.rank(lo), ones.rank(hi)
            lo, hi = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + b, hi - b)
        return hi - lo

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words at cells i, and how often each stands before its cell."""
        at, lo, c = i.astype(np.int64), np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for ones, zeros in self.levels:
            bit = ones.get(at)
            c = 2 * c + bit
            a, b = ones.rank(at), ones.rank(lo)
            at, lo = np.where(bit, zeros + a, at - a), np.where(bit, zeros + b, lo - b)
        return c, at - lo

    def search(self, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each phrase words[start:start + length]; empty where end <= start."""
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), self.n, np.int64)
        known = len(self.before) - 2
        for k in range(int(lengths.max(initial=0)) - 1, -1, -1):
            on = np.flatnonzero((k < lengths) & (lo < hi))
            c = words[starts[on] + k].astype(np.int64)
            out = on[c > known]
            hi[out] = lo[out]
            on, c = on[c <= known], c[c <= known]
            lo[on], hi[on] = self.before[c] + self.rank(c, lo[on]), self.before[c] + self.rank(c, hi[on])
        return lo, hi

    def locate(self, i: np.ndarray) -> np.ndarray:
        i, add, out = i.astype(np.int64), 0, np.zeros(len(i), np.int64)
        on = np.arange(len(i))
        while len(on):
            here = self.marked.get(i[on])
            done = on[here]
            out[done] = self.places[self.marked.rank(i[done])] + add
            on = on[~here]
            c, before = self.access(i[on])
            i[on] = self.before[c] + before
            add += 1
        return out


@dataclass
class Shard:
    """Runs of known words: their numbers, each run followed by 0, and each run's text (by number), place in it and length."""

    p: Params
    numbers: list[np.ndarray]
    texts: list[np.ndarray]
    places: list[np.ndarray]
    lengths: list[np.ndarray]
    words: int = 0

    def add(self, number: np.ndarray, off: np.ndarray, first: int, shortest: int) -> None:
        """The texts of a chunk, numbered from `first`; words that the benchmark doesn't know are 0."""
        known = np.flatnonzero(number)
        if not len(known):
            return
        owner = np.searchsorted(off, known, "right") - 1
        fresh = np.ones(len(known), bool)
        fresh[1:] = (known[1:] != known[:-1] + 1) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(fresh)
        length = np.diff(np.concatenate([at, [len(known)]]))
        keep = length >= shortest
        at, length = at[keep], length[keep]
        if not len(at):
            return
        self.texts.append(owner[at] + first)
        self.places.append(known[at] - off[owner[at]])
        self.lengths.append(length)
        x = np.zeros(int(length.sum()) + len(length), np.int32)
        inner = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        x[np.arange(length.sum()) + np.repeat(np.arange(len(length)), length)] = number[np.repeat(known[at], length) + inner]
        self.numbers.append(x)
        self.words += len(x)

    def hits(self, block: Block) -> Iterator[tuple[int, list[int], list[str]]]:
        """Text, merged spans of hit words (start, end, start, end, ...) and items, for each text that is hit."""
        if not self.numbers:
            return
        x = np.concatenate(self.numbers)
        some = block.present(x)
        if not len(some):
            return
        index = FMIndex(x, self.p.sample)
        windows, places = [], []
        for a in range(0, len(some), self.p.windows):
            w = some[a : a + self.p.windows]
            lo, hi = index.search(block.words, block.starts[w], block.lengths[w])
            count = np.maximum(hi - lo, 0)
            windows.append(np.repeat(w, count))
            places.append(index.locate(np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)))
        window, place = np.concatenate(windows), np.concatenate(places)
        length, text, begin = (np.concatenate(v) for v in (self.lengths, self.texts, self.places))
        ends = np.cumsum(length + 1)
        run = np.searchsorted(ends, place, "right")
        start = place - (ends[run] - length[run] - 1) + begin[run]
        end = start + block.lengths[window]
        order = np.lexsort((start, text[run]))
        owner, window, start, end = text[run][order], window[order], start[order], end[order]
        cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
        for a, b in zip(cuts, [*cuts[1:], len(owner)]):
            far = np.maximum.accumulate(end[a:b])
            new = np.flatnonzero(np.concatenate([[True], start[a + 1 : b] > far[:-1]]))
            spans = np.stack([start[a:b][new], np.concatenate([far[new[1:] - 1], far[-1:]])], 1)
            w = np.unique(window[a:b])
            found = np.unique(np.concatenate([block.of[block.off[i] : block.off[i + 1]] for i in w]))
            yield int(owner[a]), spans.ravel().tolist(), [block.items[i] for i in found]


def spans(text: bytes) -> tuple[list[bytes], np.ndarray]:
    """Words and where each starts, in bytes."""
    low = text.translate(WORDS)
    own = low.split()
    raw = np.frombuffer(low, np.uint8) != 32
    return own, np.flatnonzero(raw & ~np.concatenate([[False], raw[:-1]]))


def without(text: pa.StringScalar, hit: list[int]) -> str:
    """The text without the spans of hit words and what stands between the words of a span."""
    raw = text.as_py().encode()
    own, starts = spans(raw)
    keep, at = [], 0
    for run in np.split(np.array(hit), np.flatnonzero(np.diff(hit) > 1) + 1):
        keep.append(raw[at : int(starts[run[0]])])
        at = int(starts[run[-1]]) + len(own[run[-1]])
    return b"".join([*keep, raw[at:]]).decode()


def keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(1), text).alias("_k2")]


def hits_of(documents: DataFrame, benchmark: DataFrame, p: Params, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """_k1, _k2, _spans (places of words, start and end), _items for each distinct text that is hit."""
    sc = documents.sparkSession.sparkContext
    text = as_text(documents, text_col)
    src = documents.select(*keys(text), text.alias("_text"))
    kind = "_k1 long, _k2 long, _spans array<long>, _items array<string>"

    def pass_over(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = held.value
            shortest = int(block.lengths.min())
            shard, ids = Shard(p, [], [], [], []), []

            def flush() -> Iterator[pa.RecordBatch]:
                known = np.concatenate(ids) if ids else np.zeros((0, 2), np.int64)
                found = list(shard.hits(block))
                if found:
                    at = [x[0] for x in found]
                    yield pa.RecordBatch.from_arrays([pa.array(known[at, 0]), pa.array(known[at, 1]), pa.array([x[1] for x in found], pa.list_(pa.int64())), pa.array([x[2] for x in found], pa.list_(pa.string()))], names=["_k1", "_k2", "_spans", "_items"])

            texts = 0
            for batch, t in chunks(batches, "_text"):
                h, off = hashed(t)
                at = np.minimum(np.searchsorted(block.vocabulary, h), len(block.vocabulary) - 1)
                number = np.where(block.vocabulary[at] == h, at + 1, 0).astype(np.int32)
                ids.append(np.stack([batch.column(c).to_numpy() for c in ("_k1", "_k2")], 1))
                shard.add(number, off, texts, shortest)
                texts += t.n
                if shard.words + 8 * texts >= p.shard_words:
                    yield from flush()
                    shard, ids, texts = Shard(p, [], [], [], []), [], 0
            yield from flush()

        return run

    found = []
    for block in blocks(benchmark, p, item_col, item_text):
        if not len(block.starts):
            continue
        held = sc.broadcast(block)  # bounded by block_words
        del block
        found.append(park(map_arrow(src, pass_over(held), kind)))
        held.destroy()
    if not found:
        return documents.sparkSession.createDataFrame([], kind)
    every = reduce(DataFrame.union, found)
    each = every.groupBy("_k1", "_k2").agg(F.flatten(F.collect_set("_spans")).alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_items")))).alias("_items"))  # one for each block
    return park(each)


def search(documents: DataFrame, benchmark: DataFrame, carry: list[str], p: Params = Params(), text_col: str = "text", item_col: str = "item_id", item_text: str = "text", cut: bool = False) -> DataFrame:
    """The carried columns as _c0, _c1, ..., then n_words, n_hit, items (sorted ids), and _text (without the hit words if cut).

    cut removes each maximal span of hit words, with what stands between them, from the text.
    """
    hits = hits_of(documents, benchmark, p, text_col, item_col, item_text).withColumnsRenamed({"_k1": "_h1", "_k2": "_h2"})
    own = [f"_c{i}" for i in range(len(carry))]
    text = as_text(documents, text_col)
    df = documents.select(*[documents[c].alias(f"_c{i}") for i, c in enumerate(carry)], text.alias("_text"), *keys(text))
    df = df.join(few(hits, 1 << 17), (F.col("_k1") == F.col("_h1")) & (F.col("_k2") == F.col("_h2")), "left").drop("_k1", "_k2", "_h1", "_h2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in chunks(batches, "_text"):
            counts = np.diff(t.spans(BLANK)[2])
            spans = batch.column("_spans").to_pylist()
            hit = [sorted({i for a, b in zip(s[::2], s[1::2]) for i in range(a, b)}) if s else [] for s in spans]
            if cut:
                texts = pa.array([without(x, m) if m else x.as_py() for x, m in zip(batch.column("_text"), hit)], pa.string())
            else:
                texts = pa.array([""] * batch.num_rows, pa.string())
            items = pa.array([i or [] for i in batch.column("_items").to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(counts), pa.array([len(m) for m in hit], pa.int64()), items, texts], names=[*own, "n_words", "n_hit", "items", "_text"])

    kinds = "".join(f"_c{i} {documents.schema[c].dataType.simpleString()}, " for i, c in enumerate(carry))
    return map_arrow(df, run, f"{kinds}n_words long, n_hit long, items array<string>, _text string")
