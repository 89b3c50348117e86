r"""Language model by logistic context mixing over bits, trained on Spark.

Texts are coded as bits: a word among the `head` most frequent ones by its Huffman path, any other word by an escape
path and then its bytes and a blank, each by the Huffman path of its value; paths are nibbles of four bits, so that a nibble's cells stand together; an end follows the last word. Every bit is predicted in several hashed
contexts (node of a path alone, after the last two of the most frequent words, after the last word, after the last two; bit of a byte after one byte of the word and a frequent word, after two and three bytes and after all of them). A node alone knows the words below it by their counts; in the other contexts a cell counts zeros and ones over all training texts. The predictions' logits are combined by weights that
a gate chooses, from how often the contexts were seen; weights follow the online gradient over all training texts, a bit's own
count left out of its predictions: each task follows its texts, and the tasks' weights are averaged by the bits that each gate met. An adaptive probability map over the mixed logit, from all those bits, refines it.
Of the words that training texts hold once, two thirds stand, there, for the words it doesn't know: they are coded by the escape, so that spelling is learned and its share is right.

While a text is scored, its own words so far are a last predictor, mixed in by a share that depends on their number (learned on all training texts, too). Nothing else moves, so a score depends on the
text and the model alone, not on the rows around it. The sum over tokens is the text's probability, and bits per byte follow.

Counting is spread over all training texts: each of a few tasks for each core sends its cells, packed, in blocks, and tasks that get a block
each add them up as they stream past. The cells of a context grow with the square root of the training tokens, to 2^30 at some 10^13 tokens, more than which are refused.

The base score is a smoothed unigram model with exact counts: frequent words are looked up in the broadcast head, all
others by a join. It doesn't sum to one: every unknown word gets a tenth of a count, however many there are. Null and empty texts consist of the end alone. Long texts are read whole. Rows with equal ids are scored each for itself,
rows with null ids count as one id in the choice of training texts. Without
training texts counts are zero and every bit costs one bit; an empty table gives an empty result. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import as_text, chunks, map_arrow, mix, park, SPACE, sums, Texts

END_HASH = np.uint64(0x7FFFFFFFFFFFFFFF)
GOLD = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 1 << 15
LN10 = float(np.log(10))


@dataclass(frozen=True)
class Params:
    """head: words with a code of their own. anchors: the most frequent of them; the last ones seen tell of language and topic. bits: log2 of the cells of a
    context of words at 2^24 training tokens, half a bit more for each doubling; small_bits, byte_bits: of the contexts of bytes. sample_rows: accepted, but without effect, as weights are fitted on all training texts.
    rate, batch: online steps. delta: added to counts. flush: distinct words after which a task sends its word counts. chunk: bytes of text that a
    task turns into bits at once. tables: counting tasks for each core."""

    head: int = (1 << 18) - 2
    anchors: int = 16
    bits: int = 20
    byte_bits: int = 20
    small_bits: int = 18
    sample_rows: int = 1000
    rate: float = 0.02
    batch: int = 4096
    delta: float = 0.4
    flush: int = 1 << 20
    chunk: int = 1 << 18
    tables: int = 2


#: Contexts of a bit, and gates: how often the last three of them were seen.
CONTEXTS, GATES = 4, 64
#: Words that occur so often in training texts, at most, teach how unknown words are spelled.
SPELLED = 16
#: Nibbles that a block has, about.
STRETCH = 1 << 13
#: Shares of a text's own words that are tried.
SHARES = np.array([0.0, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4])


def word_hashes(t: Texts) -> tuple[Texts, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = t.lowered()
    starts, ends, off = low.spans()
    h = low.hashes(starts, ends)
    h[h == END_HASH] -= np.uint64(1)
    return low, starts, ends, off, h


def count_words(texts: DataFrame, p: Params) -> DataFrame:
    """h, n, byte: occurrences of each token (by hash, byte false) in the column _text, ends included, and of each value of a word's bytes, 32 for its end (byte true)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, docs, values = 0, 0, np.zeros(256, np.int64)

        def rows(keys: np.ndarray, n: np.ndarray, byte: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n), pa.array(np.full(len(n), byte))], names=["h", "n", "byte"])

        def merged() -> pa.RecordBatch:
            keys, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return rows(keys, np.bincount(back, np.concatenate([c for _, c in held])).astype(np.int64), False)

        for _, t in chunks(batches, "_text", p.chunk):
            low, starts, _, _, h = word_hashes(t)
            values += np.where(SPACE, 0, np.bincount(low.data, minlength=256))
            values[32] += len(starts)
            held.append(np.unique(h, return_counts=True))
            docs += t.n
            size += len(held[-1][0])
            if size >= p.flush:
                yield merged()
                held, size = [], 0
        if docs:
            held.append((np.array([END_HASH]), np.array([docs])))
            yield merged()
            yield rows(np.arange(256), values, True)

    return map_arrow(texts, run, "h long, n long, byte boolean").groupBy("byte", "h").agg(F.sum("n").alias("n"))


#: Bits of a nibble, and the places among a node's 15 binary nodes, 1 to 15, at which they are decided.
NIBBLES = (np.arange(16) >> np.arange(3, -1, -1)[:, None] & 1).astype(np.uint8)
INSIDE = (16 + np.arange(16)) >> np.arange(4, 0, -1)[:, None]
KINDS = 33 * np.arange(4)[:, None]


class Tree:
    """Huffman paths of symbols by their weights, in nibbles of four bits; the lightest node may have fewer than 16 symbols, and fewer bits. lengths: bits of each path.
    groups: the paths' nibbles one after the other, with the node, the depth (3 nibbles at most) and the number of bits of each. below: the weights on each side of a binary node, 16 a node."""

    def __init__(self, weight: list[int]):
        n = len(weight)
        nodes = -(-(n - 1) // 15)
        heap = [(w, i) for i, w in enumerate(weight)]
        heapq.heapify(heap)
        parent, nibble, bits = np.zeros(n + nodes, np.int64), np.zeros(n + nodes, np.uint32), np.full(n + nodes, 4, np.uint32)
        leaves = np.zeros((nodes, 16), np.int64)
        for new in range(nodes):
            some = [heapq.heappop(heap) for _ in range(16 if new else 2 + (n - 2) % 15)]
            at = [i for _, i in some]
            depth = (len(some) - 1).bit_length()
            short = (1 << depth) - len(some)  # the heaviest have a bit less
            depths = np.array([depth] * (len(some) - short) + [depth - 1] * short)
            place = (np.cumsum(16 >> depths) - (16 >> depths)).astype(np.int64)
            parent[at], nibble[at], bits[at] = n + new, place, depths
            leaves[new, place] = [w for w, _ in some]
            heapq.heappush(heap, (sum(w for w, _ in some), n + new))
        root, at, steps = n + nodes - 1, np.arange(n), []
        while (at != root).any():
            on = at != root
            steps.append((on, parent[at] - n, nibble[at], bits[at]))
            at = np.where(on, parent[at], root)
        self.group_lengths = sum(on.astype(np.int64) for on, *_ in steps)
        self.group_offsets = np.concatenate([[0], np.cumsum(self.group_lengths)])
        self.lengths = sum(np.where(on, size, 0).astype(np.int64) for on, _, _, size in steps)
        self.n_nodes = 16 * nodes
        if nodes >> 23:  # a group has 32 bits
            raise OverflowError(f"{nodes} nodes of a tree; lower Params.head")
        self.groups = np.zeros(self.group_offsets[-1], np.uint32)
        for k, (on, up, value, size) in enumerate(steps):
            depth = np.minimum(self.group_lengths[on] - 1 - k, 3)
            self.groups[(self.group_offsets[1:] - 1 - k)[on]] = (up[on] << 9 | depth << 7 | size[on] << 4 | value[on]).astype(np.uint32)
        below = np.zeros((nodes, 16, 2), np.int64)
        for first in (8, 4, 2, 1):
            below[:, first : 2 * first] = leaves.reshape(nodes, first, 2, -1).sum(-1)
        self.below = np.minimum(below, 0xFFFFFFFF).astype(np.uint32).reshape(-1, 2)
        self.whole = bool((self.groups >> np.uint32(4) & np.uint32(7) == 4).all())


class Code(Tree):
    """Huffman paths. Symbols: the head words in the order of their hashes, then the end, then the escape, which has two thirds of each word that occurs once.
    values: how often each value of a byte occurs, for the paths of bytes."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, ends: int, others: int, anchors: int = 16, values: np.ndarray | None = None):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.end, self.escape = len(hashes), len(hashes) + 1
        self.anchor = np.zeros(len(hashes) + 2, np.uint64)
        top = np.lexsort((self.hashes, -self.counts))[:anchors]
        self.anchor[top] = np.arange(1, len(top) + 1, dtype=np.uint64)
        once = self.counts == 1
        # three times the tokens, words that occur once by a third
        super().__init__([*np.where(once, 1, 3 * self.counts).tolist(), max(1, 3 * ends), max(1, 3 * others + 2 * int(once.sum()))])
        self.bytes = Tree([int(n) + 1 for n in (np.zeros(256, np.int64) if values is None else values)])
        self.first = np.searchsorted(self.hashes >> np.uint64(46), np.arange((1 << 18) + 1, dtype=np.uint64)).astype(np.int32)

    @cached_property
    def taught(self) -> np.ndarray:
        """The symbol of each symbol in training texts: the escape for two thirds of the words that occur once."""
        out = np.arange(self.escape + 1)
        out[:-2][(self.counts == 1) & (self.hashes % np.uint64(3) > 0)] = self.escape
        return out

    @cached_property
    def spelled(self) -> np.ndarray:
        """Symbols that are spelled besides in training texts."""
        return np.concatenate([(self.counts >= 1) & (self.counts <= SPELLED), [False, False]])

    @cached_property
    def held(self) -> np.ndarray:
        """How many of its own three thirds each symbol's nodes hold: none for 0, two for 1, all for 2."""
        return np.concatenate([np.where(self.counts > 1, 2, 0), [2, 1]])

    def less(self, delta: float) -> np.ndarray:
        """Logits of a node without a token's own thirds, at 2 * (n_nodes * held + node) + bit."""
        out = np.empty((3, self.n_nodes, 2), np.float32)
        for k, own in enumerate((0, 2, 3)):
            for bit in (0, 1):
                zero, one = (np.maximum(self.below[:, side].astype(np.float32) - np.float32(own * (bit == side)), 0) + np.float32(delta) for side in (0, 1))
                out[k, :, bit] = np.log(one / zero)
        return out.ravel()

    def symbols(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(h), self.escape)
        # hashes are spread evenly, so that few share their highest bits
        top = (h >> np.uint64(46)).astype(np.int32)
        at, end = self.first[top], self.first[top + 1]
        out = np.full(len(h), self.escape)
        left = np.flatnonzero(at < end)
        while len(left):
            hit = self.hashes[at[left]] == h[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


@dataclass
class Block:
    """Bits of some units, in four rows, the bits of each nibble below each other; the rows one after the other. cells: in each hashed context.
    groups: nibbles before each unit. nibbles: as in `Tree.groups`; inside: `INSIDE` of each. absent: places without a bit, as a nibble's last ones may be."""

    units: slice
    groups: np.ndarray
    bits: np.ndarray
    nibbles: np.ndarray
    inside: np.ndarray
    cells: list[np.ndarray]
    absent: np.ndarray | None
    group: int

    def kind(self) -> np.ndarray:
        """33 times the refining context: the depth, and the group."""
        out = ((self.nibbles >> np.uint32(7)) & np.uint32(3)).astype(np.int64)
        out *= 4 * 33
        return (out + (KINDS + 33 * 16 * self.group)).ravel()

    def nodes(self) -> np.ndarray:
        return (self.inside + ((self.nibbles >> np.uint32(9)).astype(np.int64) << 4)).ravel()

    def per_unit(self, x: np.ndarray) -> np.ndarray:
        """Log probability of each unit from its bits' logits."""
        z = self.bits.astype(np.float32)
        z *= np.float32(-2)
        z += np.float32(1)
        z *= x
        np.exp(z, out=z)
        z += np.float32(1)
        np.log(z, out=z)
        if self.absent is not None:
            z[self.absent] = 0
        return -np.add.reduceat(z.reshape(4, -1).sum(0), self.groups)


class Bits:
    """Bits of a chunk's units: paths of tokens, or of the bytes of escaped words. They are made in blocks that stay in a core's cache, as a chunk's bits in all contexts would not.
    contexts: of each unit, hashed."""

    def __init__(self, tree: Tree, symbols: np.ndarray, contexts: list[np.ndarray], lay: Layout, group: int):
        self.tree, self.contexts, self.lay, self.group = tree, contexts, lay, group
        self.symbols, self.n = symbols, tree.group_lengths[symbols]

    def __len__(self) -> int:
        return int(self.tree.lengths[self.symbols].sum())

    def blocks(self) -> Iterator[Block]:
        tree, off = self.tree, np.concatenate([[0], np.cumsum(self.n)])
        cuts = np.append(np.searchsorted(off, np.arange(0, off[-1], STRETCH)), len(self.n))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if a == b:
                continue
            n = self.n[a:b]
            end = np.cumsum(n)
            at = np.repeat(tree.group_offsets[self.symbols[a:b]] - (end - n), n)
            at += np.arange(len(at))
            groups = tree.groups.take(at)
            value = (groups & np.uint32(15)).astype(np.intp)
            inside = INSIDE.take(value, axis=1)
            key = (groups >> np.uint32(9)) * np.uint32(0x85EBCA6B) + np.uint32((1, 7)[self.group])
            # the cells of a nibble stand in one line of memory
            cells = [(inside ^ self.lay.place(k, np.repeat(c[a:b], n), key).astype(np.int64)).ravel() for k, c in enumerate(self.contexts, (1, 4)[self.group])]
            absent = None if tree.whole else np.flatnonzero((((groups >> np.uint32(4)) & np.uint32(7)).astype(np.int64) <= np.arange(4)[:, None]).ravel())
            yield Block(slice(a, b), end - n, NIBBLES.take(value, axis=1).ravel(), groups, inside, cells, absent if absent is not None and len(absent) else None, self.group)


@dataclass
class Events:
    """Bits of a chunk in two groups (paths of tokens, bytes of escaped words), the places of escaped words among the tokens, and the number of bytes before each.
    seen: earlier occurrences of each token in its text."""

    bits: list[Bits]
    symbols: np.ndarray
    token_off: np.ndarray
    escaped: np.ndarray
    byte_off: np.ndarray
    seen: np.ndarray
    place: np.ndarray
    rare: np.ndarray
    rare_off: np.ndarray


class Layout:
    """Where each context's cells stand in the one table of counts."""

    def __init__(self, code: Code, p: Params, tokens: int = 0):
        bits = max(16, p.bits + int(np.ceil((np.log2(max(1, tokens)) - 24) / 2)))
        if bits > 30:  # places have 32 bits
            raise OverflowError(f"{tokens} training tokens ask for {bits} bits a context; lower Params.bits")
        down = [0, 32 - bits, 32 - bits, 32 - bits, 32 - p.small_bits, 32 - p.small_bits, 32 - p.byte_bits, 32 - p.byte_bits]
        sizes = [-(-code.n_nodes // 16) * 16, 1 << bits, 1 << bits, 1 << bits, 1 << p.small_bits, 1 << p.small_bits, 1 << p.byte_bits, 1 << p.byte_bits]
        self.begin = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        self.cells = self.begin[-1]
        self.blocks = -(-2 * self.cells // BLOCK)
        self.down = down

    def place(self, k: int, context: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Cells of 32-bit contexts and keys within them."""
        h = context ^ key
        h *= np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0xC2B2AE35)
        h >>= np.uint32(self.down[k])
        h += np.uint32(self.begin[k])
        return h


def earlier(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """How often each value stands before its place among those of the same owner."""
    # sorted by a hash of both that ends in the place; where such hashes are equal and the values aren't, by the values
    low = np.uint64(max(1, len(h).bit_length()))
    key = mix(h ^ mix(owner.astype(np.uint64) + GOLD)) >> low
    line = key << low
    line |= np.arange(len(h), dtype=np.uint64)
    line.sort()
    order = (line & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    line >>= low
    for _ in range(2):
        a, o = h[order], owner[order]
        fresh = np.ones(len(a), bool)
        fresh[1:] = (a[1:] != a[:-1]) | (o[1:] != o[:-1])
        if not (fresh[1:] & (line[1:] == line[:-1])).any():
            break
        order = np.lexsort((h, owner))
    first = np.flatnonzero(fresh)
    out = np.empty(len(h), np.int64)
    out[order] = np.arange(len(h)) - np.repeat(first, np.diff(np.concatenate([first, [len(h)]])))
    return out


def events(t: Texts, code: Code, lay: Layout, training: bool = False, spell: bool = True) -> Events:
    """training: of words that occur once two thirds are escaped, and, with spell, a few more are spelled besides."""
    low, starts, ends, off, h = word_hashes(t)
    words, docs = len(h), t.n
    token_off = off + np.arange(docs + 1)
    owner = np.repeat(np.arange(docs), np.diff(off))
    at = np.arange(words) + owner
    symbol = np.full(words + docs, code.end, np.int64)
    own = code.symbols(h)
    outside = own == code.escape
    symbol[at] = own
    # a word outside the head stands for its last two bytes in contexts
    context = symbol.copy()
    b = low.data.astype(np.int64)
    last = b[ends[outside] - 1] if words else np.zeros(0, np.int64)
    context[at[outside]] = code.escape + 1 + last * 256 + np.where(ends[outside] - starts[outside] > 1, b[np.maximum(ends[outside] - 2, 0)] if words else 0, 0)
    begin = code.escape + 1 + (1 << 16)
    place = np.arange(words + docs) - np.repeat(token_off[:-1], np.diff(token_off))
    prev, past = np.full(words + docs, begin, np.int64), np.full(words + docs, begin, np.int64)
    prev[1:] = np.where(place[1:] >= 1, context[:-1], begin)
    past[2:] = np.where(place[2:] >= 2, context[:-2], begin)
    short = lambda h: (h >> np.uint64(32)).astype(np.uint32)
    # the last two anchors before each token of the same text
    mark = code.anchor[symbol]
    first_of = np.repeat(token_off[:-1], np.diff(token_off))
    marked = np.flatnonzero(mark)
    number = np.cumsum(mark > 0) - (mark > 0)  # anchors before each token
    found = [np.zeros(words + docs, np.uint64) for _ in range(2)]
    for back, into in enumerate(found):
        some = np.flatnonzero(number > back)
        j = marked[number[some] - 1 - back]
        inside = j >= first_of[some]
        into[some[inside]] = mark[j[inside]]
    near = mix((found[0] + np.uint64(32) * found[1]) * GOLD + np.uint64(5))
    one = mix(prev.astype(np.uint64) * GOLD + np.uint64(1))
    two = mix((one ^ past.astype(np.uint64)) * GOLD + np.uint64(2))
    out = outside
    if training:
        more = code.spelled[symbol]
        symbol = code.taught[symbol]
        out = outside | (more if spell else symbol == code.escape)[at]
    paths = Bits(code, symbol, [short(near), short(one), short(two)], lay, 0)
    # bytes
    first, size = starts[out].astype(np.int32), (ends[out] - starts[out]).astype(np.int32)
    m = size + 1
    byte_off = np.concatenate([[0], np.cumsum(m)])
    step = np.arange(byte_off[-1], dtype=np.int32) - np.repeat(byte_off[:-1].astype(np.int32), m)
    src = np.repeat(first, m) + step
    text = np.concatenate([low.data, np.zeros(1, np.uint8)]).astype(np.uint32)
    value = np.where(step < np.repeat(size, m), text[src], np.uint32(32))
    past = [np.where(step >= back, text[np.maximum(src - back, 0)], np.uint32(0)) for back in (1, 2, 3)]
    a = past[0] | past[1] << np.uint32(8)
    pair = short(mix(a.astype(np.uint64) * GOLD + np.uint64(3)))
    triple = short(mix((a | past[2] << np.uint32(16)).astype(np.uint64) * GOLD + np.uint64(4)))
    begin = np.repeat(starts[out], m)
    whole = short(mix(low.hashes(begin, begin + step) + np.uint64(6)))
    single = short(mix((past[0].astype(np.uint64) | np.repeat(found[0][at[out]], m) << np.uint64(8)) * GOLD + np.uint64(7)))
    tokens = np.full(words + docs, END_HASH, np.uint64)
    tokens[at] = h
    seen = np.zeros(0, np.int64) if training and spell else earlier(tokens, np.repeat(np.arange(docs), np.diff(token_off)))  # counting has no use for them
    return Events([paths, Bits(code.bytes, value, [single, pair, triple, whole], lay, 1)], symbol, token_off, at[out], byte_off, seen, place, h[outside], np.searchsorted(np.flatnonzero(outside), off))


def count_bits(texts: DataFrame, code, lay: Layout, p: Params) -> np.ndarray:
    """Zeros and ones of each cell, over the column _text. The result has the model's fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, t in chunks(batches, "_text", p.chunk):
            if total is None:
                total = np.zeros(lay.blocks * BLOCK, np.uint32)
            e = events(t, code.value, lay, True)
            for group in e.bits:
                for b in group.blocks():
                    for c in b.cells:
                        c <<= 1
                        c += b.bits
                        np.add.at(total, c if b.absent is None else np.delete(c, b.absent), np.uint32(1))
        if total is not None:
            blocks = total.reshape(-1, BLOCK)
            some = np.flatnonzero(blocks.any(1))
            packed = [pa.compress(blocks[i].tobytes(), codec="zstd", asbytes=True) for i in some]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(packed, pa.binary())], names=["block", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = np.frombuffer(pa.decompress(cells.as_py(), 4 * BLOCK, codec="zstd", asbytes=True), np.uint32)
                total[block] = total.get(block, 0) + got.astype(np.uint64)
        for block, cells in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.minimum(cells, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary())], names=["block", "cells"])

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = texts.coalesce(p.tables * texts.sparkSession.sparkContext.defaultParallelism)  # each task sends one table, however many texts it reads
    rows = map_arrow(map_arrow(few, count, "block int, cells binary").repartition(parts, "block"), add, "block int, cells binary")
    out = np.zeros(lay.blocks * BLOCK, np.uint32)
    for r in rows.toLocalIterator():
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(bytes(r["cells"]), np.uint32)
    return out[: 2 * lay.cells].reshape(-1, 2)


def confidence(n: np.ndarray) -> np.ndarray:
    return (n > 0).astype(np.uint8) + (n > 3) + (n > 60)


def packed(counts: np.ndarray, delta: float) -> np.ndarray:
    """Logit and confidence of each cell in one 16-bit number: 512ths above the lowest two bits."""
    c = counts.astype(np.float32)
    logit = np.clip(np.log((c[:, 1] + delta) / (c[:, 0] + delta)), -15.9, 15.9)
    return (np.rint(logit * 512).astype(np.int16) << 2) | confidence(c.sum(1)).astype(np.int16)


def on_map(x: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """The map's cell of each logit. kind: 33 times the refining context."""
    at = np.clip(x, -8, 8)
    at += at
    at += np.float32(16.5)
    at = at.astype(np.int64)
    at += kind
    return at


def logits_of(found: np.ndarray) -> np.ndarray:
    out = (found >> 2).astype(np.float32)
    out *= np.float32(1 / 512)
    return out


def gate_of(c: list[np.ndarray]) -> np.ndarray:
    return (c[0] * 4 + c[1]) * 4 + c[2]


def shared(log: np.ndarray, e: Events, share: np.ndarray) -> np.ndarray:
    """Log probabilities of tokens, with their text's words so far mixed in. share: for each number of them, by its bits."""
    level = np.minimum(15, np.ceil(np.log2(e.place + 1)).astype(np.int64))
    of = share[level]
    out = log + np.log1p(-of)
    hit = np.flatnonzero((e.seen > 0) & (of > 0))
    out[hit] = np.logaddexp(out[hit], np.log(of[hit] * e.seen[hit] / e.place[hit]))
    return out


class Mixer:
    """For both groups of bits: weights of the gates for the contexts' logits and a constant, and a map of 32 contexts by 33 logits. share: of a text's own words."""

    def __init__(self):
        seen = np.stack([np.arange(GATES) // 16, np.arange(GATES) // 4 % 4, np.arange(GATES) % 4]) > 0
        w = np.stack([1 - 0.3 * seen.sum(0), *(0.3 * seen), np.zeros(GATES)], 1).astype(np.float32)
        self.w = np.stack([w, w])
        self.map = np.zeros((32, 33), np.float32)
        self.share = np.zeros(16)
        self.trained = False

    def mixed(self, group: int, logits: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        w = np.ascontiguousarray(self.w[group].T)
        x = w[CONTEXTS].take(gate)
        for k, logit in enumerate(logits):
            part = w[k].take(gate)
            part *= logit
            x += part
        return np.clip(x, -12, 12, out=x)

    def refined(self, x: np.ndarray, kind: np.ndarray) -> np.ndarray:
        if not self.trained:
            return x
        out = self.map.ravel().take(on_map(x, kind))
        out += x
        out *= np.float32(0.5)
        return out

    def settle(self, seen: np.ndarray, gained: np.ndarray) -> None:
        """The map from the logits and bits seen, the shares from what each would have gained."""
        prior = 1 / (1 + np.exp(-np.arange(-16, 17) / 2))
        self.map = np.log((seen[..., 1] + 8 * prior) / (seen[..., 0] + 8 * (1 - prior))).astype(np.float32)
        self.share = SHARES[gained.argmax(1)]
        self.trained = True


class Learner:
    """A mixer that follows the texts of a task, and what it has seen: bits by gate, bits by the map's cells, gains of the shares by the number of words."""

    def __init__(self):
        self.mixer = Mixer()
        self.grown = np.full(self.mixer.w.shape, 1e-2)
        self.nodes: np.ndarray | None = None
        self.met, self.seen, self.gained = np.zeros((2, GATES)), np.zeros((32, 33, 2)), np.zeros((16, len(SHARES)))

    def bits(self, group: int, e: Events, code: Code, less: np.ndarray, p: Params) -> np.ndarray:
        """Online steps over the bits in order; for each unit the log of what it was predicted with. less: `Model.less`."""
        w, grown = self.mixer.w[group], self.grown[group]
        out = np.zeros(len(e.bits[group].n))
        for b in e.bits[group].blocks():
            for c in b.cells:  # now places in less
                c <<= 1
                c += b.bits
            found = [less.take(c) for c in b.cells]
            logits = [logits_of(v) for v in found]
            if not group:
                if self.nodes is None:
                    self.nodes = code.less(p.delta)
                own = np.repeat(code.held[e.symbols[b.units]] * (2 * code.n_nodes), e.bits[0].n[b.units])
                logits.insert(0, self.nodes.take((((b.nodes() << 1) + b.bits).reshape(4, -1) + own).ravel()))
            # in the order of the steps and, in each, of the gates, each of which then adds up one stretch
            wide, steps = max(1, p.batch // 4), -(-len(b.nibbles) // max(1, p.batch // 4))
            gate = gate_of([v & 3 for v in found[-3:]]).astype(np.uint16 if steps * (GATES + 1) < 1 << 16 else np.int64)
            if b.absent is not None:
                gate[b.absent] = GATES  # none
            gate = gate.reshape(4, -1)
            gate += (np.arange(gate.shape[1]) // wide * (GATES + 1)).astype(gate.dtype)
            gate = gate.ravel()
            order = np.argsort(gate, kind="stable")
            sizes = np.bincount(gate, minlength=steps * (GATES + 1)).reshape(-1, GATES + 1)
            some = np.ones((CONTEXTS + 1, len(order)), np.float32)
            for k, v in enumerate(logits):
                v.take(order, out=some[k], mode="clip")
            ones, mixed, at = b.bits.take(order).astype(np.float32), np.zeros(len(order), np.float32), 0
            for row in sizes:
                on = np.flatnonzero(row[:GATES])
                size = row[on]
                step = slice(at, at + int(size.sum()))
                at += int(row.sum())
                if not len(on):
                    continue
                now = np.einsum("ij,ij->j", np.repeat(w[on].T, size, axis=1), some[:, step])
                np.clip(now, -12, 12, out=mixed[step])
                np.exp(-mixed[step], out=now)
                now += np.float32(1)
                g = np.add.reduceat(some[:, step] * (ones[step] - np.float32(1) / now), np.cumsum(size) - size, axis=1).T / size[:, None]
                grown[on] += g * g
                w[on] += (p.rate * g / np.sqrt(grown[on])).astype(np.float32)
            self.met[group] += sizes[:, :GATES].sum(0)
            x = np.empty(len(order), np.float32)
            x[order] = mixed
            at = on_map(x, b.kind())
            at += at
            at += b.bits
            self.seen += np.bincount(at if b.absent is None else np.delete(at, b.absent), minlength=self.seen.size).reshape(self.seen.shape)
            out[b.units] = b.per_unit(x)
        return out

    def take(self, e: Events, code: Code, less: np.ndarray, p: Params) -> None:
        """e: of training texts, without words that are spelled besides."""
        logs, spelled = (self.bits(g, e, code, less, p) for g in (0, 1))
        logs[e.escaped] += sums(spelled, e.byte_off)
        level = np.minimum(15, np.ceil(np.log2(e.place + 1)).astype(np.int64))
        hit = e.seen > 0
        n, lost = np.bincount(level, minlength=16), np.bincount(level, np.where(hit, 0, logs), minlength=16)
        missed = n - np.bincount(level[hit], minlength=16)
        log, ratio, of = logs[hit], e.seen[hit] / e.place[hit], level[hit]
        plain = np.exp(log)
        for k, share in enumerate(SHARES):  # as `shared` does
            won = np.log((1 - share) * plain + share * ratio) if share else log
            self.gained[:, k] += lost + missed * np.log1p(-share) + np.bincount(of, won, minlength=16)

    def packed(self) -> np.ndarray:
        """Numbers that add up over tasks."""
        return np.concatenate([(self.mixer.w * self.met[..., None]).ravel(), self.met.ravel(), self.seen.ravel(), self.gained.ravel()])

    @staticmethod
    def settled(packed: np.ndarray) -> Mixer:
        """The mixer of all tasks' numbers."""
        out = Mixer()
        sizes = np.cumsum([out.w.size, 2 * GATES, 32 * 33 * 2])
        w, met, seen, gained = np.split(packed, sizes)
        met = met.reshape(2, GATES, 1)
        out.w = np.where(met > 0, w.reshape(out.w.shape) / np.maximum(met, 1), out.w).astype(np.float32)
        out.settle(seen.reshape(32, 33, 2), gained.reshape(16, len(SHARES)))
        return out


@dataclass
class Model:
    code: Code
    lay: Layout
    counts: np.ndarray | None
    mixer: Mixer
    p: Params
    n: int = 0
    v: int = 0
    packed: np.ndarray | None = None

    def table(self) -> np.ndarray:
        if self.packed is None:
            self.packed = packed(self.counts, self.p.delta)
        return self.packed

    def less(self) -> np.ndarray:
        """`packed` of each cell without one zero, then without one: what a training bit is predicted with, its own count left out."""
        out = np.empty((len(self.counts), 2), np.int16)
        for bit in (0, 1):
            for a in range(0, len(out), 1 << 20):  # in pieces, as the driver holds the whole table
                c = self.counts[a : a + (1 << 20)].copy()
                c[:, bit] -= c[:, bit] > 0
                out[a : a + (1 << 20), bit] = packed(c, self.p.delta)
        return out.ravel()

    def logs(self, e: Events) -> list[np.ndarray]:
        """Of each token's path and of each escaped word's bytes."""
        table = self.table()
        parts = []
        for group in (0, 1):
            out = np.zeros(len(e.bits[group].n))
            for b in e.bits[group].blocks():
                found = [table.take(c) for c in ([] if group else [b.nodes()]) + b.cells]
                gate = gate_of([v & 3 for v in found[1:]]).astype(np.intp)
                x = self.mixer.mixed(group, [logits_of(v) for v in found], gate)
                out[b.units] = b.per_unit(self.mixer.refined(x, b.kind()))
            parts.append(sums(out, e.byte_off) if group else out)
        return parts

    def log10(self, e: Events) -> np.ndarray:
        token, spelled = self.logs(e)
        token[e.escaped] += spelled
        return sums(shared(token, e, self.mixer.share), e.token_off) / LN10


def fit(documents: DataFrame, keep: Column | None = None, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model, and the table of exact word counts (h, n). keep: a condition on _id that training texts meet."""
    sc = documents.sparkSession.sparkContext
    texts = documents.select(documents[id_col].alias("_id"), as_text(documents, text_col).alias("_text"))
    texts = texts if keep is None else texts.filter(keep)
    counted = park(count_words(texts.select("_text"), p))
    words = counted.filter(~F.col("byte")).select("h", "n")
    values = np.zeros(256, np.int64)
    for r in counted.filter("byte").collect():
        values[r["h"]] = r["n"]
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    end = np.int64(END_HASH)
    ends = words.filter(F.col("h") == int(end)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    head = words.filter(F.col("h") != int(end)).orderBy(F.desc("n"), "h").limit(p.head).toArrow()
    counts = head.column("n").to_numpy()
    code = Code(head.column("h").to_numpy().view(np.uint64), counts, int(ends), int(n - ends - counts.sum()), p.anchors, values)
    lay = Layout(code, p, int(n))
    held = sc.broadcast(code)  # bounded by head
    counts = count_bits(texts.select("_text"), held, lay, p)
    counts[: code.n_nodes] = code.below if n else 0
    model = Model(code, lay, counts, Mixer(), p, int(n), int(v))
    less = sc.broadcast(model.less())  # four bytes a cell

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, some = Learner(), False
        for _, t in chunks(batches, "_text", p.chunk):
            learner.take(events(t, held.value, lay, True, False), held.value, less.value, p)
            some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([learner.packed().tobytes()], pa.binary())], names=["learned"])

    # a row of some 24 kB for each of a few tasks a core
    learned = map_arrow(texts.select("_text").coalesce(p.tables * sc.defaultParallelism), train, "learned binary").collect()
    if learned and n:
        model.mixer = Learner.settled(sum(np.frombuffer(x) for x in sorted(bytes(r["learned"]) for r in learned)))  # in a fixed order, as sums of floats depend on it
    held.destroy()
    less.destroy()
    return model, words


def score(documents: DataFrame, model: Model, words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, base_score, score (log10 of the text's probability), bits_per_byte for each row."""
    model.table()
    held = documents.sparkSession.sparkContext.broadcast(replace(model, counts=None))  # two bytes a cell
    below = model.n + 0.1 * (model.v + 1)
    p = model.p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        code = m.code
        c = np.concatenate([code.counts, [0, 0]]).astype(float)
        base, known = np.log10((c + 0.1) / below), (c > 0).astype(np.int64)
        for batch, t in chunks(batches, "_text", p.chunk):
            e = events(t, code, m.lay)
            got, size = m.log10(e), np.maximum(np.diff(t.off), 1)
            value, have = base[e.symbols], known[e.symbols]
            value[e.symbols >= code.end] = 0
            # the words outside the head, each once for each text
            owner = np.repeat(np.arange(t.n), np.diff(e.rare_off))
            order = np.lexsort((e.rare, owner))
            h, d = e.rare[order], owner[order]
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            first = np.flatnonzero(fresh)
            times = np.diff(np.concatenate([first, [len(h)]]))
            off = pa.array(np.searchsorted(d[first], np.arange(t.n + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(np.diff(e.token_off)), pa.array(sums(have, e.token_off)), pa.array(sums(value, e.token_off)), pa.array(got.astype(np.float64)), pa.array(-got * LN10 / np.log(2) / size),
                 pa.ListArray.from_arrays(off, pa.array(h[first].view(np.int64))), pa.ListArray.from_arrays(off, pa.array(times.astype(np.int32)))],
                names=["_id", "n_tokens", "_known", "_base", "score", "bits_per_byte", "_h", "_n"],
            )

    kind = documents.schema[id_col].dataType.simpleString()
    src = documents.select(documents[id_col].alias("_id"), as_text(documents, text_col).alias("_text"))
    rows = map_arrow(src, run, f"_id {kind}, n_tokens long, _known long, _base double, score double, bits_per_byte double, _h array<long>, _n array<int>")
    rows = park(rows.withColumn("_row", F.monotonically_increasing_id()))
    rare = rows.select("_row", F.explode(F.arrays_zip("_h", "_n")).alias("w")).select("_row", F.col("w._h").alias("_wh"), F.col("w._n").alias("_wn"))
    rare = rare.join(words.select("h", "n"), rare["_wh"] == words["h"], "left")
    per = rare.groupBy("_row").agg(
        F.sum(F.col("_wn") * F.log10((F.coalesce("n", F.lit(0)) + 0.1) / below)).alias("_more"),
        F.sum(F.when(F.col("n") > 0, F.col("_wn")).otherwise(0)).alias("_also"),
    )
    end = words.filter(F.col("h") == int(np.int64(END_HASH))).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()[0]
    out = rows.join(per.withColumnRenamed("_row", "_r"), F.col("_row") == F.col("_r"), "left")
    return out.select(
        F.col("_id").alias(id_col), "n_tokens",
        (F.col("_known") + F.coalesce("_also", F.lit(0)) + int(end > 0)).cast("long").alias("n_known"),
        (F.col("_base") + F.coalesce("_more", F.lit(0.0)) + F.lit(float(np.log10((end + 0.1) / below)))).alias("base_score"),
        "score", "bits_per_byte",
    )
