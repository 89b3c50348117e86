r"""Periodic runs of words by partition refinement (Crochemore).

At level L the positions of a text are in classes of equal factors of L words. A class of level L falls apart at level L + 1 by the classes of the following positions, and
only the smaller halves are used for that: of the parts into which a class fell, all but the largest tell the positions before them apart. So a position is looked at
O(log n) times. Two neighbours of a class at level L that are L apart begin a square whose root isn't a power itself, since nothing equal stands between; squares of one
period that begin side by side make a run. A neighbour's distance only grows, so each distance is held against the levels through which it stood, when it ends.

A chunk of texts is refined at once, on whole arrays: each text ends with a symbol of its own, so no factor reaches into another. Only periods up to n / `times` can make a run
long enough, so a text of n words takes no more levels than that. Words are compared by 64-bit hashes, within their text.

Words are `[^\x20\x09-\x0D]+`. A run is a stretch of consecutive words with smallest period q, at least max(`least`, `times` * q) words long, that no neighbouring word extends. Null
and empty texts and texts without a run have no runs; long texts are read whole and a task's memory is some 60 bytes for each word of its longest; repeated rows each have a row; null ids are
carried; an empty table gives an empty result; only the text and the carried columns are read, whatever else the table holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import CHUNK_BYTES, Texts, as_text, chunks, map_arrow, mix


@dataclass(frozen=True)
class Params:
    """times, least: how many periods and words a run has at least. chunk: bytes of text that are refined at once; a level costs little more for many texts than for one."""

    times: int = 4
    least: int = 6
    chunk: int = 1 << 23


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def by_keys(a: np.ndarray, b: np.ndarray, pos: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, pos) in their order; all are below n."""
    bits = int(n).bit_length()
    if 3 * bits > 63:
        at = np.lexsort((pos, b, a))
        return a[at], b[at], pos[at]
    packed = np.sort((((a.astype(np.int64) << bits) | b) << bits) | pos)
    mask = (1 << bits) - 1
    return packed >> (2 * bits), (packed >> bits) & mask, packed & mask


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin; there is at least one entry."""
    new = np.empty(len(keys[0]), bool)
    new[0] = True
    np.not_equal(keys[0][1:], keys[0][:-1], out=new[1:])
    for k in keys[1:]:
        new[1:] |= k[1:] != k[:-1]
    return new.nonzero()[0]


def sizes(first: np.ndarray, n: int) -> np.ndarray:
    """Of the parts that begin at first, up to n."""
    out = np.empty(len(first), np.int64)
    np.subtract(first[1:], first[:-1], out=out[:-1])
    out[-1] = n - first[-1]
    return out


def shifted(x: np.ndarray, by: int, end) -> np.ndarray:
    """The next (by 1) or previous (by -1) entry of each."""
    out = np.empty_like(x)
    if by > 0:
        out[:-1], out[-1] = x[1:], end
    else:
        out[1:], out[0] = x[:-1], end
    return out


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of start[i] .. start[i] + size[i] - 1."""
    total = size.cumsum()
    return np.arange(total[-1]) + (start - (total - size)).repeat(size)


class Refinement:
    """Classes of equal factors of a chunk of texts, finer level by level.

    order holds the positions class by class, start and size each class's part of it, slot a position's place. before and after link a class's positions in
    ascending order; since is the level from which a position's next one holds. found: (position, period) of squares.
    """

    def __init__(self, key: np.ndarray, most: np.ndarray):
        """key: of each position, equal for equal words of one text. most: levels that a position's text needs."""
        self.n, self.most, n = len(key), most, len(key)
        at = np.argsort(key)
        name = np.empty(n, np.int64)
        name[at] = np.cumsum(np.r_[False, key[at][1:] != key[at][:-1]])
        name, _, order = by_keys(name, np.zeros(n, np.int64), np.arange(n), n)
        first = starts_of(name)
        self.order, self.small, self.classes = order.astype(np.int32), order, len(first)
        self.cls, self.slot = np.empty(n, np.int32), np.empty(n, np.int32)
        self.cls[order], self.slot[order] = name, np.arange(n)
        self.start, self.size = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
        self.start[: len(first)], self.size[: len(first)] = first, sizes(first, n)
        self.before, self.after, self.since = np.full(n, -1, np.int32), np.full(n, -1, np.int32), np.ones(n, np.int32)
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.level = 0
        self.relink(order, name)
        self.level = 1

    def end(self, rows: np.ndarray, until: np.ndarray | int) -> None:
        """Squares of the distances that stood up to a level, before they change."""
        gap = self.after[rows] - rows  # negative where there is no next one
        hit = ((self.since[rows] <= gap) & (gap <= until)).nonzero()[0]
        if len(hit):
            self.found.append((rows[hit], gap[hit]))

    def step(self) -> None:
        """From this level to the next."""
        rows = self.small - 1
        rows = rows[rows >= 0]
        rows = rows[(self.size[self.cls[rows]] > 1) & (self.most[rows] > self.level)]
        self.small = rows[:0]
        if not len(rows):
            return
        old, by, rows = by_keys(self.cls[rows], self.cls[rows + 1], rows, self.n)
        group = starts_of(old, by)  # parts of classes
        count = sizes(group, len(rows))
        owner = starts_of(old[group])  # classes, as ranges of parts
        parts = sizes(owner, len(group))
        whose = np.arange(len(owner)).repeat(parts)
        d = old[group[owner]]
        touched = np.add.reduceat(count, owner)
        left = self.size[d] - touched
        split = (left > 0) | (parts > 1)
        if not split.any():
            return
        # the largest part of each class: what is left of it (-1), or one of the parts
        largest = np.maximum.reduceat(count, owner)
        biggest = np.full(len(owner), -1)
        is_top = ((count == largest[whose]) & (largest > left)[whose]).nonzero()[0]
        biggest[whose[is_top]] = is_top
        whole = left == 0
        keeps = np.zeros(len(group), bool)  # without a rest, the largest part keeps the class's name
        keeps[biggest[whole]] = True

        self.settle(rows, d, touched, left)
        at = self.start[d[whose]] + left[whose] + (count.cumsum() - count - (touched.cumsum() - touched)[whose])
        moves = ~keeps.repeat(count)
        gone = rows[moves]
        self.unlink(gone, old[moves], (parts > 1).any())
        fresh, kept, name = (~keeps).nonzero()[0], keeps.nonzero()[0], d[whose]
        name[fresh] = np.arange(self.classes, self.classes + len(fresh))
        self.classes += len(fresh)
        self.size[d] = left
        self.start[name[fresh]], self.size[name[fresh]] = at[fresh], count[fresh]
        self.start[name[kept]], self.size[name[kept]] = at[kept], count[kept]
        new = name.repeat(count)[moves]
        self.relink(gone, new)
        self.cls[gone] = new

        use = split[whose]
        use[biggest[biggest >= 0]] = False
        rest = (split & ~whole & (biggest >= 0)).nonzero()[0]
        self.small = rows[use.repeat(count)]
        if len(rest):
            self.small = np.concatenate([self.small, self.order[ranges(self.start[d[rest]], left[rest])]])

    def settle(self, rows: np.ndarray, d: np.ndarray, touched: np.ndarray, left: np.ndarray) -> None:
        """Bring the touched positions to the end of their classes' places, part by part; what is left trades places with them."""
        tail = self.start[d] + left
        there, bound = ranges(tail, touched), (tail - (touched.cumsum() - touched)).repeat(touched)
        slots = self.slot[rows]
        sits = slots >= tail.repeat(touched)  # touched positions that are in the tail already
        other = np.ones(len(rows), bool)
        other[(slots - bound)[sits]] = False
        free, out = slots[~sits], self.order[there[other]]  # of each class as many
        self.order[free], self.slot[out] = out, free
        self.order[there], self.slot[rows] = rows, there

    def unlink(self, rows: np.ndarray, old: np.ndarray, mixed: bool) -> None:
        """Take positions out of their classes' lists. mixed: they don't come in the order of class and position."""
        if mixed:
            _, _, rows = by_keys(old, np.zeros(len(rows), np.int64), rows, self.n)
        new = np.ones(len(rows), bool)
        np.not_equal(self.after[rows[:-1]], rows[1:], out=new[1:])
        left, right = self.before[rows[new]], self.after[rows[shifted(new, 1, True)]]
        has = left >= 0
        near = left[has]
        self.end(near, self.level)
        self.after[near], self.since[near] = right[has], self.level + 1
        has = right >= 0
        self.before[right[has]] = left[has]

    def relink(self, rows: np.ndarray, name: np.ndarray) -> None:
        """Lists of the new classes, of rows class by class in ascending order."""
        new = np.ones(len(rows), bool)
        np.not_equal(name[1:], name[:-1], out=new[1:])
        after, before = shifted(rows, 1, -1), shifted(rows, -1, -1)
        after[shifted(new, 1, True)] = -1
        before[new] = -1
        ends = rows[after != self.after[rows]]
        self.end(ends, self.level)
        self.since[ends] = self.level + 1
        self.after[rows], self.before[rows] = after, before

    def squares(self) -> tuple[np.ndarray, np.ndarray]:
        while len(self.small):
            self.step()
            self.level += 1
        self.end(np.arange(self.n), self.most)
        if not self.found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x).astype(np.int64) for x in zip(*self.found))


def hashes(t: Texts, spans: tuple) -> np.ndarray:
    """Of all words, a piece of the texts after another: the sums behind them take 30 bytes for each byte of text."""
    starts, ends, words = spans
    out, at = np.empty(len(starts), np.uint64), 0
    while at < t.n:
        to = max(at + 1, int(np.searchsorted(t.off, t.off[at] + CHUNK_BYTES, "right")) - 1)
        a, b, piece = words[at], words[to], t.data[t.off[at] : t.off[to]]
        out[a:b] = Texts(piece, t.off[at : to + 1] - t.off[at]).hashes(starts[a:b] - t.off[at], ends[a:b] - t.off[at])
        at = to
    return out


def gathered(batches: Iterator[pa.RecordBatch], text_col: str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold about `most` bytes of text."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(text_col).nbytes
        if size >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def runs_of(t: Texts, p: Params = Params()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Text, start, length and period of every run, by text, start and period; and the texts' words."""
    starts, ends, words = spans = t.spans()
    size = np.diff(words)
    off = words + np.arange(len(words))  # with an end for each text
    key = np.empty(off[-1], np.uint64)
    text = np.repeat(np.arange(t.n), size + 1)
    is_word = np.ones(len(key), bool)
    is_word[off[1:] - 1] = False
    key[is_word] = hashes(t, spans)
    key[~is_word] = np.arange(t.n).astype(np.uint64)
    salt = mix(np.arange(2 * t.n, dtype=np.uint64) + np.uint64(1))
    key = mix(key + salt[2 * text + is_word])
    at, q = Refinement(key, (size // p.times)[text].astype(np.int32)).squares()
    order = np.lexsort((at, q))
    at, q = at[order], q[order]
    new = np.ones(len(at), bool)
    new[1:] = (q[1:] != q[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(at)][: len(first)] - 1
    start, q, length = at[first], q[first], at[last] - at[first] + 2 * q[first]
    long = length >= np.maximum(p.least, p.times * q)
    start, q, length = start[long], q[long], length[long]
    order = np.lexsort((q, start))
    start, q, length = start[order], q[order], length[order]
    return text[start], start - off[text[start]], length, q, spans


def collapsed(t: Texts, spans: tuple, text: np.ndarray, start: np.ndarray, length: np.ndarray, q: np.ndarray) -> pa.Array:
    """The words that no run repeats, joined by one space."""
    starts, ends, words = spans
    n = len(starts)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, words[text] + start + q, 1)
    np.add.at(cover, words[text] + start + length, -1)
    kept = np.flatnonzero(np.cumsum(cover)[:n] == 0)
    owner = np.searchsorted(words, kept, "right") - 1
    data, edge = t.data.copy(), np.zeros(len(t.data) + 1, np.int8)
    more = np.r_[owner[1:] == owner[:-1], False][: len(kept)]  # a word that another follows has a blank behind it
    data[ends[kept[more]]] = 32
    edge[starts[kept]] += 1
    edge[ends[kept] + more] -= 1
    inside = np.cumsum(edge[:-1]) > 0
    off = np.r_[0, np.cumsum(inside)][t.off].astype(np.int32)
    return pa.Array.from_buffers(pa.string(), t.n, [None, pa.py_buffer(off), pa.py_buffer(data[inside])])


def find(documents: DataFrame, carry: list[str], p: Params = Params(), text_col: str = "text") -> DataFrame:
    """_c0, _c1 ... (the carried columns), n_words, runs (by start, then period) and collapsed (the text without repeats)."""
    names = [f"_c{i}" for i in range(len(carry))]
    src = documents.select(*[documents[c].alias(n) for c, n in zip(carry, names)], as_text(documents, text_col).alias("_text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in chunks(gathered(batches, "_text", p.chunk), "_text", p.chunk):
            text, start, length, q, spans = runs_of(t, p)
            each = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, q)], fields=list(kind.value_type))
            runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(t.n + 1)).astype(np.int32)), each, type=kind)
            cols = [batch.column(c) for c in names] + [pa.array(np.diff(spans[2])), runs, collapsed(t, spans, text, start, length, q)]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "n_words", "runs", "collapsed"])

    carried = "".join(f"{n} {documents.schema[c].dataType.simpleString()}, " for c, n in zip(carry, names))
    return map_arrow(src, run, f"{carried}n_words long, runs {RUNS}, collapsed string")


def longest(runs):
    """The run with the greatest length, of those the one that starts first, then the one with the least period; null if there is none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))
