"""Line sequence labelling: a linear-chain conditional random field marks each line as content or boilerplate.

Viterbi decoding gives the best labelling of a text's lines; the share of word characters that stand in content
lines decides whether the text is kept. The field is fitted here: every line of a labelled document takes the
document's quality as its (noisy) label, and the gradient of the conditional likelihood is followed for a fixed
number of steps on at most `sample_rows` documents.

Null and empty texts have one empty line and no word: they fail the base rule. Long texts are read whole; an empty table gives an empty result. Rows with equal ids are judged
each for itself, and a null id is carried through. Labellings that score alike count as content, so that without labelled
rows, where all weights are zero, the base rule alone decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import as_text, chunks, labelled_sample, map_arrow, mix, SPACE, sums, Texts

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
ENDING = np.zeros(256, bool)
ENDING[list(b".!?;:\"')")] = True
WINDOW = 8
N_FEATURES = 13


@dataclass(frozen=True)
class Params:
    """min_words, repeat_percent: base rule. content_share: least share of word characters in content lines.
    sample_rows: labelled documents to fit on, a bound. steps, rate, decay: gradient ascent."""

    min_words: int = 20
    repeat_percent: int = 30
    content_share: float = 0.5
    sample_rows: int = 3000
    steps: int = 150
    rate: float = 0.15
    decay: float = 1e-3


def base_counts(t: Texts) -> dict[str, np.ndarray]:
    starts, ends, word_off = t.spans()
    chars = t.chars()
    n_words = np.diff(word_off)
    hashes = t.hashes(starts, ends)
    owner = np.repeat(np.arange(t.n), n_words)
    flagged = np.zeros(len(starts) + 1, np.int64)
    at = np.arange(len(starts))
    at = at[at + WINDOW <= word_off[owner + 1]]
    if len(at):
        key = mix(owner[at].astype(np.uint64))
        for k in range(WINDOW):
            key = (key + hashes[at + k]) * np.uint64(0xD6E8FEB86659FD93)
        key = mix(key)
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        np.add.at(flagged, at[twice], 1)
        np.add.at(flagged, at[twice] + WINDOW, -1)
    repeated = np.cumsum(flagged[:-1]) > 0
    line_starts, line_ends, line_off = t.lines()
    first_word = np.searchsorted(starts, line_starts)
    words_in = np.searchsorted(starts, line_ends) - first_word
    line_owner = np.repeat(np.arange(t.n), np.diff(line_off))
    key = mix(t.hashes(line_starts, line_ends) + mix((line_ends - line_starts).astype(np.uint64)) + mix(line_owner.astype(np.uint64)) * np.uint64(3))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:][key[order][1:] == key[order][:-1]]] = True
    again &= words_in > 0
    return {
        "n_words": n_words,
        "word_chars": sums(chars[ends] - chars[starts], word_off),
        "n_symbols": sums(SYMBOLS[t.data].astype(np.int64), t.off),
        "n_dup_lines": sums(again.astype(np.int64), line_off),
        "n_repeat_words": sums(repeated.astype(np.int64), word_off),
        "_hashes": hashes, "_repeated": repeated, "_again": again, "_starts": starts, "_ends": ends, "_word_off": word_off,
        "_first": first_word, "_in": words_in, "_lines": (line_starts, line_ends, line_off), "_chars": chars,
    }


def line_features(t: Texts, base: dict) -> np.ndarray:
    """One row per line, each value between 0 and 1 (the first is the constant)."""
    starts, ends, line_off = base["_lines"]
    size = np.maximum(ends - starts, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(t.data) + 1, np.int64)
        np.cumsum(mask[t.data], out=total[1:])
        return (total[ends] - total[starts]) / size

    n, first = base["_in"], base["_first"]
    many = np.maximum(n, 1)
    h = base["_hashes"]
    total = lambda v: (lambda c: c[first + n] - c[first])(np.concatenate([[0], np.cumsum(v)]))
    near = np.zeros(len(h), bool)
    for back in (1, 2):
        near[back:] |= h[back:] == h[:-back]
    length = base["_ends"] - base["_starts"]
    capital = np.zeros(len(h), bool)
    if len(h):
        capital = UPPER[t.data[base["_starts"]]] & (length > 1) & UPPER[t.data[np.minimum(base["_starts"] + 1, len(t.data) - 1)]]
    last = np.zeros(len(starts), bool)
    full = ends > starts
    last[full] = ENDING[t.data[ends[full] - 1]]
    at = np.arange(len(starts)) - np.repeat(line_off[:-1], np.diff(line_off))
    return np.stack([
        np.ones(len(starts)), share(SYMBOLS) * 4, share(UPPER), share(DIGIT) * 4, 1 - share(LETTER) - share(SPACE),
        total(near) / many, total(base["_repeated"]) / many, total(capital) / many, base["_again"].astype(float),
        last.astype(float), np.minimum(n, 30) / 30, (n == 0).astype(float), np.minimum(at, 20) / 20,
    ], axis=1)


class Field:
    """weights: N_FEATURES for content against boilerplate, then the four transitions from and to (0 boilerplate, 1 content)."""

    def __init__(self, weights: np.ndarray):
        self.w, self.trans = weights[:N_FEATURES], weights[N_FEATURES:].reshape(2, 2)

    @staticmethod
    def steps(line_off: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Place, texts that have a line there (longest first), and these lines."""
        count = np.diff(line_off)
        order = np.argsort(-count, kind="stable")
        rising = np.sort(count)
        for k in range(int(count.max(initial=0))):
            docs = order[: len(count) - np.searchsorted(rising, k, "right")]
            yield k, docs, line_off[docs] + k

    def viterbi(self, features: np.ndarray, line_off: np.ndarray) -> np.ndarray:
        score = features @ self.w
        best, back = np.zeros((len(line_off) - 1, 2)), np.zeros((len(features), 2), np.int8)
        walk = list(self.steps(line_off))
        for k, docs, at in walk:
            if k:
                through = best[docs][:, :, None] + self.trans[None]
                back[at] = through[:, 1] >= through[:, 0]
                best[docs] = through.max(1)
            best[docs, 1] += score[at]
        label, state = np.zeros(len(features), np.int8), (best[:, 1] >= best[:, 0]).astype(np.int8)
        last = np.diff(line_off) - 1
        for k, docs, at in reversed(walk):
            inner = last[docs] > k
            state[docs[inner]] = back[at[inner] + 1, state[docs[inner]]]
            label[at] = state[docs]
        return label

    @classmethod
    def fit(cls, features: np.ndarray, line_off: np.ndarray, labels: np.ndarray, p: Params) -> np.ndarray:
        """labels: 0 or 1 for each line. Each class weighs as much as the other."""
        w = np.zeros(N_FEATURES + 4)
        walk = list(cls.steps(line_off))
        docs = len(line_off) - 1
        if not docs:
            return w
        kind = labels[line_off[:-1]]
        weight = np.where(kind == 1, 0.5 / max(1, (kind == 1).sum()), 0.5 / max(1, (kind == 0).sum()))
        velocity = np.zeros_like(w)
        for _ in range(p.steps):
            f = cls(w)
            score = np.stack([np.zeros(len(features)), features @ f.w], axis=1)
            ahead = np.zeros((len(features), 2))
            for k, d, at in walk:
                ahead[at] = score[at] + (np.logaddexp.reduce(ahead[at - 1][:, :, None] + f.trans[None], axis=1) if k else 0)
            behind = np.zeros((len(features), 2))
            end = line_off[1:] - 1
            for k, d, at in reversed(walk):
                on = at[at < end[d]]
                behind[on] = np.logaddexp.reduce(f.trans[None] + (score[on + 1] + behind[on + 1])[:, None, :], axis=2)
            norm = np.logaddexp.reduce(ahead[end], axis=1)
            owner = np.repeat(np.arange(docs), np.diff(line_off))
            lines = np.diff(line_off)
            each = (weight / lines)[owner]
            prob = np.exp(ahead[:, 1] + behind[:, 1] - norm[owner])
            grad = np.zeros_like(w)
            grad[:N_FEATURES] = features.T @ ((labels - prob) * each)
            inner = np.flatnonzero(np.arange(len(features)) < end[owner])
            if len(inner):
                pair = np.exp(ahead[inner][:, :, None] + f.trans[None] + (score[inner + 1] + behind[inner + 1])[:, None, :] - norm[owner[inner]][:, None, None])
                seen = np.zeros_like(pair)
                seen[np.arange(len(inner)), labels[inner], labels[inner + 1]] = 1
                grad[N_FEATURES:] = ((seen - pair) * each[inner][:, None, None]).sum(0).ravel()
            velocity = 0.9 * velocity + p.rate * 10 * (grad - p.decay * w)
            w = w + velocity * 0.1
        return w


def fit(documents: DataFrame, labels: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text", keep=None) -> np.ndarray:
    """Weights of the field, from one task over the bounded sample."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, count, kinds = [], [np.zeros(1, np.int64)], []
        for batch, t in chunks(batches, "_text"):
            base = base_counts(t)
            rows.append(line_features(t, base))
            count.append(np.diff(base["_lines"][2]))
            kinds.append(np.repeat(batch.column("_label").to_numpy(zero_copy_only=False).astype(int) == 1, count[-1]).astype(int))
        features = np.concatenate(rows) if rows else np.zeros((0, N_FEATURES))
        line_off = np.cumsum(np.concatenate(count))
        got = Field.fit(features, line_off, np.concatenate(kinds) if kinds else np.zeros(0, int), p)
        yield pa.RecordBatch.from_pydict({"w": pa.array([got.tolist()], pa.list_(pa.float64()))})

    sample = labelled_sample(documents, labels, "quality", F.lit(True) if keep is None else keep, p.sample_rows, id_col, text_col)
    got = map_arrow(sample.coalesce(1), train, "w array<double>").collect()
    return np.array(got[0][0]) if got else np.zeros(N_FEATURES + 4)


def label_lines(documents: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line: id, line number from 0, is_content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in chunks(batches, "_text"):
            base = base_counts(t)
            off = base["_lines"][2]
            label = Field(weights).viterbi(line_features(t, base), off)
            owner = np.repeat(np.arange(t.n), np.diff(off))
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(owner)), pa.array(np.arange(len(owner)) - off[owner]), pa.array(label == 1)], names=["_id", "line", "is_content"])

    src = documents.select(documents[id_col].alias("_id"), as_text(documents, text_col).alias("_text"))
    return map_arrow(src, run, f"_id {documents.schema[id_col].dataType.simpleString()}, line long, is_content boolean").withColumnRenamed("_id", id_col)


def judge(documents: DataFrame, weights: np.ndarray, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the base counts, base_failed, content_share and kept for each row."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(weights)
        for batch, t in chunks(batches, "_text"):
            base = base_counts(t)
            starts, ends, off = base["_lines"]
            label = field.viterbi(line_features(t, base), off)
            size = np.concatenate([[0], np.cumsum(base["_chars"][base["_ends"]] - base["_chars"][base["_starts"]])])
            size = size[base["_first"] + base["_in"]] - size[base["_first"]]
            share = sums(size * label, off) / np.maximum(base["word_chars"], 1)
            failed = (base["n_words"] < p.min_words) | (100 * base["n_repeat_words"] > p.repeat_percent * base["n_words"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), *(pa.array(base[c]) for c in counts), pa.array(failed), pa.array(share), pa.array(~failed & (share >= p.content_share))],
                names=["_id", *counts, "base_failed", "content_share", "kept"],
            )

    src = documents.select(documents[id_col].alias("_id"), as_text(documents, text_col).alias("_text"))
    kind = documents.schema[id_col].dataType.simpleString()
    return map_arrow(src, run, f"_id {kind}, {', '.join(f'{c} long' for c in counts)}, base_failed boolean, content_share double, kept boolean").withColumnRenamed("_id", id_col)
