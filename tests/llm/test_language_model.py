import math
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import language_model as M
from barloom.llm.base import Texts, fold

SMALL = M.Params(head=500, bits=12, small_bits=10, byte_bits=12, sample_rows=50)


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def brute(rows, learn):
    c = Counter(t for d, text in rows if learn(d) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    out = []
    for d, text in rows:
        own = tokens(text)
        out.append((d, len(own), sum(c[t] > 0 for t in own), n, sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)))
    return out


def training(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 10 != 0


def got(df, p, keep=None):
    model, words = M.fit(df, fold("_id", 10) != 0 if keep is None else keep, p)
    out = M.score(df, model, words).collect()
    return model, [(r["doc_id"], r["n_tokens"], r["n_known"], model.n, r["base_score"]) for r in out], out


def norm(rows):
    return sorted((str(r[0]), *r[1:4], round(r[4], 6)) for r in rows)


@pytest.mark.parametrize("p", [SMALL, M.Params(bits=16)])
def test_base_equals_brute_force(spark, small, p):
    df = spark.read.parquet(f"{small}/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in df.collect()], training)
    model, rows, out = got(df, p)
    assert norm(rows) == norm(want)
    assert all(r["score"] < 0 and r["bits_per_byte"] > 0 for r in out)


def test_odd_tables(spark, odd, empty, odd_rows):
    want = brute([(r[0], r[1]) for r in odd_rows], training)
    _, rows, _ = got(odd, SMALL)
    assert norm(rows) == norm(want)
    assert got(empty, SMALL)[1] == []
    _, rows, out = got(odd, SMALL, F.lit(False))
    assert norm(rows) == norm(brute([(r[0], r[1]) for r in odd_rows], lambda d: False))
    assert all(math.isfinite(r["score"]) for r in out)


def test_weights_are_learned_from_all_training_texts(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    models = [M.fit(df, None, replace(SMALL, sample_rows=n))[0] for n in (1, 50)]
    assert all(np.array_equal(getattr(models[0].mixer, k), getattr(models[1].mixer, k)) for k in ("w", "map", "share"))
    m = models[0]
    learner, n = M.Learner(), 0
    for r in df.collect():
        e = M.events(Texts.of([r["text"] or ""]), m.code, m.lay, True, False)
        learner.take(e, m.code, m.less(), SMALL)
        n += sum(map(len, e.bits))
    assert learner.met.sum() == learner.seen.sum() == n


def test_a_training_bit_is_predicted_without_its_own_count():
    m = toy()
    less = m.less().reshape(-1, 2)
    for bit in (0, 1):
        c = m.counts.astype(int)
        c[:, bit] = np.maximum(c[:, bit] - 1, 0)
        logit = np.log((c[:, 1] + m.p.delta) / (c[:, 0] + m.p.delta))
        assert np.abs((less[:, bit] >> 2) / 512 - logit).max() <= 1 / 1024 + 1e-6
        assert (less[:, bit] & 3).tolist() == M.confidence(c.sum(1)).tolist()


def toy():
    hashes = np.sort(M.word_hashes(Texts.of(["a bb ccc dddd the"]))[4])
    code = M.Code(hashes, np.array([50, 20, 10, 5, 3]), 30, 9)
    lay = M.Layout(code, M.Params(bits=8, small_bits=8, byte_bits=8))
    model = M.Model(code, lay, np.random.default_rng(1).integers(0, 50, (lay.cells, 2)).astype(np.uint32), M.Mixer(), M.Params(bits=8, small_bits=8, byte_bits=8), 1, 1)
    model.mixer.trained = True
    model.mixer.map = np.random.default_rng(2).normal(size=(32, 33)).astype(np.float32)
    return model


def test_probabilities_sum_to_one():
    """All continuations of a text, with an escaped word as the mass of its escape, have probability one together."""
    m = toy()
    path = lambda text: float(m.logs(M.events(Texts.of([text]), m.code, m.lay))[0][0])
    assert abs(sum(math.exp(path(x)) for x in ["", "a", "bb", "ccc", "dddd", "the", "zzz"]) - 1) < 1e-4
    # what follows a first byte of an escaped word, and a text's own words with their share
    spelled = lambda text: M.events(Texts.of([text]), m.code, m.lay)
    e = spelled("zz zz a zz")
    assert e.seen.tolist() == [0, 1, 0, 2, 0] and e.place.tolist() == [0, 1, 2, 3, 4]
    m.mixer.share = np.full(16, 0.3)
    plain = np.array([-1.0, -2.0, -3.0, -4.0, -5.0])
    want = [0.7 * np.exp(-1), 0.7 * np.exp(-2) + 0.3, 0.7 * np.exp(-3), 0.7 * np.exp(-4) + 0.3 * 2 / 3, 0.7 * np.exp(-5)]
    got = M.shared(plain, e, m.mixer.share)
    assert np.allclose(got[1:], np.log(want)[1:]) and np.isclose(got[0], np.log(want[0]))


def test_code_is_complete_and_short():
    code = toy().code
    assert abs(sum(2.0 ** -int(n) for n in code.lengths) - 1) < 1e-12
    assert code.lengths[int(np.argmax(code.counts))] == code.lengths.min()
    missing = np.array([3, 1 << 63], np.uint64)
    assert (code.symbols(missing) == code.escape).all()
    assert code.symbols(code.hashes).tolist() == list(range(len(code.hashes)))


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_held_out_texts_are_likelier_than_by_the_base(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    model, words = M.fit(df, fold("_id", 10) != 0)
    held = df.filter(fold("doc_id", 10) == 0)
    score, base, plain = M.score(held, model, words).agg(F.sum("score"), F.sum("base_score"), F.avg("bits_per_byte")).first()
    assert score > base
    back = M.score(held.select("doc_id", F.reverse("text").alias("text")), model, words).agg(F.avg("bits_per_byte")).first()[0]
    assert back > plain + 0.8


def test_earlier_occurrences():
    h = np.array([5, 7, 5, 5, 7, 5], np.uint64)
    assert M.earlier(h, np.array([0, 0, 0, 1, 1, 1])).tolist() == [0, 0, 1, 0, 0, 1]


def test_score_does_not_depend_on_the_rows_around(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    model, words = M.fit(df, None, SMALL)
    one = {r["doc_id"]: r["score"] for r in M.score(df, model, words).collect()}
    two = {r["doc_id"]: r["score"] for r in M.score(df.repartition(7).orderBy(F.desc("doc_id")), model, words).collect()}
    assert all(abs(one[d] - two[d]) < 1e-6 * abs(one[d]) for d in one)


def test_places_of_large_tables_dont_wrap():
    code = type("C", (), {"n_nodes": 1000})
    with pytest.raises(OverflowError):
        M.Layout(code, M.Params(), 1 << 46)
    lay = M.Layout(code, M.Params(), 1 << 43)
    h = np.arange(1 << 16, dtype=np.uint32) * np.uint32(65521)
    for k in range(1, 8):
        at = lay.place(k, h, h[::-1].copy()).astype(np.int64)
        assert lay.begin[k] <= at.min() and at.max() < lay.begin[k + 1]
        assert (at.astype(np.int64) << 1).min() >= 0
    assert lay.begin[-1] > 1 << 31


def test_bytes_take_as_few_bits_as_they_are_frequent(spark):
    """Unknown words cost CPU by the bit: with 8 bits for each byte, most of op7's bits were those of a few words."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model, _ = M.fit(df, fold("_id", 10) != 0)
    e = M.events(Texts.of([r["text"] or "" for r in df.limit(200).collect()]), model.code, model.lay)
    assert len(e.bits[1].symbols) > 1000
    assert len(e.bits[1]) < 6 * len(e.bits[1].symbols)
    rare = M.events(Texts.of([chr(k) * 3 for k in range(0x3B1, 0x3C0)]), model.code, model.lay)
    assert np.isfinite(model.log10(rare)).all()


@pytest.mark.parametrize("n", [2, 3, 7, 16, 17, 31, 32, 100, 257])
def test_paths_are_complete_and_below_counts_what_they_hold(n):
    weight = np.random.default_rng(n).integers(1, 1000, n).tolist()
    tree = M.Tree(weight)
    assert abs(sum(2.0 ** -int(x) for x in tree.lengths) - 1) < 1e-12
    below, paths = np.zeros((tree.n_nodes, 2), np.int64), set()
    for i, w in enumerate(weight):
        path = ""
        for g in tree.groups[tree.group_offsets[i] : tree.group_offsets[i + 1]].tolist():
            at = 1
            for k in range((g >> 4) & 7):
                bit = (g >> (3 - k)) & 1
                below[(g >> 9) * 16 + at, bit] += w
                at, path = 2 * at + bit, path + str(bit)
        assert len(path) == tree.lengths[i]
        paths.add(path)
    assert len(paths) == n and not any(a != b and b.startswith(a) for a in paths for b in paths)
    used = below.sum(1) > 0
    assert (tree.below[used] == below[used]).all()


def one_by_one(m, e, group):
    """For each unit, its bits' log probabilities, one bit after the other."""
    b, out = e.bits[group], []
    tree = b.tree
    for i, symbol in enumerate(b.symbols):
        total = 0.0
        for depth, g in enumerate(tree.groups[tree.group_offsets[symbol] : tree.group_offsets[symbol + 1]].tolist()):
            node, at = g >> 9, 1
            key = np.array([node], np.uint32) * np.uint32(0x85EBCA6B) + np.uint32((1, 7)[group])
            for k in range((g >> 4) & 7):
                bit = (g >> (3 - k)) & 1
                cells = [] if group else [node * 16 + at]
                cells += [int(m.lay.place(j, c[i : i + 1], key)[0]) ^ at for j, c in enumerate(b.contexts, (1, 4)[group])]
                found = [int(v) for v in m.table()[cells]]
                gate = M.gate_of([v & 3 for v in found[1:]])
                w = m.mixer.w[group][gate]
                x = float(np.clip(sum(w[j] * (v >> 2) / 512 for j, v in enumerate(found)) + w[4], -12, 12))
                if m.mixer.trained:
                    x = (x + float(m.mixer.map[min(4 * min(depth, 3) + k, 15) + 16 * group, int(np.clip(2 * x, -16, 16) + 16.5)])) / 2
                total -= math.log1p(math.exp(-x if bit else x))
                at = 2 * at + bit
        out.append(total)
    return np.array(out)


@pytest.mark.parametrize("stretch", [1, 5, 1 << 13])
def test_blocks_equal_bits_one_by_one(monkeypatch, stretch):
    monkeypatch.setattr(M, "STRETCH", stretch)
    m = toy()
    e = M.events(Texts.of(["a bb ccc zzz dddd the", "", "the unknown w\u00f6rd a a", "q"]), m.code, m.lay)
    token, spelled = m.logs(e)
    assert np.allclose(token, one_by_one(m, e, 0), atol=1e-4)
    want = one_by_one(m, e, 1)
    assert np.allclose(spelled, [want[a:b].sum() for a, b in zip(e.byte_off[:-1], e.byte_off[1:])], atol=1e-4)


def test_earlier_occurrences_equal_brute_force():
    rng = np.random.default_rng(3)
    h, owner = rng.integers(0, 40, 5000).astype(np.uint64), np.sort(rng.integers(0, 9, 5000))
    seen, want = Counter(), []
    for pair in zip(h.tolist(), owner.tolist()):
        want.append(seen[pair])
        seen[pair] += 1
    assert M.earlier(h, owner).tolist() == want
