import random
import re
import zlib

import numpy as np
import pytest

from barloom.llm import language_id as L
from barloom.llm.base import Texts, fold


@pytest.fixture(scope="module")
def model(spark):
    return L.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), fold("_id", 4) != 2)


def test_held_out(spark, model):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = L.predict(df, model, ["doc_id", "lang"]).filter(fold("doc_id", 4) == 2).toPandas()
    assert (out.lang == out.lang_pred).mean() >= 0.97
    assert out.score.between(0, 1).all()


def test_odd_tables(spark, odd, empty, odd_rows, model):
    rows = L.predict(odd, model, ["doc_id", "text"]).collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == L.UND) == (not letters)
        assert r["lang_pred"] in [L.UND, *model.languages]
    assert L.predict(empty, model, ["doc_id"]).count() == 0
    nothing = L.fit(empty)
    assert {r["lang_pred"] for r in L.predict(odd, nothing, ["doc_id"]).collect()} == {L.UND}


def plain(text):
    """The 5-grams of a text, by its words: bytes that are neither white space, digits nor ASCII marks."""
    words = re.split(rb"[\x09-\x0D \x21-\x2F0-9:-@\[-`{-~]+", b"".join(bytes([b + 32]) if 65 <= b <= 90 else bytes([b]) for b in (text or "").encode()))
    padded = [b" " + w + b" " for w in words if w]
    return [w[i : i + 5] for w in padded for i in range(len(w) - 4)]


def brute(rows, keep, least=3, near=0.3):
    """Predicted language and score of each (id, text, lang), learned from rows whose id passes, without filters."""
    langs = sorted({l for d, _, l in rows if l is not None and keep(d)})
    size = {l: sum(1 for d, _, x in rows if x == l and keep(d)) for l in langs}
    held = {}
    for d, t, l in rows:
        if l is not None and keep(d):
            for g in set(plain(t)):
                n = held.setdefault(g, {})
                n[l] = n.get(l, 0) + 1
    member = {}
    for g, n in held.items():
        if sum(n.values()) >= least:
            best = max(c / size[l] for l, c in n.items())
            member[g] = {l for l, c in n.items() if c / size[l] >= near * best}
    out = {}
    for d, t, _ in rows:
        if not any(c.isalpha() for c in t or ""):
            out[d] = ("und", 0.0)
            continue
        count = [sum(l in member.get(g, ()) for g in plain(t)) for l in langs]
        out[d] = (langs[int(np.argmax(count))], max(count) / sum(count) if sum(count) else 0.0)
    return out


def test_equals_counting_without_filters(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in df.collect()]
    want = brute(rows, lambda d: zlib.crc32(str(d).encode()) % 4 != 2)
    got = L.predict(df, L.fit(df, fold("_id", 4) != 2, L.Params(cells=64)), ["doc_id"]).collect()
    assert len(got) == len(want)
    for r in got:
        assert r["lang_pred"] == want[r["doc_id"]][0] and abs(r["score"] - want[r["doc_id"]][1]) < 0.01


def test_a_text_without_a_known_gram_has_no_score(spark, model):
    df = spark.createDataFrame([(1, "xqzjk wvxqz zzzzzzz qqqqqqq"), (2, "the"), (None, "der und die")], "doc_id long, text string")
    out = {r["doc_id"]: r["score"] for r in L.predict(df, model, ["doc_id"]).collect()}
    assert out[1] < 0.6 and out[2] > 0 and out[None] > 0


def test_filter_has_no_false_negatives_and_few_false_positives():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 40, 30_000).astype(np.uint64)
    member = rng.random((len(keys), 11)) < 0.4
    at, lang = np.nonzero(member)
    m = L.Model.build([f"l{i:02}" for i in range(11)], keys[at], lang, L.Params(bits=17))
    for l in range(11):
        cell = m.cells[l // 8]
        bits = lambda k: np.bitwise_and.reduce([(cell[at] >> (l % 8)) & 1 for at in L.Model.places(k, len(cell).bit_length() - 1, m.p)])
        assert bits(keys[member[:, l]]).all()
        fresh = rng.integers(1 << 41, 1 << 42, 100_000).astype(np.uint64)
        assert abs(bits(fresh).mean() - m.false[l]) < 0.01


def test_grams_stay_inside_words_and_texts():
    texts = ["abc def", "", "ab", None, "x Abcd, efghi"]
    keys, off = L.grams(Texts.of(texts))
    read = [int(k).to_bytes(8, "little")[:5].decode() for k in keys]
    assert read == [" abc ", " def ", " abcd", "abcd ", " efgh", "efghi", "fghi "]
    assert off.tolist() == [0, 2, 2, 2, 2, 7]


def test_null_and_repeated_ids_are_learned_from(spark):
    rng = random.Random(11)
    words = {"en": "the quick brown foxes jumped over lazy dogs while sleeping quietly near rivers".split(), "de": "der schnelle braune fuchs springt ueber faule hunde neben breiten fluessen".split()}
    made = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(12))
    rows = [(None, made("en"), "en") for _ in range(1500)] + [(i if i % 3 else 7, made("de"), "de") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs, None, L.Params(sample_rows=300))
    out = L.predict(docs, model, ["lang"]).groupBy("lang", "lang_pred").count().collect()
    assert {(r["lang"], r["lang_pred"]) for r in out} == {("en", "en"), ("de", "de")}
