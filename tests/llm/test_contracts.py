"""Each registered query against its contract, from its columns alone."""

import hashlib
import math
import zlib

import pytest
from test_decontaminate import brute as hits
from test_language_model import brute as base_scores
from test_line_dedup import brute as kept_lines
from test_mixing import brute as mixed
from test_pii import base
from test_quality import brute as counts
from test_simhash import components, plain
from test_url_filter import brute as judged

from barloom.llm import queries as Q


def crc(d, n):
    return zlib.crc32(b"" if d is None else str(d).encode()) % n


@pytest.fixture(scope="module")
def docs(spark, small):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def run(spark, small):
    held = {}

    def get(name):
        if name not in held:
            held[name] = Q.QUERIES[name](spark, small).collect()
        return held[name]

    return get


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_op1(run, docs):
    out = {r["doc_id"]: r for r in run("op1_pii")}
    assert out.keys() == docs.keys()
    for d, r in out.items():
        want = base(docs[d]["text"])
        assert r["base_sha256"] == digest(",".join(want))
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x.startswith(k + ":") for x in want) for k in ("email", "ip", "card", "phone")]
        assert set(want) <= set(r["spans"].split(","))


def test_op2(run, docs):
    out = run("op2_quality_classifier")
    assert {r["doc_id"] for r in out} == docs.keys() and len(out) == len(docs)
    assert all(r["held_out"] == (crc(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)


def test_op3(run, docs):
    for r in run("op3_quality_rules"):
        n_words, *want = counts(docs[r["doc_id"]]["text"])
        assert [r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]] == [n_words, *want]
        assert r["base_failed"] == (n_words < 20 or 100 * r["n_repeat_words"] > 30 * n_words) and not (r["base_failed"] and r["kept"])


def test_op4(run, docs):
    want = {d: x for d, *x in mixed([(d, r["source"], len((r["text"] or "").encode().split())) for d, r in docs.items()])}
    got = {r["doc_id"]: [r["size"], r["source_size"], r["target"], r["taken"]] for r in run("op4_mixing")}
    assert got.keys() == want.keys()
    for d, (size, source_size, target, taken) in got.items():
        assert [size, source_size, taken] == [want[d][0], want[d][1], want[d][3]] and math.isclose(target, want[d][2])


def test_op5(run, docs):
    want = components([(d, plain(r["text"])) for d, r in docs.items()])
    assert sorted((tuple(r) for r in run("op5_simhash")), key=str) == want


def test_op6(run, docs, spark, small):
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    want = {d: (n, h, len(i.split(",")) if i else 0, digest(i), h > 0) for d, n, h, i in hits([(d, r["text"]) for d, r in docs.items()], bench)}
    assert {r["doc_id"]: tuple(r)[1:] for r in run("op6_decontaminate")} == want


def test_op7(run, docs):
    want = {d: x for d, *x in base_scores([(d, r["text"]) for d, r in docs.items()], lambda d: crc(d, 10) != 0)}
    for r in run("op7_language_model"):
        n_tokens, n_known, n, score = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(r["doc_id"], 10) == 0, n_tokens, n_known, n)
        assert math.isclose(r["base_score"], score, rel_tol=1e-9) and r["score"] < 0


def test_op8(run, spark, small):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    assert {r["page_id"]: tuple(r)[1:] for r in run("op8_url_filter")} == {p: judged(u) for p, u in urls.items()}


def test_op9(run, docs):
    assert sorted((tuple(r) for r in run("op9_line_dedup")), key=str) == kept_lines([(d, r["text"]) for d, r in docs.items()])


def test_op10(run, docs):
    out = run("op10_language_id")
    assert {r["doc_id"] for r in out} == docs.keys()
    langs = {r["lang"] for r in docs.values() if r["lang"]} | {"und"}
    assert all(r["held_out"] == (crc(r["doc_id"], 4) == 2) and r["lang_pred"] in langs and 0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["held_out"] and docs[r["doc_id"]]["lang"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.9 * len(held)
