import re
from pathlib import Path

import corpus_pipeline as P
from pyspark.sql import functions as F
from test_decontaminate import WORD
from test_line_dedup import key
from test_mixing import brute as mixed
from test_near_copies import truth

from barloom.llm import near_copies
from barloom.llm.base import park


def lines(rows):
    holders = {}
    for d, text in rows:
        for line in text.split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(d)
    return [(d, "\n".join(x for x in text.split("\n") if not (len(key(x)) >= 10 and min(holders[key(x)]) != d))) for d, text in rows]


def cut(rows, bench, window=10):
    def places(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        return [(m[0], m.start(), m.end()) for m in WORD.finditer(low)]

    found = set()
    for text in bench:
        w = [x[0] for x in places(text)]
        found |= {tuple(w[i : i + window]) for i in range(max(1, len(w) - window + 1))} if w else set()
    out = []
    for d, text in rows:
        w, hit = places(text), set()
        for n in {len(f) for f in found}:
            for i in range(len(w) - n + 1):
                if tuple(x[0] for x in w[i : i + n]) in found:
                    hit |= set(range(i, i + n))
        for i in sorted(hit, reverse=True):
            end = w[i + 1][1] if i + 1 in hit else w[i][2]
            text = text[: w[i][1]] + text[end:]
        if not hit or len(hit) < len(w):
            out.append((d, text))
    return out


def test_each_stage_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, stages = docs.columns, dict(P.STAGES)
    rows = lambda df: sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())
    bench = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    plainly = {
        "language_id": lambda x: [(d, t) for d, t in x if re.search(r"[^\W\d_]", t)],
        "line_dedup": lines, "decontaminate": lambda x: cut(x, bench),
    }
    for name, stage in P.STAGES[:-1]:
        before = rows(docs)
        docs = park(stage(spark, docs, sf))
        assert docs.columns == columns
        if name in plainly:
            assert rows(docs) == sorted(plainly[name](before)), name
        else:
            groups = truth(before, 0.8)
            assert rows(docs) == [(d, t) for d, t in before if groups[d] == d]
        assert docs.filter("n_chars <> length(text)").count() == 0
    last = stages["mixing"](spark, docs, sf)
    sizes = [(r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))) for r in docs.collect()]
    assert {r["doc_id"]: r["taken"] for r in last.collect()} == {d: t for d, _, _, _, t in mixed(sizes) if t}


def test_odd_tables_pass_all_stages(spark, odd_rows, small):
    docs = spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in P.STAGES[:-1]:
        docs = park(stage(spark, docs, small))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = [r["doc_id"] for r in docs.collect()]
    assert ids.count(9) == 1 and {0, 1, 2, 8}.isdisjoint(ids) and len([i for i in ids if i is not None and i >= 60]) == 1
    assert P.STAGES[-1][1](spark, docs, small).count() > 0


def test_empty_tables_pass_all_stages(spark, empty, small):
    docs = empty
    for _, stage in P.STAGES:
        docs = park(stage(spark, docs, small))
        assert docs.count() == 0


def test_rare_languages_and_new_words_stay(spark, small):
    rows = [(i, f"these are plain english words number {i % 7} of the corpus", "en") for i in range(400)]
    rows += [(400, "dies ist ein deutscher satz", "de"), (401, "una frase corta en castellano", "es"), (402, "zzyzx qwrtp", None), (403, "12 34", "en"), (404, None, "en")]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in P.language(spark, docs, small).collect()) == list(range(403))


def test_clashing_columns_are_carried(spark, odd_rows, small):
    names = ["_key", "_lang", "_score", "_once", "_i", "_k", "_c0", "_text", "_id", "_bucket", "_KEY_"]
    docs = spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string, n_chars long")
    for i, c in enumerate(names):
        docs = docs.withColumn(c, F.lit(f"own {i}"))
    columns = docs.columns
    for _, stage in P.STAGES[:-1]:
        docs = park(stage(spark, docs, small))
        assert docs.columns == columns and docs.count() > 0
        assert docs.select(*names).distinct().collect() == [tuple(f"own {i}" for i in range(len(names)))]
    assert P.STAGES[-1][1](spark, docs, small).count() > 0


def test_tables_between_stages_go_once_read(spark, small, monkeypatch):
    """When a stage begins, only its own input of the tables between stages is left."""
    seen = []

    def stage(spark, docs, sf_dir):
        seen.append([Path(x.split(":", 1)[1]) for x in docs.inputFiles()])
        assert all(x.exists() for x in seen[-1]) and not any(x.exists() for files in seen[1:-1] for x in files)
        return docs.filter("doc_id % 7 > 0")

    monkeypatch.setattr(P, "STAGES", [(str(i), stage) for i in range(4)])
    assert P.run(spark, small).count() > 0 and len(seen) == 4
