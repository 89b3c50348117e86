import re

import numpy as np
from pyspark.sql import functions as F

from barloom.llm import quality_classifier as Q
from barloom.llm import quality_rules as R
from barloom.llm.base import Texts, fold, table


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup, at, hit = set(), 0, {}, set()
    for line in text.split("\n"):
        dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in seen
        seen.add(line)
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    for v in at.values():
        for i in v if len(v) > 1 else ():
            hit.update(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_base_counts(odd_rows):
    texts = [r[1] for r in odd_rows] + ["a\n\na\na ", "x y " * 40, "\n" * 50, "é\té\x0bé|<>"]
    b = R.base_counts(Texts.of(texts))
    for i, t in enumerate(texts):
        assert brute(t) == tuple(int(b[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(3)
    off = np.array([0, 1, 6, 6 + 9, 6 + 9 + 2])
    x, w = rng.normal(size=(off[-1], R.N_FEATURES)), rng.normal(size=R.N_FEATURES + 4)
    got, score, trans = R.Field(w).viterbi(x, off), x @ w[: R.N_FEATURES], w[R.N_FEATURES :].reshape(2, 2)
    for a, b in zip(off[:-1], off[1:]):
        def value(y):
            return sum(score[a + i] * v for i, v in enumerate(y)) + sum(trans[p, q] for p, q in zip(y, y[1:]))

        every = [[n >> i & 1 for i in range(b - a)] for n in range(1 << (b - a))]
        assert abs(value(list(got[a:b])) - max(map(value, every))) < 1e-9


def test_rules_keep_good_and_drop_bad(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    out = R.judge(docs, R.fit(docs, labels)).join(labels, "doc_id")
    assert out.filter("base_failed and kept").count() == 0
    good, bad = out.filter("quality = 1 and not base_failed"), out.filter("quality = 0")
    assert good.filter("kept").count() >= 0.97 * good.count()
    assert bad.filter("not kept").count() >= 0.95 * bad.count()


def test_rules_on_odd_tables(spark, odd, empty, odd_rows):
    labels = spark.createDataFrame([(3, 1), (8, 0), (None, 1), (5, None), (9, 1), (9, 1)], "doc_id long, quality int")
    w = R.fit(odd, labels)
    out = R.judge(odd, w)
    assert out.count() == len(odd_rows)
    assert sorted(map(str, [tuple(r)[:5] for r in out.select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()])) == sorted(str(brute(r[1])) for r in odd_rows)
    assert R.judge(empty, w).count() == 0
    assert R.label_lines(odd, w).filter("line = 0").count() == len(odd_rows)
    none = R.fit(empty, labels)
    assert R.judge(odd, none).filter("kept = base_failed").count() == 0


def test_classifier_held_out(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    w = Q.fit(docs, labels, fold("_id", 3) != 1)
    out = Q.score(docs, w).filter(fold("doc_id", 3) == 1).join(labels, "doc_id").select("score", "quality").toPandas()
    right = ((out.score >= 0.5) == (out.quality == 1)).groupby(out.quality).mean()
    assert right.min() >= 0.9
    assert out.score.between(0, 1).all()


def test_classifier_on_odd_tables(spark, odd, empty, odd_rows):
    labels = spark.createDataFrame([(3, 1), (8, 0), (None, 1), (5, None)], "doc_id long, quality int")
    w = Q.fit(odd, labels)
    assert Q.score(odd, w).filter("score between 0 and 1").count() == len(odd_rows)
    assert Q.score(empty, w).count() == 0
    assert Q.score(odd, Q.fit(empty, labels)).select(F.max("score"), F.min("score")).first() == (0.5, 0.5)


def test_classifier_learns_nothing_from_held_out_rows(spark, small):
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    other = labels.withColumn("quality", F.when(fold("doc_id", 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(Q.fit(docs, labels, fold("_id", 3) != 1), Q.fit(docs, other, fold("_id", 3) != 1))
