import random

import pytest

#: text, source, lang: nulls, empty and long texts, ties, repeated rows, repeated lines and passages.
LONG = " ".join(f"word{i % 997} and{i % 13}" for i in range(20_000))
SHARED = "this very common line stands in many of the documents"
BENCH = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"


@pytest.fixture(scope="session")
def odd_rows():
    rng = random.Random(5)
    words = ["der", "the", "le", "casa", "Zug", "éclair", "run", "###", "12", "naïve", "it's", "x"]
    rows = [
        (0, None, "en", "a", 0), (1, "", "en", "a", 0), (2, " \t\n\n", None, None, 3), (3, LONG, "en", "b", len(LONG)),
        (4, f"{SHARED}\nshort\n  {SHARED.upper()}  \nmore", "en", None, 1), (5, f"{SHARED}\r\nother line of text here", "fr", "a", 1),
        (6, f"so {BENCH} and so on", "en", "c", 1), (7, "alpha beta gamma delta", "en", "c", 1), (8, "12345 +++ ...", "de", "c", 1),
        (9, "same text twice", "en", "a", 1), (9, "same text twice", "en", "a", 1), (None, "no id at all here", "en", "a", 1), (None, None, None, None, None),
    ]
    for i in range(10, 60):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))
        rows.append((i, text + (f"\n{SHARED}" if i % 3 == 0 else ""), rng.choice(["en", "fr", "de"]), rng.choice(["a", "b", "é"]), len(text)))
    for i in range(60, 90):  # near copies of one text
        own = ["near", "copy"] * 3 + [f"w{j}" for j in range(120)]
        own[i] = "changed"
        rows.append((i, " ".join(own), "en", "a", 1))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """With columns whose names clash with those that operators make."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, SCHEMA).repartition(5)
    for c in ("score", "size", "fp", "_id", "_text", "shard", "taken", "k1", "words", "pii"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def bench_text():
    return BENCH
