"""Every query with an equivalent in SQL gives DuckDB's result on the smallest tables."""

import math

import duckdb
import pytest

from barloom import catalog as registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"
NAMES = list({id(registry.QUERIES[k]): k for k in reversed(registry.ORACLE_SQL)}.values())


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if v is None or str(v) in ("NaT", "<NA>", "nan"):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 5) + 0.0
    return str(v).removesuffix(" 00:00:00")


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in r) for r in frame.astype(object).itertuples(index=False)), key=str)


def close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-7, abs_tol=2e-5))


@pytest.mark.parametrize("name", sorted(NAMES))
def test_equals_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert all(close(x, y) for r, s in zip(a, b) for x, y in zip(r, s))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_others_run(spark, name):
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0


@pytest.mark.parametrize("name", ["AGG-09", "AGG-10"])
@pytest.mark.parametrize("counts", [[], [4, 9], [9, 12], [0, 10]])
def test_measures_of_few_signals_equal_sql(spark, monkeypatch, name, counts):
    """Folds of too few signals have no value: with none, with some and with no other fold beside them."""
    sig = [(f + 1, (i % 5 - 1) / 50) for f, n in enumerate(counts) for i in range(n)]
    frame = spark.createDataFrame(sig, "fold int, return_n3 double")
    monkeypatch.setattr("barloom.registry.signals", lambda spark, sf: frame)
    con = duckdb.connect()
    con.sql("CREATE TABLE sig (fold INTEGER, return_n3 DOUBLE)")
    if sig:
        con.executemany("INSERT INTO sig VALUES (?, ?)", sig)
    sql = registry.ORACLE_SQL[name]
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(con.sql("WITH " + sql[sql.index("perfold AS (") :]).df())


def test_overall_lists_its_folds(spark, monkeypatch):
    frame = spark.createDataFrame([(f, 0.01 * f) for f, n in ((1, 12), (3, 7), (5, 2)) for _ in range(n)], "fold int, return_n3 double")
    monkeypatch.setattr("barloom.registry.signals", lambda spark, sf: frame)
    got = registry.QUERIES["AGG-09"](spark, SF).first().asDict()
    assert [got[f"ev_fold_{i}"] for i in range(1, 6)] == [0.006, None, None, None, None]
    assert [got[f"win_rate_fold_{i}"] for i in range(1, 6)] == [0.0, None, 1.0, None, None]
    assert not any("_fold_" in c for c in registry.QUERIES["AGG-10"](spark, SF).columns)
