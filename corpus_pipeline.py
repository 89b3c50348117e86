"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, benchmark decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents; where a stage changes texts, n_chars follows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontaminate, language_id, line_dedup, mixing, near_copies
from barloom.llm.base import few, fold, park, table, unpark


def _named(docs: DataFrame, out: DataFrame, carry: list[str]) -> DataFrame:
    """The columns of docs, with the carried ones and the new text back under their names."""
    new = {c: F.col(f"_c{i}") for i, c in enumerate(carry)} | {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return out.select(*[new[c].alias(c) for c in docs.columns])


def _free(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which language ID says `und` go: null texts and texts without a letter. A text with a letter stays, also where its language
    has too few learned texts or none of its n-grams is known: then nothing is known against it. The model is fitted on the documents
    at hand, those of fold 2 of 4 by their ids left out, as op10 does."""
    model = language_id.fit(docs, fold("_id", 4) != 2)
    lang, score = _free(docs, "_lang"), _free(docs, "_score")
    out = language_id.predict(docs, model, docs.columns, names=(lang, score))
    return out.filter(F.col(lang) != language_id.UND).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in the first document that holds them. Null texts become empty; a table without rows stays so; other columns are carried, whatever their names."""
    carry = [c for c in docs.columns if c not in ("text", "n_chars")]
    return _named(docs, line_dedup.dedup(docs, line_dedup.LineIndex.build(docs), carry), carry)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies (similarity of five-word shingles from 0.8) stays, the one with
    the least id, null ids last; of its repeated rows, one."""
    groups = park(near_copies.groups(docs))
    row = ["doc_id", "text_key"]
    gone = park(groups.filter("not stays").select(*row).distinct())
    twice = park(groups.filter("stays").groupBy(*row).count().filter("count > 1").select(*row))
    unpark(groups)
    key = _free(docs, "_key")
    docs_ = docs.withColumn(key, near_copies.text_key(docs["text"]))

    mine, theirs = _free(docs, "_i"), _free(docs, "_k")

    def among(few_rows: DataFrame, how: str, of: DataFrame) -> DataFrame:
        right = few(few_rows.select(F.col("doc_id").alias(mine), F.col("text_key").alias(theirs)))
        return of.join(right, of["doc_id"].eqNullSafe(right[mine]) & (of[key] == right[theirs]), how)

    kept = among(gone, "left_anti", docs_)
    again = among(twice, "left_semi", kept)
    one = F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(key)
    first = again.groupBy(again["doc_id"].alias(mine), again[key].alias(theirs)).agg(one).select(*[F.col(key)[c].alias(c) for c in docs.columns])
    return among(twice, "left_anti", kept).select(*docs.columns).union(first)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans that the benchmark holds are cut out; documents with no word left after that go. Null texts become empty and stay; ties and
    repeated rows are each treated alike; other columns are carried, whatever their names."""
    carry = [c for c in docs.columns if c not in ("text", "n_chars")]
    out = decontaminate.search(docs, table(spark, sf_dir, "benchmark"), carry, cut=True)
    return _named(docs, out.filter((F.col("n_hit") == 0) | (F.col("n_hit") < F.col("n_words"))), carry)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents with the words that it takes of each; documents of no word are never taken. Columns are op4's, whatever else docs holds."""
    return mixing.mix(docs).filter("taken > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash", copies),
    ("decontaminate", benchmark),
    ("mixing", mix),
]

#: Language ID, SimHash and the shuffle of the mix have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, park(stage(spark, docs, sf_dir))
        unpark(before)
    return STAGES[-1][1](spark, docs, sf_dir)
