"""Text, ticker and JSON functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUFFIX = ".JK"


def normal_ticker(t: Column) -> Column:
    t = F.upper(F.trim(t))
    return F.when(t.endswith(SUFFIX), t).otherwise(F.concat(t, F.lit(SUFFIX)))


def bare_ticker(t: Column) -> Column:
    return F.replace(t, F.lit(SUFFIX), F.lit(""))


def candidates(t: Column) -> Column:
    """Forms to try with a provider: with the suffix, then without."""
    return F.array_distinct(F.array(normal_ticker(t), bare_ticker(F.upper(F.trim(t)))))


def tickers_in(message: Column) -> Column:
    """Distinct tickers that a message names, in order: words of four letters, with or without the suffix."""
    words = F.regexp_extract_all(F.upper(F.regexp_replace(message, ",", " ")), F.lit(r"[A-Z0-9.]+"), F.lit(0))
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"\.?JK$", ""))
    return F.array_distinct(F.filter(bare, lambda w: w.rlike("^[A-Z]{4}$")))


def first_code(text: Column, known: Column) -> Column:
    """The first word of four capitals that is a known code."""
    return F.get(F.filter(F.regexp_extract_all(text, F.lit(r"\b([A-Z]{4})\b"), F.lit(1)), lambda w: F.array_contains(known, w)), F.lit(0))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([_*`\[])", r"\\$1")


def cut(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def percentile_text(share: Column) -> Column:
    """share: 0 to 100."""
    return F.when(share >= 50, F.format_string("Top %d%%", F.bround(100 - share).cast("int"))).otherwise(F.format_string("Bottom %d%%", F.bround(share).cast("int")))
