"""Tables in HTML pages, read with SQL functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A tag's name, then anything up to its end; attributes may hold quoted text.
_TAG = r"(?is)<{0}(?:\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*)?>"


def first_table(html: Column) -> Column:
    """What stands inside the first table, up to its end, without comments; the end of a table inside a cell counts as well, null where there is none."""
    found = F.regexp_extract(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), _TAG.format("table") + r"(.*?)</table\s*>", 1)
    return F.when(found != "", found)


def plain(cell: Column) -> Column:
    """A cell's text: without tags, entities of the common signs resolved, blanks run together."""
    text = F.regexp_replace(cell, r"(?s)</?[A-Za-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _rest(items: Column) -> Column:
    """All but the first, however many."""
    return F.filter(items, lambda x, i: i > 0)


def _held(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once for each row, not once for each element that looks at it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def cells(table: Column) -> Column:
    """An array of rows, each an array of texts. Rows without a cell are left out; end tags of rows and cells may be missing."""
    return F.filter(F.transform(_rest(F.split(table, _TAG.format("tr"))), lambda r: F.transform(_rest(F.split(r, _TAG.format("t[hd]"))), plain)), lambda r: F.size(r) > 0)


def codes(html: Column) -> Column:
    """Listed codes of a page's first table: the column whose heading has `kode` or `simbol` in it, else the first; a leading `BEI:` goes; four letters, as tickers of the
    exchange. Distinct, in order of appearance; null without a table."""
    def below(grid: Column) -> Column:
        heading = F.transform(F.get(grid, F.lit(0)), lambda h: F.lower(h).rlike("kode|simbol"))
        return _held(F.greatest(F.array_position(heading, True) - 1, F.lit(0)).cast("int"), lambda at: found(_rest(grid), at))

    def found(rows: Column, at: Column) -> Column:
        values = F.transform(rows, lambda r: F.trim(F.regexp_replace(F.coalesce(F.get(r, at), F.lit("")), "(?i)^BEI:", "")))
        return F.array_distinct(F.transform(F.filter(values, lambda v: v.rlike(r"^\p{L}{4}$")), lambda v: F.concat(v, F.lit(".JK"))))

    return _held(cells(first_table(html)), below)
