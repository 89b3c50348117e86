"""Reports from small results: pages for a backtest and for diagnostics, and lines for a scan."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escaped


def page(title: str, tables: dict[str, DataFrame], most: int = 500) -> str:
    """An HTML page with one table for each named result; results are small, `most` bounds what the driver takes."""
    out = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        rows = df.limit(most).collect()
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows)
        out.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    return "".join(out) + "</body></html>"


def signal_lines(signals: DataFrame) -> DataFrame:
    """Bullish signals with returns as percentages, for a CSV file."""
    percent = [F.format_string("%.2f%%", 100 * F.col(c)).alias(c) for c in signals.columns if c.startswith("return_")]
    return signals.filter("signal = 'BULLISH'").select("fold", "ticker", "date", "score", *[F.when(F.col(c).isNotNull(), x).alias(c) for c, x in zip([c for c in signals.columns if c.startswith("return_")], percent)])


def write_signals(signals: DataFrame, path: str) -> None:
    """Bullish signals as CSV files that spreadsheets take for UTF-8: the heading of each begins with a byte-order mark."""
    lines = signal_lines(signals)
    first, *others = lines.columns
    lines.select(F.col(first).alias("\ufeff" + first), *others).write.mode("overwrite").option("header", True).csv(path)


def opinion_lines() -> dict[str, Column]:
    """A result's opinion for a chat (marks escaped, bold headline) and for a terminal: headline with its level, then a line for each unusual tag."""
    head = F.concat_ws(" ", F.concat("ticker", F.lit(":")), "headline")
    bullets = lambda b, marks: F.array_join(F.transform("unusual_tags", lambda t: F.concat(F.lit(b), escaped(t) if marks else t)), "")
    return {
        "chat": F.concat(F.lit("*"), escaped(head), F.lit("* "), F.concat(F.lit("("), "level", F.lit(")")), bullets("\n- ", True)),
        "terminal": F.concat(F.lit("  "), head, F.lit(" ["), "level", F.lit("]"), bullets("\n     - ", False)),
    }


def scan_line() -> Column:
    """A line for each scan result: ticker, level, tags."""
    return F.concat_ws(" | ", "ticker", F.format_string("close %.0f", "close"), "level", F.array_join("unusual_tags", ", "), "liquidity_note")
