"""Long messages in pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pieces(text: Column, most: int) -> Column:
    """Pieces of at most `most` characters, cut at the last newline, else the last space, else hard; newlines and spaces at a cut go. Null and empty texts are one empty piece."""
    piece = rf"(?s)\G(.{{1,{most}}}(?=\z)|.{{1,{most}}}(?=\n)|.{{1,{most}}}(?=\x20)|.{{{most}}})([\n\x20]*)"
    text = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(text, F.lit(piece), F.lit(1))
    # an empty piece ends an empty text, and one whose last cut took all that was left
    cut = F.try_element_at(F.regexp_extract_all(text, F.lit(piece), F.lit(2)), F.lit(-1))
    return F.when(F.coalesce(cut, F.lit(" ")) == "", found).otherwise(F.concat(found, F.array(F.lit(""))))


def split(df: DataFrame, text: str, most: int = 4000, out: str = "piece") -> DataFrame:
    """One row for each piece."""
    return df.select("*", F.posexplode(pieces(F.col(text), most)).alias("piece_no", out))
