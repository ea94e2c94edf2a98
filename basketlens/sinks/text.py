"""Delimited text folders, emptied before they are filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.sources.text import ESCAPE, codes


def _encoded(field: Column, separator: str, escape: str) -> Column:
    text = F.replace(field.cast("string"), F.lit(escape), F.lit(2 * escape))
    for char, code in codes(separator, escape).items():
        text = F.replace(text, F.lit(char), F.lit(code))
    return F.coalesce(text, F.lit(f"{escape}N"))


def write_delimited_text(
    df: DataFrame, path: str, separator: str = ",", escape: str = ESCAPE
) -> None:
    """Replace the folder ``path`` by the rows of ``df``, one line each.

    Separators, line breaks and escapes inside a field are escaped, so that
    ``read_delimited_text`` gives every row back as it was.
    """
    fields = [_encoded(F.col(c), separator, escape) for c in df.columns]
    lines = df.select(F.concat_ws(separator, *fields).alias("value"))
    lines.write.mode("overwrite").option("lineSep", "\n").text(path)
