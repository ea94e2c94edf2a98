r"""Delimited text tables: a line is a record, ``\N`` is null, an empty field is an empty string.

Lossless rule (the default). The writer never lets a separator, a line break or the escape character into a
field: they stand as ``\s``, ``\n``, ``\r`` and ``\\``. Lines are still cut at plain separators, so files
can be split anywhere between lines, and every text comes back as it was, also one that is ``\N``.

Foreign rule (``escape=None``), for text that others write. Nothing is escaped, so a text column ends at its
first separator, and only ``\N`` is special.

Under both, a line with too many fields loses the surplus, one with too few has nulls at its end, and a
number that cannot be read is null.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

Columns = tuple[tuple[str, str], ...]

ESCAPE = "\\"


def codes(separator: str, escape: str) -> dict[str, str]:
    """What stands in a field for the characters that would end it."""
    if len(separator) != 1 or len(escape) != 1 or separator == escape or {separator, escape} & set("nrsN\n\r"):
        raise ValueError("separator and escape must be two characters, none of n, r, s, N or a line break")
    return {"\n": f"{escape}n", "\r": f"{escape}r", separator: f"{escape}s"}


def _literal(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r")
    return f"'{escaped}'"


def _decoded(field: str, separator: str, escape: str) -> str:
    """Between doubled escapes the codes stand for themselves alone, so their order does not matter."""
    part = "part"
    for char, code in codes(separator, escape).items():
        part = f"replace({part}, {_literal(code)}, {_literal(char)})"
    parts = f"split({field}, {_literal(re.escape(2 * escape))}, -1)"
    return f"array_join(transform({parts}, part -> {part}), {_literal(escape)})"


def field_expressions(columns: Columns, separator: str = ",", escape: str | None = ESCAPE) -> list[str]:
    """SQL expressions of the columns over the ``value`` of a text line."""
    fields = f"split(value, {_literal(re.escape(separator))}, -1)"
    selected = []
    for position, (name, kind) in enumerate(columns):
        field = f"nullif(get({fields}, {position}), {_literal((escape or ESCAPE) + 'N')})"
        if escape:
            field = _decoded(field, separator, escape)
        if kind != "string":
            field = f"try_cast({field} AS {kind})"
        selected.append(f"{field} AS `{name}`")
    return selected


def read_delimited_text(
    spark: SparkSession,
    path: str,
    columns: Columns,
    separator: str = ",",
    escape: str | None = ESCAPE,
) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.selectExpr(*field_expressions(columns, separator, escape))
