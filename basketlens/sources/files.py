"""Daily fact files: comma separated, UTF-8, no header, one file or folder per run day."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.functions.dates import check_dt
from basketlens.schemas import BEHAVIOR, COMMENT, PARTITION, ddl

# Where Spark puts a record that does not fit the declared columns.
BAD_RECORD = "_corrupt_record"

Columns = tuple[tuple[str, str], ...]

# Quotes inside a quoted field are doubled; outer spaces belong to the value.
CSV_OPTIONS = {
    "header": "false",
    "sep": ",",
    "encoding": "UTF-8",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def read_daily_files(
    spark: SparkSession,
    root: str,
    columns: Columns,
    days: Sequence[str] | None = None,
    name: str = "{dt}.csv",
    mode: str = "PERMISSIVE",
    multi_line: bool = False,
) -> DataFrame:
    """Typed rows of the daily files under ``root``, with ``dt`` taken from the path.

    ``name`` is the file (or folder) name of a day. Without ``days`` every day is read.
    Types are declared, never inferred; an unreadable value is null unless ``mode`` says
    ``DROPMALFORMED`` or ``FAILFAST``; ``split_daily_files`` keeps such records apart. A name without a run day
    of eight digits raises. With ``multi_line`` a quoted text may hold line breaks; a file is then read by one
    task, so a day should be many files.
    """
    before, found, after = name.partition("{dt}")
    if not found:
        raise ValueError("the file name needs {dt}")
    root = root.rstrip("/")
    if days is None:
        paths = [f"{root}/{before}*{after}"]
    else:
        paths = [f"{root}/{name.format(dt=check_dt(d))}" for d in days]
    rows = spark.read.schema(ddl(columns)).options(mode=mode, multiLine=multi_line, **CSV_OPTIONS).csv(paths)
    in_path = rf"/{re.escape(before)}(\d{{8}}){re.escape(after)}(?:/|$)"
    stray = [f for f in rows.inputFiles() if not re.search(in_path, f)]
    if stray:
        raise ValueError(f"not a run day: {stray[:5]}")
    return rows.select(
        "*", F.regexp_extract(F.col("_metadata.file_path"), in_path, 1).alias(PARTITION)
    )


def flagged_daily_files(
    spark: SparkSession,
    root: str,
    columns: Columns,
    days: Sequence[str] | None = None,
    name: str = "{dt}.csv",
    multi_line: bool = False,
) -> DataFrame:
    """The records of the daily files; ``record`` is null, or what stands there if it cannot be read.

    Spark looks at the columns that a query names only, so a record's flag is right where all columns are in use.
    """
    kept = (*columns, (BAD_RECORD, "string"))
    rows = read_daily_files(spark, root, kept, days, name, multi_line=multi_line)
    return rows.withColumnRenamed(BAD_RECORD, "record")


def split_daily_files(
    spark: SparkSession,
    root: str,
    columns: Columns,
    days: Sequence[str] | None = None,
    name: str = "{dt}.csv",
    multi_line: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The rows of the daily files that can be read, and the others as they stand (column ``record``)."""
    rows = flagged_daily_files(spark, root, columns, days, name, multi_line)
    # The condition names all columns.
    seen = F.length(F.concat_ws("", *[F.col(n).cast("string") for n, _ in columns])) >= 0
    good = rows.where(F.col("record").isNull() & seen).drop("record")
    return good, rows.where(F.col("record").isNotNull() & seen)


def _typed(rows: DataFrame, columns: Columns, *others: str) -> DataFrame:
    return rows.select(*[F.col(n).try_cast(t).alias(n) for n, t in columns], *others, PARTITION)


def to_behavior(rows: DataFrame, *others: str) -> DataFrame:
    """File types to warehouse types: ids become strings, the time a number or null; ``others`` stay."""
    return _typed(rows, BEHAVIOR, *others)


def to_comment(rows: DataFrame, *others: str) -> DataFrame:
    return _typed(rows, COMMENT, *others)
