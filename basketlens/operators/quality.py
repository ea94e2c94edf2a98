"""Checks of the results before they leave the warehouse."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

#: What the gate says of a row.
VERDICT, GOOD, NULL_KEY, REPEATED_KEY = "verdict", "good", "null_key", "repeated_key"
REASONS = (NULL_KEY, REPEATED_KEY)


def observed(observation: Observation) -> Mapping[str, Any]:
    """What was observed by the job that is done; nothing if the plan was known to have no rows.

    The optimizer takes such a plan out together with what observes it.
    """
    try:
        return observation.get
    except Py4JJavaError as error:
        if "AssertionError" not in str(error.java_exception):
            raise
        return {}


def _null_key(key: Sequence[str]) -> Column:
    has_null = F.lit(False)
    for column in key:
        has_null = has_null | F.col(column).isNull()
    return has_null


def gated(result: DataFrame, key: Sequence[str]) -> DataFrame:
    """``result`` with a verdict on each row: good, or why the export would refuse it.

    A key with a null part is refused. Of the rows of one key the first, by all columns, is good and the
    others are refused. Rows with a null key are spread by their values, so many of them fill no task.
    """
    has_null = _null_key(key)
    spread = F.when(has_null, F.xxhash64(*result.columns))
    number = F.row_number().over(Window.partitionBy(*key, spread).orderBy(*result.columns))
    verdict = F.when(has_null, F.lit(NULL_KEY)).when(number > 1, F.lit(REPEATED_KEY)).otherwise(F.lit(GOOD))
    return result.withColumn(VERDICT, verdict)


def verdict_counts() -> list[Column]:
    """Aggregates for ``DataFrame.observe``: rows by verdict, counted by the job that writes them."""
    return [F.count_if(F.col(VERDICT) == F.lit(v)).alias(v) for v in (GOOD, *REASONS)]


class TooManyRejects(ValueError):
    """More rows were refused than is tolerated; nothing was published."""


def check_share(what: str, counts: Mapping[str, int], tolerated: float) -> None:
    """Raise if the refused rows are a larger share of all than ``tolerated``."""
    bad = sum(n for verdict, n in counts.items() if verdict != GOOD)
    if bad > tolerated * sum(counts.values()):
        raise TooManyRejects(f"{what}: {dict(counts)}, tolerated share {tolerated}")


def export_key_violations(result: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that the export table would refuse, with their number of rows.

    The target declares ``key`` as primary key: ``null_key`` marks keys with a null part,
    the others occur more than once. An empty result means that the export fits.
    """
    counted = result.groupBy(*key).agg(F.count(F.lit(1)).alias("row_count"))
    return counted.withColumn("null_key", _null_key(key)).where(
        F.col("null_key") | (F.col("row_count") > 1)
    )


def export_violations(results: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """``export_key_violations`` of many exports, each a result and its key, by one grouping.

    Columns are ``export``, all key columns (null where an export's key has them not), row_count, null_key.
    """
    columns = sorted({(c, result.schema[c].dataType.simpleString()) for result, key in results.values() for c in key})
    whole = None
    for export, (result, key) in results.items():
        parts = [F.col(c) if c in key else F.lit(None).cast(kind).alias(c) for c, kind in columns]
        part = result.select(F.lit(export).alias("export"), *parts, _null_key(key).alias("null_key"))
        whole = part if whole is None else whole.unionByName(part)
    counted = whole.groupBy("export", *[c for c, _ in columns]).agg(
        F.count(F.lit(1)).alias("row_count"), F.bool_or("null_key").alias("null_key")
    )
    return counted.where(F.col("null_key") | (F.col("row_count") > 1))
