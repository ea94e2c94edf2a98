"""Cleaning of the daily facts: projection, null keys, duplicates, column order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from basketlens.schemas import PARTITION

KEYS = ["user_id", "category_id"]

# The projection defines what a duplicate is: goods, time, price and amount are left out,
# so several views of one category by one user on one device count once per day.
BEHAVIOR_COLUMNS = ["user_id", "category_id", "behavior", "sex", "address", "device"]
COMMENT_COLUMNS = ["user_id", "category_id", "comment"]


def project_behavior(behavior: DataFrame) -> DataFrame:
    return behavior.select(*BEHAVIOR_COLUMNS, PARTITION)


def project_comment(comment: DataFrame) -> DataFrame:
    return comment.select(*COMMENT_COLUMNS, PARTITION)


def drop_null_keys(facts: DataFrame) -> DataFrame:
    """Drop facts without user or category; other nulls and empty strings stay.

    Plain conditions, unlike ``na.drop``, are pushed down to the scan.
    """
    return facts.where(" AND ".join(f"{k} IS NOT NULL" for k in KEYS))


def dedup_behavior(behavior: DataFrame) -> DataFrame:
    """Distinct projected behaviours within each day, null keys dropped.

    The distinct is hashed on the whole row, so a frequent user or category spreads over
    all partitions, and copies of one row collapse before the shuffle.
    """
    return drop_null_keys(project_behavior(behavior)).dropDuplicates()


def dedup_comment(comment: DataFrame) -> DataFrame:
    """Distinct projected comments within each day, null keys dropped."""
    return drop_null_keys(project_comment(comment)).dropDuplicates()


def align_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns of a target table in its order, chosen by name.

    Inserts are positional, so a frame in another order would be stored under the wrong
    names. Missing and surplus columns are refused.
    """
    missing = [c for c in columns if c not in df.columns]
    surplus = [c for c in df.columns if c not in columns]
    if missing or surplus:
        raise ValueError(f"columns missing {missing}, not in the target {surplus}")
    return df.select(*columns)
