"""Grouped aggregation in one phase, or in two phases against hot keys."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SALT = "_salt"


@dataclass(frozen=True)
class Measure:
    """A named aggregate that can be combined from partial results."""

    name: str
    kind: str
    column: Column | None = None

    def partial(self) -> Column:
        source = F.lit(1) if self.column is None else self.column
        return _function(self.kind)(source).alias(self.name)

    def combine(self) -> Column:
        """The same measure over partial results; counts add up."""
        kind = "sum" if self.kind in ("count", "count_if") else self.kind
        return _function(kind)(F.col(self.name)).alias(self.name)


def _function(kind: str):
    functions = {
        "sum": F.sum,
        "count": F.count,
        "count_if": F.count_if,
        "min": F.min,
        "max": F.max,
    }
    return functions[kind]


def aggregate(
    df: DataFrame, keys: Sequence[str], measures: Sequence[Measure], salts: int = 0
) -> DataFrame:
    """Group ``df`` by ``keys``; with ``salts`` > 1 in two phases.

    Spark already combines these measures before its shuffle, so every task sends one row
    per key and the plain form (``salts=0``) is the default. The salted form is for a key
    that is hot even then, as with very many map tasks: the first phase groups by (salt,
    keys), the second adds the salts up.

    The salt is the number of the map partition modulo ``salts``. A task therefore still
    sends one row per key, and a task that runs again after a lost executor draws the same
    salt, which a random salt would not. Keys are not edited: the salt is its own column.
    """
    if salts <= 1:
        return df.groupBy(*keys).agg(*[m.partial() for m in measures])
    salted = df.withColumn(_SALT, F.pmod(F.spark_partition_id(), F.lit(salts)))
    partial = salted.groupBy(_SALT, *keys).agg(*[m.partial() for m in measures])
    return partial.groupBy(*keys).agg(*[m.combine() for m in measures])
