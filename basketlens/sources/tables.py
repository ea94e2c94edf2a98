"""Scans of warehouse tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.functions.dates import check_dt
from basketlens.schemas import PARTITION, TABLES


def read_partition(
    spark: SparkSession, table: str, dt: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """One run day of a table; only its folder is read (``PartitionFilters``)."""
    day = spark.table(table).where(F.col(PARTITION) == check_dt(dt))
    return day if columns is None else day.select(*columns)


def read_dimension(
    spark: SparkSession, table: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """A whole dimension, or a subset of its columns."""
    whole = spark.table(table)
    return whole if columns is None else whole.select(*columns)


def read_result(spark: SparkSession, table: str, dt: str) -> DataFrame:
    """One day of a result table as its export sees it: columns in order, ranks as long.

    ``dt`` comes from the partition folder; the files do not hold it.
    """
    spec = TABLES[table.rsplit(".", 1)[-1]]
    day = read_partition(spark, table, dt, spec.all_columns)
    ints = [name for name, kind in spec.columns if kind == "int"]
    return day.withColumns({name: F.col(name).cast("bigint") for name in ints})


_BUCKETING = "spark.sql.sources.bucketing.enabled"


@contextmanager
def unbucketed_scans(spark: SparkSession) -> Iterator[None]:
    """Read bucketed tables as plain files in the jobs that run inside.

    A bucket is one task, whatever its size: right for one day, not for many at once.
    """
    before = spark.conf.get(_BUCKETING)
    spark.conf.set(_BUCKETING, "false")
    try:
        yield
    finally:
        spark.conf.set(_BUCKETING, before)
