"""Days of a table replaced at one stroke: staged in a folder of their run, then swapped in the catalog.

A reader plans with the location it finds, so it sees the old day or the new one, never half of it, and files of
the old run stay until ``remove_unused_runs``. A run that fails before its swap changes nothing; a swap
can be repeated.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from basketlens.functions.dates import check_dt
from basketlens.operators.clean import align_columns
from basketlens.schemas import PARTITION
from basketlens.sinks.files import remove_folder, same_folder, subfolders


class Staged(NamedTuple):
    """A partition of a table and the folder it is to have; without one it is to go."""

    table: str
    partition: tuple[tuple[str, str], ...]
    location: str | None

    @property
    def spec(self) -> str:
        return f"PARTITION ({', '.join(f'{k} = {_quoted(v)}' for k, v in self.partition)})"

    @property
    def path(self) -> str:
        """The partition as ``SHOW PARTITIONS`` names it."""
        return "/".join(f"{k}={v}" for k, v in self.partition)


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bucketed(spark: SparkSession, table: str) -> bool:
    """Whether the files of a table are buckets, which a staged folder is not."""
    return any(r["col_name"] == "Num Buckets" for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect())


def new_run() -> str:
    return uuid4().hex


def _described(spark: SparkSession, what: str) -> str:
    return next(r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {what}").collect() if r["col_name"] == "Location")


def table_folder(spark: SparkSession, table: str) -> str:
    return _described(spark, table)


def runs_folder(spark: SparkSession, table: str) -> str:
    """Where runs of ``table`` stage their days: beside its own folder."""
    return f"{table_folder(spark, table)}_runs"


def stage_days(df: DataFrame, table: str, days: Sequence[str], run: str | None = None) -> list[Staged]:
    """Write ``df`` to a folder of the run, in one job; ``publish`` makes it the ``days`` of ``table``.

    ``df`` has the columns of the table by name and no other days than these. A day without rows is staged,
    too, as an empty one.
    """
    spark = df.sparkSession
    if bucketed(spark, table):
        raise ValueError(f"{table} is bucketed; staged files are not")
    folder = f"{runs_folder(spark, table)}/{run or new_run()}"
    aligned = align_columns(df, spark.table(table).columns)
    if len(days) > 1:
        aligned = aligned.hint("rebalance", PARTITION)
    writer = aligned.write.mode("overwrite").partitionBy(PARTITION).format("orc")
    writer.option("compression", "snappy").save(folder)
    return [Staged(table, ((PARTITION, check_dt(d)),), f"{folder}/{PARTITION}={d}") for d in days]


def partitions(spark: SparkSession, table: str) -> set[str]:
    """The stored partitions by their names, ``dt=20240115``; from the catalog, without a job."""
    return {row[0] for row in spark.sql(f"SHOW PARTITIONS {table}").collect()}


def publish(spark: SparkSession, staged: Sequence[Staged]) -> None:
    """Point the partitions to what was staged for them. It can be repeated after a failure.

    A table's new partitions come by one statement, its replaced ones by one statement each, those that are
    to go by one.
    """
    for table in dict.fromkeys(s.table for s in staged):
        there = partitions(spark, table)
        mine = [s for s in staged if s.table == table]
        kept = [s for s in mine if s.location is not None]
        for s in kept:
            if s.path in there:
                spark.sql(f"ALTER TABLE {table} {s.spec} SET LOCATION {_quoted(s.location)}")
        new = " ".join(f"{s.spec} LOCATION {_quoted(s.location)}" for s in kept if s.path not in there)
        if new:
            spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {new}")
        gone = ", ".join(s.spec for s in mine if s.location is None and s.path in there)
        if gone:
            spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {gone}")
        spark.catalog.refreshTable(table)


def publish_days(df: DataFrame, table: str, days: Sequence[str], run: str | None = None) -> None:
    """Replace the ``days`` of ``table`` by ``df``, also by nothing. ``df`` may read the table."""
    publish(df.sparkSession, stage_days(df, table, days, run))


def remove_unused_runs(spark: SparkSession, table: str) -> list[str]:
    """Delete staged days that no partition points to any more; what was deleted.

    For times when no run and no long reader is under way.
    """
    there, gone = partitions(spark, table), []
    for run in subfolders(spark, runs_folder(spark, table)):
        for folder in subfolders(spark, run):
            name = folder.rsplit("/", 1)[1]
            key, _, value = name.partition("=")
            spec = f"{table} PARTITION ({key} = {_quoted(value)})"
            if name not in there or not same_folder(spark, _described(spark, spec), folder):
                remove_folder(spark, folder)
                gone.append(folder)
    return gone
