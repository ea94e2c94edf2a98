"""Day partitions, replaced whole: writing a day again leaves the table as it was."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from basketlens.functions.dates import check_dt
from basketlens.operators.clean import align_columns
from basketlens.operators.quality import observed
from basketlens.schemas import PARTITION
from basketlens.sinks.files import remove_folder
from basketlens.sinks.publish import partitions, table_folder

_MODE = "spark.sql.sources.partitionOverwriteMode"

# Inserts under way by session, and its mode before the first of them.
_lock = Lock()
_inserts: dict[SparkSession, tuple[int, str]] = {}


@contextmanager
def _dynamic_overwrite(spark: SparkSession) -> Iterator[None]:
    """Dynamic partition overwrite for one insert.

    The session's default mode empties the whole table first, and ``insertInto`` does not
    take the mode as an option of the writer. Threads may insert at once: the last one sets the mode back.
    """
    with _lock:
        many, before = _inserts.get(spark) or (0, spark.conf.get(_MODE))
        _inserts[spark] = many + 1, before
        spark.conf.set(_MODE, "dynamic")
    try:
        yield
    finally:
        with _lock:
            many, before = _inserts.pop(spark)
            if many > 1:
                _inserts[spark] = many - 1, before
            else:
                spark.conf.set(_MODE, before)


def overwrite_day(df: DataFrame, table: str, dt: str) -> None:
    """Replace the partition ``dt`` of ``table`` by ``df``, also when ``df`` is empty.

    ``df`` has the columns of the table by name; its ``dt``, if any, is not used. It must
    not read ``table`` itself (``overwrite_days`` may).
    """
    spark = df.sparkSession
    columns = [c for c in spark.table(table).columns if c != PARTITION]
    aligned = align_columns(df.drop(PARTITION), columns)
    names = ", ".join(f"`{c}`" for c in columns)
    spark.sql(
        f"INSERT OVERWRITE TABLE {table} PARTITION ({PARTITION} = '{check_dt(dt)}')"
        f" SELECT {names} FROM {{rows}}",
        rows=aligned,
    )


def overwrite_days(df: DataFrame, table: str, rebalance: bool = False) -> None:
    """Replace those partitions of ``table`` that occur in ``df``; others are kept.

    ``rebalance`` is for many days of facts: rows are brought together by day, so that a
    task does not open a file per day, and adaptive execution splits large days and joins
    small ones to files of even size.
    """
    spark = df.sparkSession
    aligned = align_columns(df, spark.table(table).columns)
    if rebalance:
        aligned = aligned.hint("rebalance", PARTITION)
    with _dynamic_overwrite(spark):
        aligned.write.mode("overwrite").insertInto(table)


def stored_days(spark: SparkSession, table: str) -> list[str]:
    """The days that have a partition, in order; from the catalog, without a job."""
    return sorted(p.removeprefix(f"{PARTITION}=") for p in partitions(spark, table))


def drop_days(spark: SparkSession, table: str, days: Sequence[str]) -> None:
    """Take ``days`` out of ``table``, by one statement, and delete their folders."""
    if not days:
        return
    specs = ", ".join(f"PARTITION ({PARTITION} = '{check_dt(d)}')" for d in days)
    spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {specs}")
    folder = table_folder(spark, table)
    for day in days:
        # Dropping a partition of a table with a location of its own leaves the files.
        remove_folder(spark, f"{folder}/{PARTITION}={day}")


def replace_days(df: DataFrame, table: str, days: Sequence[str]) -> None:
    """Replace the partitions of all ``days`` by those of ``df``, which has no other days.

    One job: which days have rows is observed while it writes, and stored days without any are dropped after
    it. Readers find the old days until then, and a failed write leaves them.
    """
    spark = df.sparkSession
    there = set(stored_days(spark, table)) & set(days)
    written = Observation()
    overwrite_days(df.observe(written, F.collect_set(PARTITION).alias("days")), table, rebalance=True)
    drop_days(spark, table, sorted(there - set(observed(written).get("days", []))))
