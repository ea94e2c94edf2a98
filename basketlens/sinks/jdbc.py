"""Relational sinks."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import closing
from typing import Any

from pyspark.sql import DataFrame

from basketlens.functions.dates import check_dt
from basketlens.schemas import PARTITION


def truncate_and_insert(
    df: DataFrame,
    url: str,
    table: str,
    properties: dict[str, str] | None = None,
    channels: int = 3,
) -> None:
    """Empty the existing ``table``, keeping its definition, and fill it with ``df``.

    At most ``channels`` connections write at a time. Each task commits on its own, so a
    task that runs again after it had committed can leave rows twice; the cleaning step
    takes whole-row copies away.
    """
    (
        df.write.option("truncate", "true")
        .option("numPartitions", str(channels))
        .jdbc(url, table, mode="overwrite", properties=properties or {})
    )


def publish_statements(table: str, load_table: str, columns: list[str], dt: str) -> list[str]:
    """The two statements that swap a day of ``table`` for the rows of ``load_table``."""
    names = ", ".join(columns)
    return [
        f"DELETE FROM {table} WHERE {PARTITION} = '{check_dt(dt)}'",
        f"INSERT INTO {table} ({names}) SELECT DISTINCT {names} FROM {load_table}"
        f" WHERE {PARTITION} = '{dt}'",
    ]


def replace_day_jdbc(
    result: DataFrame,
    url: str,
    table: str,
    dt: str,
    connect: Callable[[], Any],
    properties: dict[str, str] | None = None,
    channels: int = 3,
) -> None:
    """Replace the rows of day ``dt`` in ``table`` by ``result``.

    The executors fill ``<table>_load``; a driver-side connection (``connect``, any Python
    database driver) then deletes the day and inserts the loaded rows in one transaction.
    Readers never see half a day, and a task that wrote twice does no harm, because a row
    of the day is unique by the table's key.
    """
    load_table = f"{table}_load"
    truncate_and_insert(result, url, load_table, properties, channels)
    with closing(connect()) as connection:
        try:
            cursor = connection.cursor()
            for statement in publish_statements(table, load_table, result.columns, dt):
                cursor.execute(statement)
            connection.commit()
        except Exception:
            connection.rollback()
            raise
