"""Run days are ``yyyyMMdd`` strings, in parameters and in the partition column."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_FORMAT = "yyyyMMdd"


def check_dt(dt: str) -> str:
    """Return ``dt`` if it is a calendar day written ``yyyyMMdd``, else raise."""
    if not (isinstance(dt, str) and len(dt) == 8 and dt.isdigit()):
        raise ValueError(f"not a yyyyMMdd day: {dt!r}")
    datetime.strptime(dt, "%Y%m%d")
    return dt


def day_shift(dt: str, days: int) -> str:
    """The run day ``days`` after ``dt`` (before it when negative)."""
    moved = datetime.strptime(check_dt(dt), "%Y%m%d") + timedelta(days=days)
    return moved.strftime("%Y%m%d")


def previous_day(dt: Column) -> Column:
    """The day before, for a column of run days."""
    return F.date_format(F.date_sub(F.to_date(dt, DAY_FORMAT), 1), DAY_FORMAT)


def day_of(ts: Column) -> Column:
    """The run day of an event time."""
    return F.date_format(ts, DAY_FORMAT)
