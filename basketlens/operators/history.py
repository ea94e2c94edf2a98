"""Cumulative snapshots: partition d of a history table holds all days up to d."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketlens.functions.dates import check_dt, day_shift
from basketlens.schemas import PARTITION, TableSpec

ON_GAP = ("reset", "error", "latest")


def empty_history(spark: SparkSession, spec: TableSpec) -> DataFrame:
    """The history before the first day: no rows, the table's own types."""
    return spark.createDataFrame([], spec.full_ddl)


def previous_snapshot(
    history: DataFrame, dt: str, on_gap: str = "reset", stored: Sequence[str] | None = None
) -> DataFrame:
    """The snapshot that day ``dt`` continues: the one of the day before.

    Without that partition, ``reset`` starts the history again at ``dt`` (an empty frame),
    ``latest`` continues the newest earlier snapshot, and ``error`` raises unless there is
    no earlier snapshot at all. Errors of any other kind are never taken for a first day. ``stored`` are the
    days that the history has, if known; else they are read from it.
    """
    if on_gap not in ON_GAP:
        raise ValueError(f"on_gap must be one of {ON_GAP}")
    yesterday = day_shift(dt, -1)
    if on_gap == "reset":
        return history.where(F.col(PARTITION) == yesterday)
    if stored is None:
        newest = history.where(F.col(PARTITION) < dt).agg(F.max(PARTITION)).first()[0]
    else:
        newest = max((d for d in stored if d < dt), default=None)
    if on_gap == "error" and newest is not None and newest != yesterday:
        raise ValueError(f"snapshot {yesterday} is missing; the newest before {dt} is {newest}")
    return history.where(F.col(PARTITION) == (newest or yesterday))


def advance_history(
    previous: DataFrame, day: DataFrame, keys: Sequence[str], counters: Sequence[str], dt: str
) -> DataFrame:
    """Snapshot of ``dt``: the previous snapshot plus the aggregates of the day."""
    columns = [*keys, *counters]
    both = previous.select(*columns).unionByName(day.select(*columns))
    summed = both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters])
    return summed.withColumn(PARTITION, F.lit(check_dt(dt)))


def cumulative_history(
    daily: DataFrame, keys: Sequence[str], counters: Sequence[str], dt: str
) -> DataFrame:
    """Snapshot of ``dt`` straight from the daily aggregates of all days up to it."""
    upto = daily.where(F.col(PARTITION) <= check_dt(dt))
    summed = upto.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters])
    return summed.withColumn(PARTITION, F.lit(dt))


def _runs(
    days: Sequence[str], on_gap: str, stored: Sequence[str] = ()
) -> tuple[list[tuple[str, int, int, int]], dict[str, str]]:
    """(day, position, run, last position of the run) of each run day in order, and what runs continue.

    The second is the first day of a run by the stored day whose snapshot it continues.
    """
    ordered = sorted({check_dt(d) for d in days})
    runs: list[list[str]] = []
    starts: dict[str, str] = {}
    others = set(stored) - set(ordered)
    for day in ordered:
        done = runs[-1][-1] if runs else None
        earlier = [d for d in (*others, done) if d is not None and d < day]
        newest, yesterday = max(earlier, default=None), day_shift(day, -1)
        if on_gap == "error" and newest not in (None, yesterday):
            raise ValueError(f"no run between {newest} and {day}")
        before = newest if on_gap == "latest" or newest == yesterday else None
        if before is not None and before == done:
            runs[-1].append(day)
        else:
            runs.append([day])
            if before is not None:
                starts[before] = day
    placed = []
    for number, run in enumerate(runs):
        first = len(placed)
        last = first + len(run) - 1
        placed += [(day, first + i, number, last) for i, day in enumerate(run)]
    return placed, starts


def history_snapshots(
    daily: DataFrame,
    keys: Sequence[str],
    counters: Sequence[str],
    days: Sequence[str],
    on_gap: str = "reset",
    history: DataFrame | None = None,
    stored: Sequence[str] | None = None,
) -> DataFrame:
    """The snapshots of all run ``days`` in one job instead of one job per day.

    Running sums per key give the snapshot rows of the days on which the key occurs; each
    is then carried forward to the days before the next such day. Windows hold at most one
    row per key and day, and every row made is a row of the result.

    ``history`` is what is stored already. A day continues the snapshot that ``previous_snapshot`` would
    choose for it: one of the days before it in ``days``, or a stored one of another day. ``stored`` are the days
    that the history has, if known; else they are read from it.
    """
    spark = daily.sparkSession
    if on_gap not in ON_GAP:
        raise ValueError(f"on_gap must be one of {ON_GAP}")
    columns = [*keys, *counters, PARTITION]
    if stored is None:
        stored = [] if history is None else [r[0] for r in history.select(PARTITION).distinct().collect()]
    placed, starts = _runs(days, on_gap, stored)
    daily = daily.select(*columns)
    if starts:
        begins = spark.createDataFrame(list(starts.items()), f"{PARTITION} string, _first string")
        before = history.where(F.col(PARTITION).isin(list(starts))).join(F.broadcast(begins), PARTITION)
        both = daily.unionByName(before.drop(PARTITION).withColumnRenamed("_first", PARTITION).select(*columns))
        daily = both.groupBy(*keys, PARTITION).agg(*[F.sum(c).alias(c) for c in counters])
    # One row per run day, from the caller's list: small by definition.
    calendar = F.broadcast(
        spark.createDataFrame(
            placed, f"{PARTITION} string, _pos int, _run int, _last int"
        )
    )
    in_run = Window.partitionBy("_run", *keys).orderBy("_pos")
    so_far = in_run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    changes = daily.join(calendar, on=PARTITION).select(
        *keys,
        *[F.sum(c).over(so_far).alias(c) for c in counters],
        F.col("_pos").alias("_from"),
        F.coalesce(F.lead("_pos").over(in_run) - 1, F.col("_last")).alias("_to"),
    )
    carried = changes.withColumn("_pos", F.explode(F.sequence("_from", "_to")))
    return carried.join(calendar.select("_pos", PARTITION), on="_pos").select(
        *keys, *counters, PARTITION
    )


def restated_snapshots(
    history: DataFrame,
    old: DataFrame,
    new: DataFrame,
    others: DataFrame,
    keys: Sequence[str],
    counters: Sequence[str],
    days: Sequence[str],
) -> DataFrame:
    """The snapshots of ``days`` after the aggregates of a day in all of them went from ``old`` to ``new``.

    Each key's difference is added to its row of each snapshot, in one grouping. A key that the day has anew gets
    rows; one that it has no more loses those of the snapshots up to the first of the ``others``, the
    aggregates of the chain's other days, that has it. Zero counters keep a row, as sums do.
    """
    columns = [*keys, *counters]
    gains = new.select(*columns, F.lit(1).alias("_now"), F.lit(0).alias("_was"))
    losses = old.select(
        *keys, *[(-F.col(c)).alias(c) for c in counters], F.lit(0).alias("_now"), F.lit(1).alias("_was")
    )
    change = (
        gains.unionByName(losses)
        .groupBy(*keys)
        .agg(*[F.sum(c).alias(c) for c in counters], F.max("_now").alias("_now"), F.max("_was").alias("_was"))
        .where(" OR ".join([*[f"`{c}` <> 0" for c in counters], "_now <> _was"]))
    )
    lost = change.where("_now = 0").select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    elsewhere = others.join(lost, same, "left_semi").groupBy(*keys).agg(F.min(PARTITION).alias("_first"))
    zeros = [F.lit(0).cast("long").alias(c) for c in (*counters, "_now", "_was")]
    facts = change.withColumn("_first", F.lit(None).cast("string")).unionByName(
        elsewhere.select(*keys, *zeros, "_first")
    )
    # From the caller's list of days: small by definition; every row made is one of a snapshot.
    moved = facts.withColumn(PARTITION, F.explode(F.array(*[F.lit(d) for d in days])))
    stands = history.where(F.col(PARTITION).isin(list(days))).select(
        *columns, PARTITION, F.lit(1).alias("_stands")
    )
    both = stands.unionByName(moved.withColumn("_stands", F.lit(0)), allowMissingColumns=True)
    return (
        both.groupBy(*keys, PARTITION)
        .agg(
            *[F.sum(c).alias(c) for c in counters],
            *[F.max(c).alias(c) for c in ("_stands", "_now", "_was")],
            F.min("_first").alias("_first"),
        )
        .where(
            f"_now = 1 OR (_stands = 1 AND (coalesce(_was, 0) = 0 OR coalesce(_first <= {PARTITION}, false)))"
        )
        .select(*columns, PARTITION)
    )
