"""A past day put right: its facts have changed after later days were run.

The difference between the new and the stored aggregates of the day is added to every stored snapshot that holds the
day, all of them in one job, instead of running each later day again. New aggregates and
snapshots are staged first and swapped in together; ``publish`` of the same staged parts finishes a swap that
was interrupted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions.dates import check_dt, day_shift
from basketlens.functions.sentiment import CHINESE, Lexicon
from basketlens.operators.history import ON_GAP, restated_snapshots
from basketlens.operators.metrics import face_metrics, goods_from_face, reputation_metrics
from basketlens.plans.backfill import backfill_results
from basketlens.plans.daily import HISTORIES, build_detail
from basketlens.plans.export import export_days
from basketlens.plans.warehouse import Warehouse
from basketlens.schemas import PARTITION, TABLES
from basketlens.sinks.publish import Staged, new_run, publish, runs_folder, stage_days


def run_of(stored: Sequence[str], dt: str, on_gap: str = "reset") -> list[str]:
    """The stored days whose snapshots are of one chain with ``dt``, itself included.

    With ``reset`` a missing day ends the chain on both sides; else all stored days are one.
    """
    if on_gap not in ON_GAP:
        raise ValueError(f"on_gap must be one of {ON_GAP}")
    if dt not in stored:
        raise ValueError(f"no snapshot of {dt}: run the day, or backfill from it on")
    if on_gap != "reset":
        return sorted(stored)
    first = last = dt
    while (before := day_shift(first, -1)) in stored:
        first = before
    while (after := day_shift(last, 1)) in stored:
        last = after
    return sorted(d for d in stored if first <= d <= last)


def _staged_rows(wh: Warehouse, name: str, run: str) -> DataFrame:
    folder = f"{runs_folder(wh.spark, wh.table(name))}/{run}"
    return wh.spark.read.schema(TABLES[name].full_ddl).orc(folder)


def stage_restated(
    wh: Warehouse, dt: str, lexicon: Lexicon = CHINESE, salts: int = 0, on_gap: str = "reset"
) -> tuple[list[Staged], list[str]]:
    """The day's new aggregates and all snapshots that hold the day, staged; and the days of these."""
    run, staged, touched = new_run(), [], [dt]

    def stage(name: str, rows: DataFrame, days: Sequence[str]) -> None:
        staged.extend(stage_days(rows, wh.table(name), days, run))

    stage("dws_face_day", face_metrics(wh.read("dwd_user_behavior", dt), salts), [dt])
    stage("dws_goods_day", goods_from_face(_staged_rows(wh, "dws_face_day", run)), [dt])
    reputation = reputation_metrics(wh.read("dwd_user_comment", dt), lexicon, salts)
    stage("dws_goods_reputation_day", reputation, [dt])
    for daily, full, keys, counters in HISTORIES:
        chain = run_of(wh.days(full), dt, on_gap)
        days = [d for d in chain if d >= dt]
        others = wh.read(daily).where(F.col(PARTITION).isin([d for d in chain if d != dt]))
        new = _staged_rows(wh, daily, run)
        stage(full, restated_snapshots(wh.read(full), wh.read(daily, dt), new, others, keys, counters, days), days)
        touched = sorted({*touched, *days})
    return staged, touched


def restate_day(
    wh: Warehouse,
    dt: str,
    lexicon: Lexicon = CHINESE,
    salts: int = 0,
    on_gap: str = "reset",
    tolerated: float = 1.0,
) -> dict[str, Mapping[str, int]]:
    """Run ``dt`` again over its loaded facts and carry the change through all later days, up to the export."""
    check_dt(dt)
    build_detail(wh, dt)
    staged, days = stage_restated(wh, dt, lexicon, salts, on_gap)
    publish(wh.spark, staged)
    backfill_results(wh, days)
    return export_days(wh, days, tolerated)
