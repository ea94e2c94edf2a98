"""Job file for spark-submit: ``jobs.py DT --root FOLDER [--through DT] [--steps load detail ...]``.

Each step replaces the days' partitions of its tables, so a failed step can be submitted again, alone or with those
after it. ``--through`` runs all days up to another one, each step as one job per table. ``--restate`` is for a
day in the past: it carries the change through the snapshots and results of all later days.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from basketlens.functions.dates import check_dt, day_shift
from basketlens.plans import (
    Warehouse,
    backfill_detail,
    backfill_history,
    backfill_metrics,
    backfill_results,
    build_detail,
    build_history,
    build_metrics,
    build_results,
    export_days,
    load_files,
    restate_day,
)
from basketlens.schemas import TABLES
from basketlens.sources.text import read_delimited_text

STEPS = ("load", "detail", "metrics", "history", "results", "export")


def load_dimensions(wh: Warehouse, face_path: str | None, category_path: str | None) -> None:
    """Replace the dimensions by delimited files, through their text tables."""
    for path, staging, table in (
        (face_path, "face", "ods_user_face_full"),
        (category_path, "category", "ods_category_mapping_full"),
    ):
        if path is not None:
            # A file of others: nothing in it is escaped.
            rows = read_delimited_text(wh.spark, path, TABLES[staging].columns, escape=None)
            wh.write_text(staging, rows)
            wh.load_dimension(table, staging)


def load_facts(
    wh: Warehouse, days: Sequence[str], behavior_root: str, comment_root: str, tolerated: float = 0.0
) -> None:
    """Load the daily files ``<root>/<dt>.csv`` into their partitions; ``tolerated`` bounds the unreadable share."""
    for name, root in (("user_behavior_inc", behavior_root), ("user_comment_inc", comment_root)):
        counts = load_files(wh, name, root, days, tolerated=tolerated)
        print(f"{name}: {counts}")


def parser() -> argparse.ArgumentParser:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("dt", type=check_dt, help="run day, yyyyMMdd")
    args.add_argument("--through", type=check_dt, help="last day of a backfill that begins with the run day")
    args.add_argument("--restate", action="store_true", help="the run day is past: put later days right, too")
    args.add_argument("--root", required=True, help="warehouse folder that all executors see")
    args.add_argument("--prefix", default="", help="prefix of the database names")
    args.add_argument("--steps", nargs="+", choices=STEPS, default=list(STEPS))
    args.add_argument("--behavior-files", help="folder of <dt>.csv, for load")
    args.add_argument("--comment-files", help="folder of <dt>.csv, for load")
    args.add_argument("--face-file", help="also load this dimension file")
    args.add_argument("--category-file", help="also load this dimension file")
    args.add_argument("--salts", type=int, default=0, help="parts of a two-phase aggregation")
    args.add_argument("--shuffle-partitions", type=int, help="for this run; see README")
    args.add_argument("--on-gap", choices=("reset", "error", "latest"), default="reset")
    args.add_argument("--tolerated-unreadable", type=float, default=0.0, help="share of records, for load")
    args.add_argument("--tolerated-refused", type=float, default=1.0, help="share of rows, for export")
    return args


def _days(first: str, last: str | None) -> list[str]:
    days = [first]
    while last is not None and days[-1] < last:
        days.append(day_shift(days[-1], 1))
    return days


def main(argv: Sequence[str] | None = None) -> None:
    args = parser().parse_args(argv)
    days, steps = _days(args.dt, args.through), args.steps
    if "load" in steps and not (args.behavior_files and args.comment_files):
        parser().error("load needs --behavior-files and --comment-files")
    if args.through is not None and args.through < args.dt:
        parser().error("--through is before the run day")
    if args.restate and (args.through or set(STEPS[1:]) - set(steps)):
        parser().error("--restate is for one day and all steps after load")
    spark = SparkSession.builder.appName(f"basketlens {args.dt}").getOrCreate()
    if args.shuffle_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", args.shuffle_partitions)
    wh = Warehouse(spark, args.root, args.prefix).create()
    load_dimensions(wh, args.face_file, args.category_file)
    if "load" in steps:
        load_facts(wh, days, args.behavior_files, args.comment_files, args.tolerated_unreadable)
    if args.restate:
        print(restate_day(wh, args.dt, salts=args.salts, on_gap=args.on_gap, tolerated=args.tolerated_refused))
        return
    many = len(days) > 1
    if "detail" in steps:
        backfill_detail(wh, days) if many else build_detail(wh, args.dt)
    if "metrics" in steps:
        backfill_metrics(wh, days, salts=args.salts) if many else build_metrics(wh, args.dt, salts=args.salts)
    if "history" in steps:
        backfill_history(wh, days, args.on_gap) if many else build_history(wh, args.dt, args.on_gap)
    if "results" in steps:
        backfill_results(wh, days) if many else build_results(wh, args.dt)
    if "export" in steps:
        print(export_days(wh, days, args.tolerated_refused))


if __name__ == "__main__":
    main()
