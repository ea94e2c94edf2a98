"""The end of a run day: the results through the gate into the export targets.

Targets are tables of the catalog with the columns and keys of ``schemas.EXPORTS``; each has a table of rejects
beside it, by day and reason. All four results are staged and counted first, good rows and rejects by one job each, and
only then swapped in, so a refused day leaves every target as it was.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from basketlens.functions.dates import check_dt
from basketlens.operators.quality import GOOD, REASONS, VERDICT, check_share, gated, observed, verdict_counts
from basketlens.plans.together import together
from basketlens.plans.warehouse import Warehouse
from basketlens.schemas import EXPORTS, PARTITION, TABLES
from basketlens.sinks.publish import Staged, new_run, publish, runs_folder

LAYER = "export"
REASON = "reason"


def target(wh: Warehouse, result: str) -> str:
    """The export table of a result table."""
    return f"{wh.database(LAYER)}.{EXPORTS[result][0]}"


def rejects(wh: Warehouse, result: str) -> str:
    return f"{target(wh, result)}_rejects"


def create_targets(wh: Warehouse) -> None:
    """Create the export tables and their tables of rejects, if they are not there."""
    root = f"{wh.root}/{LAYER}"
    wh.spark.sql(f"CREATE DATABASE IF NOT EXISTS {wh.database(LAYER)} LOCATION '{root}'")
    for result in EXPORTS:
        spec = TABLES[result]
        for table, by in (
            (target(wh, result), PARTITION),
            (rejects(wh, result), f"{PARTITION}, {REASON}"),
        ):
            reason = f", {REASON} string" if REASON in by else ""
            wh.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {table} ({spec.full_ddl}{reason}) USING orc"
                " OPTIONS (compression 'snappy')"
                f" PARTITIONED BY ({by}) LOCATION '{root}/{table.rsplit('.', 1)[1]}'"
            )


def _staged(
    wh: Warehouse, result: str, days: Sequence[str], run: str
) -> tuple[list[Staged], Mapping[str, int]]:
    """A result's days behind the gate, in one job, with the numbers of rows by verdict."""
    _, key = EXPORTS[result]
    rows = wh.read(result).where(F.col(PARTITION).isin(list(days)))
    counts = Observation()
    judged = gated(rows, key).observe(counts, *verdict_counts())
    folder = f"{runs_folder(wh.spark, target(wh, result))}/{run}"
    if len(days) > 1:
        judged = judged.hint("rebalance", PARTITION)
    writer = judged.write.mode("overwrite").partitionBy(PARTITION, VERDICT).format("orc")
    writer.option("compression", "snappy").save(folder)
    found = {v: observed(counts).get(v, 0) for v in (GOOD, *REASONS)}
    staged = []
    for day in days:
        at = f"{folder}/{PARTITION}={day}/{VERDICT}="
        staged.append(Staged(target(wh, result), ((PARTITION, day),), f"{at}{GOOD}"))
        for reason in REASONS:
            partition = ((PARTITION, day), (REASON, reason))
            location = f"{at}{reason}" if found[reason] else None
            staged.append(Staged(rejects(wh, result), partition, location))
    return staged, found


def stage_export(
    wh: Warehouse, days: Sequence[str], tolerated: float = 1.0
) -> tuple[list[Staged], dict[str, Mapping[str, int]]]:
    """Stage the results of ``days``; what ``publish`` needs, and the counts by result and verdict.

    Raises ``TooManyRejects`` if a larger share of a result's rows than ``tolerated`` is refused.
    """
    create_targets(wh)
    run, staged, counts = new_run(), [], {}
    checked = [check_dt(d) for d in days]
    of_results = together(wh.spark, *[partial(_staged, wh, result, checked, run) for result in EXPORTS])
    for result, (more, found) in zip(EXPORTS, of_results, strict=True):
        check_share(EXPORTS[result][0], found, tolerated)
        staged += more
        counts[result] = found
    return staged, counts


def export_days(
    wh: Warehouse, days: Sequence[str], tolerated: float = 1.0
) -> dict[str, Mapping[str, int]]:
    """Replace ``days`` of all export targets by the good rows of the results; rows by result and verdict."""
    staged, counts = stage_export(wh, days, tolerated)
    publish(wh.spark, staged)
    return counts


def exported(wh: Warehouse, result: str, dt: str) -> DataFrame:
    """What stands in a target for a day, with the number of rejects of the day in ``rejects``."""
    refused = wh.spark.table(rejects(wh, result)).where(F.col(PARTITION) == check_dt(dt))
    count = refused.agg(F.count(F.lit(1)).alias("rejects"))
    good = wh.spark.table(target(wh, result)).where(F.col(PARTITION) == dt)
    return good.withColumn("rejects", count.scalar())
