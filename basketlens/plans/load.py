"""Daily files into their fact tables, with the records that cannot be read accounted for.

One job reads the files, line breaks inside quotes included, and stages good records and rejects apart, counted while
they are written. Only if the rejects are within their tolerated share are the days and their rejects swapped
in; else the tables stay as they were.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from basketlens.functions.dates import check_dt
from basketlens.operators.quality import GOOD, VERDICT, check_share, observed
from basketlens.plans.warehouse import Warehouse
from basketlens.schemas import BEHAVIOR_FILE, COMMENT_FILE, PARTITION, TABLES
from basketlens.sinks.publish import Staged, bucketed, new_run, publish, runs_folder
from basketlens.sources.files import Columns, flagged_daily_files, to_behavior, to_comment

UNREADABLE = "unreadable"

#: Columns of the files, and what makes them rows of the table.
FILES: dict[str, tuple[Columns, Callable[..., DataFrame]]] = {
    "user_behavior_inc": (BEHAVIOR_FILE, to_behavior),
    "user_comment_inc": (COMMENT_FILE, to_comment),
}


def rejects(wh: Warehouse, name: str) -> str:
    """The table of the records of a fact table's files that could not be read: ``record``, by day."""
    return f"{wh.table(name)}_rejects"


def _create_rejects(wh: Warehouse, name: str) -> None:
    wh.spark.sql(
        f"CREATE TABLE IF NOT EXISTS {rejects(wh, name)} (record string, {PARTITION} string) USING orc"
        f" PARTITIONED BY ({PARTITION}) LOCATION '{wh.path(name)}_rejects'"
    )


def load_files(
    wh: Warehouse,
    name: str,
    root: str,
    days: Sequence[str],
    file_name: str = "{dt}.csv",
    tolerated: float = 0.0,
) -> Mapping[str, int]:
    """Replace ``days`` of a fact table by their files; the numbers of good and unreadable records.

    Raises ``TooManyRejects`` if more than the share ``tolerated`` of the records is unreadable. Each file is read
    by one task, as a quoted text may hold line breaks, so a large day should be a folder of many files.
    """
    columns, typed = FILES[name]
    days = [check_dt(d) for d in days]
    rows = flagged_daily_files(wh.spark, root, columns, days, file_name, multi_line=True)
    verdict = F.when(F.col("record").isNull(), F.lit(GOOD)).otherwise(F.lit(UNREADABLE))
    counts = Observation()
    judged = (
        typed(rows, "record")
        .withColumn(VERDICT, verdict)
        .observe(counts, *[F.count_if(F.col(VERDICT) == v).alias(v) for v in (GOOD, UNREADABLE)])
    )
    folder = f"{runs_folder(wh.spark, wh.table(name))}/{new_run()}"
    if len(days) > 1:
        judged = judged.hint("rebalance", PARTITION)
    writer = judged.write.mode("overwrite").partitionBy(PARTITION, VERDICT).format("orc")
    writer.option("compression", "snappy").save(folder)
    found = {v: observed(counts).get(v, 0) for v in (GOOD, UNREADABLE)}
    check_share(name, found, tolerated)
    _create_rejects(wh, name)
    good, bad = [], []
    for day in days:
        at, partition = f"{folder}/{PARTITION}={day}/{VERDICT}=", ((PARTITION, day),)
        good.append(Staged(wh.table(name), partition, f"{at}{GOOD}"))
        bad.append(Staged(rejects(wh, name), partition, f"{at}{UNREADABLE}" if found[UNREADABLE] else None))
    if bucketed(wh.spark, wh.table(name)):
        # Staged files have no buckets: the rows go through the table's own writer.
        kind = f"{TABLES[name].data_ddl}, {PARTITION} string, {VERDICT} string"
        rows = wh.spark.read.schema(kind).orc(folder).where(F.col(VERDICT) == GOOD)
        wh.replace_days(name, rows.drop(VERDICT), days)
        publish(wh.spark, bad)
    else:
        publish(wh.spark, [*good, *bad])
    return found
