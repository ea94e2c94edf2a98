"""Many run days in one job per table, with the same result as running them one by one.

Tables that do not need each other are filled at the same time.

What the tables hold of these days is replaced, also by nothing; what they hold of others is kept, and
histories continue it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions.dates import check_dt
from basketlens.functions.sentiment import CHINESE, Lexicon
from basketlens.operators.history import cumulative_history, history_snapshots
from basketlens.operators.joins import wide_behavior, wide_comment
from basketlens.operators.metrics import face_metrics, goods_from_face, reputation_metrics
from basketlens.operators.rank import face_favorite, goods_pop, goods_pv_to_buy, goods_score
from basketlens.plans.daily import HISTORIES
from basketlens.plans.export import export_days
from basketlens.plans.together import together
from basketlens.plans.warehouse import Warehouse
from basketlens.schemas import PARTITION
from basketlens.sources.tables import unbucketed_scans


def _of_days(wh: Warehouse, name: str, days: Sequence[str]) -> DataFrame:
    return wh.read(name).where(F.col(PARTITION).isin([check_dt(d) for d in days]))


def backfill_detail(wh: Warehouse, days: Sequence[str]) -> None:
    """Clean wide facts of all ``days``.

    A scan by buckets would give one task a bucket of all days, so bucketed facts are read as plain files here.
    """
    face = wh.read("ods_user_face_full")
    category = wh.read("ods_category_mapping_full")
    behavior = wide_behavior(_of_days(wh, "user_behavior_inc", days), face, category)
    comment = wide_comment(_of_days(wh, "user_comment_inc", days), face, category)
    with unbucketed_scans(wh.spark):
        together(
            wh.spark,
            lambda: wh.replace_days("dwd_user_behavior", behavior, days),
            lambda: wh.replace_days("dwd_user_comment", comment, days),
        )


def backfill_metrics(
    wh: Warehouse, days: Sequence[str], lexicon: Lexicon = CHINESE, salts: int = 0
) -> None:
    """Daily aggregates of all ``days``."""

    def behavior() -> None:
        faces = face_metrics(_of_days(wh, "dwd_user_behavior", days), salts)
        wh.replace_days("dws_face_day", faces, days)
        goods = goods_from_face(_of_days(wh, "dws_face_day", days))
        wh.replace_days("dws_goods_day", goods, days)

    def comment() -> None:
        reputation = reputation_metrics(_of_days(wh, "dwd_user_comment", days), lexicon, salts)
        wh.replace_days("dws_goods_reputation_day", reputation, days)

    together(wh.spark, behavior, comment)


def backfill_history(wh: Warehouse, days: Sequence[str], on_gap: str = "reset") -> None:
    """Snapshots of all ``days``, continuing the stored ones of other days."""

    def snapshots(daily: str, full: str, keys: Sequence[str], counters: Sequence[str]) -> None:
        rows = _of_days(wh, daily, days)
        of_days = history_snapshots(rows, keys, counters, days, on_gap, wh.read(full), wh.days(full))
        wh.replace_days(full, of_days, days)

    together(wh.spark, *[partial(snapshots, *history) for history in HISTORIES])


def start_history(wh: Warehouse, dt: str) -> None:
    """The one snapshot of ``dt``, from the stored aggregates of all days up to it."""
    for daily, full, keys, counters in HISTORIES:
        wh.write_day(full, cumulative_history(wh.read(daily), keys, counters, dt), dt)


def backfill_results(wh: Warehouse, days: Sequence[str]) -> None:
    """Result tables of all ``days``."""
    results = {
        "ads_goods_pop": goods_pop(_of_days(wh, "dws_goods_day", days)),
        "ads_face_favorite": face_favorite(_of_days(wh, "dws_face_full", days)),
        "ads_goods_pv_to_buy": goods_pv_to_buy(_of_days(wh, "dws_goods_full", days)),
        "ads_goods_score": goods_score(_of_days(wh, "dws_goods_reputation_full", days)),
    }
    together(wh.spark, *[partial(wh.replace_days, name, rows, days) for name, rows in results.items()])


def backfill(
    wh: Warehouse,
    days: Sequence[str],
    lexicon: Lexicon = CHINESE,
    salts: int = 0,
    on_gap: str = "reset",
    tolerated: float = 1.0,
) -> None:
    """All steps of ``days`` over their loaded facts, up to the export targets."""
    backfill_detail(wh, days)
    backfill_metrics(wh, days, lexicon, salts)
    backfill_history(wh, days, on_gap)
    backfill_results(wh, days)
    export_days(wh, days, tolerated)
