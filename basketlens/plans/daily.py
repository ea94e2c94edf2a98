"""One run day: detail, metrics, history, results, export. Each step reads what the last one stored.

Storing each layer cuts the lineage: a lost executor costs tasks of one step, and a failed
step is run again on its own. Every step replaces its partitions, so a day can be rerun.
"""

from __future__ import annotations

from collections.abc import Mapping

from basketlens.functions.dates import check_dt
from basketlens.functions.sentiment import CHINESE, Lexicon
from basketlens.operators.history import advance_history, empty_history, previous_snapshot
from basketlens.operators.joins import wide_behavior, wide_comment
from basketlens.operators.metrics import (
    FACE_COUNTERS,
    FACE_KEYS,
    GOODS_COUNTERS,
    GOODS_KEYS,
    REPUTATION_COUNTERS,
    face_metrics,
    goods_from_face,
    reputation_metrics,
)
from basketlens.operators.rank import face_favorite, goods_pop, goods_pv_to_buy, goods_score
from basketlens.plans.export import export_days
from basketlens.plans.warehouse import Warehouse
from basketlens.schemas import TABLES

# Daily table, history table, keys, counters.
HISTORIES = (
    ("dws_face_day", "dws_face_full", FACE_KEYS, FACE_COUNTERS),
    ("dws_goods_day", "dws_goods_full", GOODS_KEYS, GOODS_COUNTERS),
    (
        "dws_goods_reputation_day",
        "dws_goods_reputation_full",
        GOODS_KEYS,
        REPUTATION_COUNTERS,
    ),
)


def build_detail(wh: Warehouse, dt: str) -> None:
    """Clean wide facts of the day."""
    face = wh.read("ods_user_face_full")
    category = wh.read("ods_category_mapping_full")
    behavior = wide_behavior(wh.read("user_behavior_inc", dt), face, category)
    wh.write_day("dwd_user_behavior", behavior, dt)
    comment = wide_comment(wh.read("user_comment_inc", dt), face, category)
    wh.write_day("dwd_user_comment", comment, dt)


def build_metrics(wh: Warehouse, dt: str, lexicon: Lexicon = CHINESE, salts: int = 0) -> None:
    """Aggregates of the day. The facts are read once: goods follow from occupations."""
    wh.write_day("dws_face_day", face_metrics(wh.read("dwd_user_behavior", dt), salts), dt)
    wh.write_day("dws_goods_day", goods_from_face(wh.read("dws_face_day", dt)), dt)
    reputation = reputation_metrics(wh.read("dwd_user_comment", dt), lexicon, salts)
    wh.write_day("dws_goods_reputation_day", reputation, dt)


def build_history(wh: Warehouse, dt: str, on_gap: str = "reset") -> None:
    """Snapshots of the day from those of the day before."""
    for daily, full, keys, counters in HISTORIES:
        before, today = previous_snapshot(wh.read(full), dt, on_gap, wh.days(full)), wh.read(daily, dt)
        if before.isEmpty() and today.isEmpty():
            # Rows of an earlier run of the day must go; without rows no partition is touched.
            wh.write_day(full, empty_history(wh.spark, TABLES[full]), dt)
        else:
            wh.write_days(full, advance_history(before, today, keys, counters, dt))


def build_results(wh: Warehouse, dt: str) -> None:
    """The four result tables of the day."""
    wh.write_day("ads_goods_pop", goods_pop(wh.read("dws_goods_day", dt), one_day=True), dt)
    wh.write_day("ads_face_favorite", face_favorite(wh.read("dws_face_full", dt)), dt)
    wh.write_day("ads_goods_pv_to_buy", goods_pv_to_buy(wh.read("dws_goods_full", dt)), dt)
    wh.write_day("ads_goods_score", goods_score(wh.read("dws_goods_reputation_full", dt)), dt)


def run_day(
    wh: Warehouse,
    dt: str,
    lexicon: Lexicon = CHINESE,
    salts: int = 0,
    on_gap: str = "reset",
    tolerated: float = 1.0,
) -> dict[str, Mapping[str, int]]:
    """All steps of day ``dt`` whose facts are loaded; the numbers of exported and refused rows."""
    check_dt(dt)
    build_detail(wh, dt)
    build_metrics(wh, dt, lexicon, salts)
    build_history(wh, dt, on_gap)
    build_results(wh, dt)
    return export_days(wh, [dt], tolerated)
