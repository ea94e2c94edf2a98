"""Compositions: the warehouse tables, the daily run, the backfill of many days."""

from basketlens.plans.backfill import (
    backfill,
    backfill_detail,
    backfill_history,
    backfill_metrics,
    backfill_results,
    start_history,
)
from basketlens.plans.daily import build_detail, build_history, build_metrics, build_results, run_day
from basketlens.plans.export import create_targets, export_days, exported, stage_export
from basketlens.plans.load import load_files
from basketlens.plans.restate import restate_day, stage_restated
from basketlens.plans.warehouse import Warehouse

__all__ = [
    "Warehouse",
    "backfill",
    "backfill_detail",
    "backfill_history",
    "backfill_metrics",
    "backfill_results",
    "build_detail",
    "build_history",
    "build_metrics",
    "build_results",
    "create_targets",
    "export_days",
    "exported",
    "load_files",
    "restate_day",
    "run_day",
    "stage_export",
    "stage_restated",
    "start_history",
]
