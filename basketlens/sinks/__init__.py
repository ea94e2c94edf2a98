"""Writers: table partitions, bucketed tables, text folders, relational tables."""

from basketlens.sinks.bucketed import HotKeySplit, write_bucketed, write_bucketed_facts
from basketlens.sinks.jdbc import replace_day_jdbc, truncate_and_insert
from basketlens.sinks.partitions import drop_days, overwrite_day, overwrite_days, replace_days, stored_days
from basketlens.sinks.publish import Staged, publish, publish_days, remove_unused_runs, stage_days
from basketlens.sinks.text import write_delimited_text

__all__ = [
    "HotKeySplit",
    "Staged",
    "drop_days",
    "overwrite_day",
    "overwrite_days",
    "publish",
    "publish_days",
    "remove_unused_runs",
    "replace_day_jdbc",
    "replace_days",
    "stage_days",
    "stored_days",
    "truncate_and_insert",
    "write_bucketed",
    "write_bucketed_facts",
    "write_delimited_text",
]
