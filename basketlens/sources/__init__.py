"""Scans: daily files, delimited text, relational tables, warehouse partitions."""

from basketlens.sources.files import (
    flagged_daily_files,
    read_daily_files,
    split_daily_files,
    to_behavior,
    to_comment,
)
from basketlens.sources.jdbc import read_jdbc_split, split_predicates
from basketlens.sources.tables import read_dimension, read_partition, read_result, unbucketed_scans
from basketlens.sources.text import field_expressions, read_delimited_text

__all__ = [
    "field_expressions",
    "flagged_daily_files",
    "read_daily_files",
    "read_delimited_text",
    "read_dimension",
    "read_jdbc_split",
    "read_partition",
    "read_result",
    "split_daily_files",
    "split_predicates",
    "to_behavior",
    "to_comment",
    "unbucketed_scans",
]
