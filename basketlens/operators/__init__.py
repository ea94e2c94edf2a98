"""DataFrame -> DataFrame operators. All of them are lazy.

Fact frames carry their run day in ``dt``; operators keep it and group by it, so that the
same code serves one day and a backfill of many days in one job.
"""

from basketlens.operators.clean import (
    align_columns,
    dedup_behavior,
    dedup_comment,
    drop_null_keys,
    project_behavior,
    project_comment,
)
from basketlens.operators.history import (
    advance_history,
    cumulative_history,
    empty_history,
    history_snapshots,
    previous_snapshot,
    restated_snapshots,
)
from basketlens.operators.joins import (
    frequent_keys,
    join_bucketed,
    join_category,
    join_dimension,
    join_face,
    wide_behavior,
    wide_comment,
)
from basketlens.operators.metrics import (
    comment_labels,
    face_metrics,
    goods_from_face,
    goods_metrics,
    label_comments,
    reputation_from_comments,
    reputation_metrics,
)
from basketlens.operators.aggregate import Measure, aggregate
from basketlens.operators.quality import TooManyRejects, export_key_violations, export_violations, gated
from basketlens.operators.rank import (
    face_favorite,
    goods_pop,
    goods_pv_to_buy,
    goods_score,
    top_k,
    top_k_per_group,
)

__all__ = [
    "Measure",
    "advance_history",
    "aggregate",
    "align_columns",
    "cumulative_history",
    "comment_labels",
    "dedup_behavior",
    "dedup_comment",
    "drop_null_keys",
    "empty_history",
    "TooManyRejects",
    "export_key_violations",
    "export_violations",
    "gated",
    "face_favorite",
    "face_metrics",
    "frequent_keys",
    "goods_from_face",
    "goods_metrics",
    "goods_pop",
    "goods_pv_to_buy",
    "goods_score",
    "history_snapshots",
    "join_bucketed",
    "join_category",
    "join_dimension",
    "join_face",
    "label_comments",
    "previous_snapshot",
    "restated_snapshots",
    "project_behavior",
    "project_comment",
    "reputation_from_comments",
    "reputation_metrics",
    "top_k",
    "top_k_per_group",
    "wide_behavior",
    "wide_comment",
]
