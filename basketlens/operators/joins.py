"""Left joins of the facts to the two dimensions.

Dimension keys are not declared unique: a repeated key multiplies its facts. An unmatched
fact keeps a null attribute.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.operators.clean import dedup_behavior, dedup_comment
from basketlens.schemas import PARTITION, WIDE_BEHAVIOR, WIDE_COMMENT


def join_dimension(
    facts: DataFrame, dimension: DataFrame, key: str, max_broadcast_rows: int | None = None
) -> DataFrame:
    """``facts`` left-joined to ``dimension`` on ``key``.

    No hint by default: Spark broadcasts a dimension whose estimated or measured size is
    below its threshold, and otherwise shuffles both sides, where adaptive execution splits
    the fact rows of a hot key over several tasks. With ``max_broadcast_rows`` the dimension
    is counted, at most one row past that bound, and broadcast only if it is within it.
    """
    if max_broadcast_rows is not None:
        if dimension.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows:
            dimension = F.broadcast(dimension)
    return facts.join(dimension, on=key, how="left")


def join_face(
    facts: DataFrame, face: DataFrame, max_broadcast_rows: int | None = None
) -> DataFrame:
    return join_dimension(facts, face.select("user_id", "face"), "user_id", max_broadcast_rows)


def join_category(
    facts: DataFrame, category: DataFrame, max_broadcast_rows: int | None = None
) -> DataFrame:
    labels = category.select("category_id", "category_label")
    return join_dimension(facts, labels, "category_id", max_broadcast_rows)


def wide_behavior(
    behavior: DataFrame,
    face: DataFrame,
    category: DataFrame,
    max_broadcast_rows: int | None = None,
) -> DataFrame:
    """Clean, distinct behaviours with occupation and category label."""
    joined = join_category(
        join_face(dedup_behavior(behavior), face, max_broadcast_rows),
        category,
        max_broadcast_rows,
    )
    return joined.select(*[name for name, _ in WIDE_BEHAVIOR], PARTITION)


def wide_comment(
    comment: DataFrame,
    face: DataFrame,
    category: DataFrame,
    max_broadcast_rows: int | None = None,
) -> DataFrame:
    """Clean, distinct comments with occupation and category label; the text stays raw."""
    joined = join_category(
        join_face(dedup_comment(comment), face, max_broadcast_rows),
        category,
        max_broadcast_rows,
    )
    return joined.select(*[name for name, _ in WIDE_COMMENT], PARTITION)


def frequent_keys(facts: DataFrame, key: str, share: float) -> DataFrame:
    """Keys that hold more than ``share`` of the rows: fewer than ``1 / share`` of them."""
    counts = facts.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    total = counts.agg(F.sum("_rows").alias("_total"))
    # The total is a scalar subquery: one value, no join.
    return counts.where(F.col("_rows") > F.lit(share) * total.scalar()).select(key)


def join_bucketed(
    facts: DataFrame, hot_facts: DataFrame, dimension: DataFrame, key: str
) -> DataFrame:
    """Left join of a fact table to a dimension, both bucketed alike on ``key``.

    Equal buckets meet without a shuffle, but one task reads one bucket whole, so the rows
    of frequent keys must not be in the bucketed table (``write_bucketed_facts`` keeps them
    apart as ``hot_facts``). They are joined here to their few dimension rows as ordinary
    frames, where Spark may broadcast by measured size or split a hot key.
    """
    joined = facts.join(dimension, on=key, how="left")
    hot_keys = hot_facts.select(key).distinct()
    hot_dimension = dimension.join(hot_keys, on=key, how="left_semi")
    return joined.unionByName(hot_facts.join(hot_dimension, on=key, how="left"))
