"""Rankings and the four result tables.

Ties in score are broken by category label, so that a run can be repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.functions.scoring import weighted_score
from basketlens.functions.wilson import wilson_lower
from basketlens.schemas import PARTITION

_SALT = "_salt"

# Up to this k Spark cuts every group to k rows before the shuffle of a rank filter
# (default of spark.sql.optimizer.windowGroupLimitThreshold).
_GROUP_LIMIT = 1000
_SALTS = 64


def _ranking(score: str, label: str) -> list[Column]:
    return [F.desc_nulls_last(score), F.asc_nulls_last(label)]


def top_k(df: DataFrame, k: int, score: str = "score", label: str = "category_label") -> DataFrame:
    """The ``k`` best rows of the whole frame, numbered in ``rk``.

    The limit stands under the numbering, so the single task of the window without
    partitions gets ``k`` rows and no more.
    """
    best = df.orderBy(*_ranking(score, label)).limit(k)
    return best.withColumn("rk", F.row_number().over(Window.orderBy(*_ranking(score, label))))


def top_k_per_group(
    df: DataFrame,
    k: int,
    group: Sequence[str],
    score: str = "score",
    label: str = "category_label",
) -> DataFrame:
    """The ``k`` best rows of each group, numbered in ``rk``.

    Spark cuts the groups to ``k`` rows before its shuffle while ``k`` is small; for a
    larger ``k`` the groups are first cut in salted parts, so that a hot group is never
    sorted whole in one task.
    """
    order = _ranking(score, label)
    if k > _GROUP_LIMIT:
        part = Window.partitionBy(_SALT, *group).orderBy(*order)
        salted = df.withColumn(_SALT, F.pmod(F.xxhash64(label), F.lit(_SALTS)))
        df = (
            salted.withColumn("rk", F.row_number().over(part))
            .where(F.col("rk") <= k)
            .drop("rk", _SALT)
        )
    whole = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rk", F.row_number().over(whole)).where(F.col("rk") <= k)


def _goods_scores(goods: DataFrame) -> DataFrame:
    score = weighted_score(F.col("total_pv"), F.col("total_cart"), F.col("total_buy"))
    return goods.select("category_label", score.alias("score"), PARTITION)


def goods_pop(goods_day: DataFrame, k: int = 100, one_day: bool = False) -> DataFrame:
    """The ``k`` most popular category labels of each day.

    ``one_day`` says that the frame holds a single day, which needs no grouping.
    """
    scores = _goods_scores(goods_day)
    best = top_k(scores, k) if one_day else top_k_per_group(scores, k, [PARTITION])
    return best.select("category_label", "score", "rk", PARTITION)


def face_favorite(face_full: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` favourite category labels of each occupation, per snapshot."""
    score = weighted_score(F.col("pv_count"), F.col("cart_count"), F.col("buy_count"))
    scores = face_full.select("face", "category_label", score.alias("score"), PARTITION)
    best = top_k_per_group(scores, k, [PARTITION, "face"])
    return best.select("face", "category_label", "score", "rk", PARTITION)


def goods_pv_to_buy(goods_full: DataFrame) -> DataFrame:
    """Wilson lower bound of purchases per view, per snapshot and category label."""
    rate = wilson_lower(F.col("total_buy"), F.col("total_pv"))
    return goods_full.select("category_label", rate.alias("buy_rate"), PARTITION)


def goods_score(reputation_full: DataFrame) -> DataFrame:
    """Wilson lower bound of good comments, per snapshot and category label."""
    rate = wilson_lower(F.col("good_count"), F.col("total_comments"))
    return reputation_full.select("category_label", rate.alias("good_rate"), PARTITION)
