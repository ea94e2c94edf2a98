"""Daily metrics of the wide facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions.sentiment import CHINESE, Lexicon, sentiment_label
from basketlens.operators.aggregate import Measure, aggregate
from basketlens.operators.clean import KEYS, drop_null_keys
from basketlens.operators.joins import join_category, join_face
from basketlens.schemas import PARTITION

FACE_KEYS = ["face", "category_label"]
GOODS_KEYS = ["category_label"]
FACE_COUNTERS = ["pv_count", "cart_count", "buy_count"]
GOODS_COUNTERS = ["total_pv", "total_cart", "total_buy"]
REPUTATION_COUNTERS = ["total_comments", "good_count", "bad_count"]

# Favourites are a legal behaviour that no metric counts.
COUNTED = ["pv", "cart", "buy"]


def _behavior_counters(names: list[str]) -> list[Measure]:
    return [
        Measure(name, "count_if", F.col("behavior") == F.lit(kind))
        for name, kind in zip(names, COUNTED, strict=True)
    ]


def face_metrics(wide: DataFrame, salts: int = 0) -> DataFrame:
    """Views, carts and purchases per day, occupation and category label."""
    return aggregate(wide, [PARTITION, *FACE_KEYS], _behavior_counters(FACE_COUNTERS), salts)


def goods_metrics(wide: DataFrame, salts: int = 0) -> DataFrame:
    """Views, carts and purchases per day and category label."""
    return aggregate(wide, [PARTITION, *GOODS_KEYS], _behavior_counters(GOODS_COUNTERS), salts)


def goods_from_face(face_day: DataFrame) -> DataFrame:
    """``goods_metrics`` from the result of ``face_metrics``, without reading facts again.

    Exact, because both are sums over the same rows.
    """
    measures = [
        Measure(total, "sum", F.col(count))
        for total, count in zip(GOODS_COUNTERS, FACE_COUNTERS, strict=True)
    ]
    return aggregate(face_day, [PARTITION, *GOODS_KEYS], measures)


def label_comments(wide: DataFrame, lexicon: Lexicon = CHINESE) -> DataFrame:
    """Wide comments with their sentiment label in place of the text."""
    return wide.withColumn("label", sentiment_label(F.col("comment"), lexicon)).drop("comment")


def _label_counts(labelled: DataFrame, salts: int) -> DataFrame:
    measures = [Measure("total_comments", "count"), Measure("good_count", "sum", F.col("label"))]
    counted = aggregate(labelled, [PARTITION, *GOODS_KEYS], measures, salts)
    return counted.withColumn("bad_count", F.col("total_comments") - F.col("good_count"))


def reputation_metrics(
    wide: DataFrame, lexicon: Lexicon = CHINESE, salts: int = 0
) -> DataFrame:
    """Comments, good and bad ones, per day and category label.

    The label is computed before the grouping, so no text passes this shuffle.
    """
    return _label_counts(label_comments(wide.select(PARTITION, *GOODS_KEYS, "comment"), lexicon), salts)


def comment_labels(comment: DataFrame, lexicon: Lexicon = CHINESE) -> DataFrame:
    """Distinct comments within each day by a digest of their text, with their sentiment label; null keys dropped.

    The digest has 16 bytes of the text's SHA-256 and is null for a null text. Texts stay where they are read.
    """
    digest = F.unhex(F.substring(F.sha2("comment", 256), 1, 32))
    labelled = comment.select(
        *KEYS, digest.alias("digest"), sentiment_label(F.col("comment"), lexicon).alias("label"), PARTITION
    )
    return drop_null_keys(labelled).dropDuplicates()


def reputation_from_comments(
    comment: DataFrame,
    face: DataFrame,
    category: DataFrame,
    lexicon: Lexicon = CHINESE,
    salts: int = 0,
) -> DataFrame:
    """``reputation_metrics`` of the wide comments straight from the raw ones, without a text in any shuffle.

    The profiles are joined as they are for wide comments, as a repeated user multiplies comments.
    """
    joined = join_category(join_face(comment_labels(comment, lexicon), face), category)
    return _label_counts(joined.select(PARTITION, *GOODS_KEYS, "label"), salts)
