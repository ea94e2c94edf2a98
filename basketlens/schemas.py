"""Declared schemas: layers, tables, partitioning, buckets and export keys.

Schemas are never inferred. Columns are (name, Spark SQL type) pairs, so that the
same declaration serves readers, table DDL and the by-name column alignment of writers.
"""

from __future__ import annotations

from dataclasses import dataclass

PARTITION = "dt"

LAYERS = ("ods", "dwd", "dws", "ads")


@dataclass(frozen=True)
class TableSpec:
    """One table of the warehouse."""

    layer: str
    name: str
    columns: tuple[tuple[str, str], ...]
    daily: bool = True
    text: bool = False
    bucket_by: tuple[str, ...] = ()
    buckets: int = 0

    @property
    def data_columns(self) -> list[str]:
        return [name for name, _ in self.columns]

    @property
    def all_columns(self) -> list[str]:
        return self.data_columns + ([PARTITION] if self.daily else [])

    @property
    def data_ddl(self) -> str:
        return ddl(self.columns)

    @property
    def full_ddl(self) -> str:
        return ddl(self.columns + (((PARTITION, "string"),) if self.daily else ()))


def ddl(columns: tuple[tuple[str, str], ...]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in columns)


# --- Files at the edge (fixed values: column order and types of the daily files) -------------

BEHAVIOR_FILE = (
    ("user_id", "bigint"),
    ("goods_id", "bigint"),
    ("category_id", "bigint"),
    ("behavior", "string"),
    ("timestamp", "string"),
    ("sex", "bigint"),
    ("address", "string"),
    ("device", "string"),
    ("price", "decimal(10,2)"),
    ("amount", "bigint"),
)

COMMENT_FILE = (
    ("user_id", "bigint"),
    ("goods_id", "bigint"),
    ("category_id", "bigint"),
    ("comment", "string"),
)

# --- Warehouse columns (fixed values) --------------------------------------------------------

BEHAVIOR = (
    ("user_id", "string"),
    ("goods_id", "string"),
    ("category_id", "string"),
    ("behavior", "string"),
    ("timestamp", "bigint"),
    ("sex", "string"),
    ("address", "string"),
    ("device", "string"),
    ("price", "decimal(10,2)"),
    ("amount", "int"),
)

COMMENT = (
    ("user_id", "string"),
    ("goods_id", "string"),
    ("category_id", "string"),
    ("comment", "string"),
)

FACE = (("user_id", "string"), ("face", "string"))

CATEGORY = (
    ("category_id", "string"),
    ("category_count", "int"),
    ("category_label", "string"),
)

WIDE_BEHAVIOR = (
    ("user_id", "string"),
    ("category_id", "string"),
    ("behavior", "string"),
    ("sex", "string"),
    ("address", "string"),
    ("device", "string"),
    ("face", "string"),
    ("category_label", "string"),
)

WIDE_COMMENT = (
    ("user_id", "string"),
    ("category_id", "string"),
    ("comment", "string"),
    ("face", "string"),
    ("category_label", "string"),
)

FACE_METRICS = (
    ("face", "string"),
    ("category_label", "string"),
    ("pv_count", "bigint"),
    ("cart_count", "bigint"),
    ("buy_count", "bigint"),
)

GOODS_METRICS = (
    ("category_label", "string"),
    ("total_pv", "bigint"),
    ("total_cart", "bigint"),
    ("total_buy", "bigint"),
)

REPUTATION = (
    ("category_label", "string"),
    ("total_comments", "bigint"),
    ("good_count", "bigint"),
    ("bad_count", "bigint"),
)

GOODS_POP = (("category_label", "string"), ("score", "double"), ("rk", "int"))

FACE_FAVORITE = (
    ("face", "string"),
    ("category_label", "string"),
    ("score", "double"),
    ("rk", "int"),
)

PV_TO_BUY = (("category_label", "string"), ("buy_rate", "double"))

GOODS_SCORE = (("category_label", "string"), ("good_rate", "double"))


def _specs() -> tuple[TableSpec, ...]:
    return (
        TableSpec("ods", "user_behavior_tmp", BEHAVIOR, daily=False, text=True),
        TableSpec("ods", "user_comment_tmp", COMMENT, daily=False, text=True),
        TableSpec(
            "ods", "user_behavior_inc", BEHAVIOR, bucket_by=("user_id", "category_id"), buckets=8
        ),
        TableSpec("ods", "user_comment_inc", COMMENT, bucket_by=("category_id",), buckets=8),
        TableSpec("ods", "face", FACE, daily=False, text=True),
        TableSpec("ods", "category", CATEGORY, daily=False, text=True),
        TableSpec(
            "ods", "ods_user_face_full", FACE, daily=False, bucket_by=("user_id",), buckets=8
        ),
        TableSpec(
            "ods",
            "ods_category_mapping_full",
            CATEGORY,
            daily=False,
            bucket_by=("category_id",),
            buckets=4,
        ),
        TableSpec("dwd", "dwd_user_behavior", WIDE_BEHAVIOR),
        TableSpec("dwd", "dwd_user_comment", WIDE_COMMENT),
        TableSpec("dws", "dws_face_day", FACE_METRICS),
        TableSpec("dws", "dws_face_full", FACE_METRICS),
        TableSpec("dws", "dws_goods_day", GOODS_METRICS),
        TableSpec("dws", "dws_goods_full", GOODS_METRICS),
        TableSpec("dws", "dws_goods_reputation_day", REPUTATION),
        TableSpec("dws", "dws_goods_reputation_full", REPUTATION),
        TableSpec("ads", "ads_goods_pop", GOODS_POP),
        TableSpec("ads", "ads_face_favorite", FACE_FAVORITE),
        TableSpec("ads", "ads_goods_pv_to_buy", PV_TO_BUY),
        TableSpec("ads", "ads_goods_score", GOODS_SCORE),
    )


TABLES = {spec.name: spec for spec in _specs()}

# Result table -> (export table, primary key). Key columns must not be null.
EXPORTS = {
    "ads_goods_pop": ("goods_pop", ("dt", "category_label")),
    "ads_face_favorite": ("face_favorite", ("dt", "face", "category_label")),
    "ads_goods_pv_to_buy": ("goods_pv_to_buy", ("dt", "category_label")),
    "ads_goods_score": ("goods_score", ("dt", "category_label")),
}
