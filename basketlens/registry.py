"""One query per operator, over the given tables as a whole.

A query is a function of (session, folder of the given tables). Those for writers write
under the session's shared folder and return what a reader finds there.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from basketlens import adapters as given_data
from basketlens import operators as op
from basketlens.adapters import FRAGMENTS, WORDS, given, shared_folder
from basketlens.functions import (
    day_shift,
    previous_day,
    sentiment_label,
    sentiment_score,
    weighted_score,
    wilson_lower,
)
from basketlens.operators.clean import BEHAVIOR_COLUMNS
from basketlens.operators.metrics import (
    FACE_COUNTERS,
    FACE_KEYS,
    GOODS_COUNTERS,
    GOODS_KEYS,
    REPUTATION_COUNTERS,
)
from basketlens.plans import (
    Warehouse,
    backfill,
    backfill_detail,
    backfill_metrics,
    exported,
    restate_day,
    run_day,
    start_history,
)
from basketlens.plans.warehouse import DECLARED_BUCKETS
from basketlens.schemas import (
    BEHAVIOR,
    BEHAVIOR_FILE,
    COMMENT,
    COMMENT_FILE,
    EXPORTS,
    PARTITION,
    TABLES,
)
from basketlens.sinks import HotKeySplit, write_bucketed, write_bucketed_facts, write_delimited_text
from basketlens.sources import (
    read_daily_files,
    read_delimited_text,
    read_dimension,
    read_partition,
    read_result,
    split_predicates,
    to_behavior,
    to_comment,
)
from basketlens.sources.files import CSV_OPTIONS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__.lstrip("_")] = function
    return function


# --- The given data ---------------------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "events")


def _behavior(
    spark: SparkSession, sf_dir: str, first: str | None = None, last: str | None = None
) -> DataFrame:
    events = given_data.days_between(_events(spark, sf_dir), first, last)
    return given_data.behavior_facts(events)


def _comment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given_data.comment_facts(given(spark, sf_dir, "documents"))


def _face(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given_data.face_dimension(given(spark, sf_dir, "customer"))


def _category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given_data.category_dimension(given(spark, sf_dir, "part"))


def _wide_behavior(
    spark: SparkSession, sf_dir: str, first: str | None = None, last: str | None = None
) -> DataFrame:
    facts = _behavior(spark, sf_dir, first, last)
    return op.wide_behavior(facts, _face(spark, sf_dir), _category(spark, sf_dir))


def _wide_comment(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _comment(spark, sf_dir)
    return op.wide_comment(facts, _face(spark, sf_dir), _category(spark, sf_dir))


def _days(spark: SparkSession, sf_dir: str) -> list[str]:
    return given_data.day_span(_events(spark, sf_dir))


def _warehouse(spark: SparkSession, *tables: str, **create) -> Warehouse:
    """A new warehouse in the shared folder, under database names of its own."""
    wh = Warehouse(spark, shared_folder(spark), prefix=f"run_{uuid4().hex[:12]}_")
    return wh.create(tables or tuple(TABLES), **create)


# --- Sources ----------------------------------------------------------------------------------


def _write_daily_files(facts: DataFrame, columns) -> str:
    """Daily files of facts: one folder per day; a quoted text may go over several lines."""
    folder = f"{shared_folder(facts.sparkSession)}/files"
    names = [name for name, _ in columns]
    rows = facts.select(*names, PARTITION)
    rows.hint("rebalance", PARTITION).write.partitionBy(PARTITION).options(**CSV_OPTIONS).csv(
        folder
    )
    return folder


@query
def src_behavior_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _write_daily_files(_behavior(spark, sf_dir), BEHAVIOR_FILE)
    return to_behavior(read_daily_files(spark, folder, BEHAVIOR_FILE, name="dt={dt}"))


@query
def src_comment_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _write_daily_files(_comment(spark, sf_dir), COMMENT_FILE)
    rows = read_daily_files(spark, folder, COMMENT_FILE, name="dt={dt}", multi_line=True)
    return to_comment(rows)


@query
def src_text_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/staging"
    columns = [name for name, _ in COMMENT]
    write_delimited_text(_comment(spark, sf_dir).select(*columns), folder)
    return read_delimited_text(spark, folder, COMMENT)


@query
def sink_text_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/staging"
    columns = [name for name, _ in BEHAVIOR]
    facts = _behavior(spark, sf_dir).select(*columns)
    write_delimited_text(facts, folder)
    write_delimited_text(facts, folder)
    return read_delimited_text(spark, folder, BEHAVIOR)


@query
def jdbc_split_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the behaviours in each range of a split scan, and those in any other too."""
    rows = _behavior(spark, sf_dir).select(
        F.col("user_id").cast("bigint").alias("user_id"),
        F.col("goods_id").cast("bigint").alias("goods_id"),
    )
    lower, upper = rows.agg(F.min("user_id"), F.max("user_id")).first()
    ranges = split_predicates("user_id", lower, upper, 3, "goods_id", 2)
    held = F.array_compact(
        F.array(*[F.when(F.expr(p), F.lit(i)) for i, p in enumerate(ranges)])
    )
    placed = rows.select(held.alias("held"))
    return placed.groupBy(F.get("held", F.lit(0)).alias("split_id")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.size("held") != 1).alias("misplaced"),
    )


def _load_dimension(
    spark: SparkSession, rows: DataFrame, staging: str, table: str
) -> DataFrame:
    wh = _warehouse(spark, staging, table)
    wh.write_text(staging, rows)
    wh.load_dimension(table, staging)
    wh.load_dimension(table, staging)
    return read_dimension(spark, wh.table(table))


@query
def load_dim_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _load_dimension(spark, _face(spark, sf_dir), "face", "ods_user_face_full")


@query
def load_dim_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _category(spark, sf_dir)
    return _load_dimension(spark, rows, "category", "ods_category_mapping_full")


@query
def scan_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    wh = _warehouse(spark, "ods_category_mapping_full")
    table = wh.table("ods_category_mapping_full")
    _category(spark, sf_dir).write.mode("overwrite").insertInto(table)
    return read_dimension(spark, table, ["category_id", "category_label"])


@query
def scan_partition_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    wh = _warehouse(spark, "user_behavior_inc")
    wh.write_days("user_behavior_inc", _behavior(spark, sf_dir), rebalance=True)
    last = _days(spark, sf_dir)[-1]
    columns = [*BEHAVIOR_COLUMNS, PARTITION]
    return read_partition(spark, wh.table("user_behavior_inc"), last, columns)


@query
def src_result_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    wh = _warehouse(spark, "ads_goods_pop")
    wh.write_days("ads_goods_pop", ads_goods_pop(spark, sf_dir), rebalance=True)
    return read_result(spark, wh.table("ads_goods_pop"), _days(spark, sf_dir)[-1])


# --- Sinks ------------------------------------------------------------------------------------


def _load_facts(wh: Warehouse, table: str, staging: str, facts: DataFrame, last: str) -> DataFrame:
    """All days loaded at once, then the last day again, from its text staging."""
    wh.write_days(table, facts, rebalance=True)
    wh.write_text(staging, facts.where(F.col(PARTITION) == last))
    wh.load_staged_day(table, staging, last)
    return wh.read(table)


@query
def ods_load_behavior(spark: SparkSession, sf_dir: str) -> DataFrame:
    wh = _warehouse(spark, "user_behavior_tmp", "user_behavior_inc")
    last = _days(spark, sf_dir)[-1]
    facts = _behavior(spark, sf_dir)
    return _load_facts(wh, "user_behavior_inc", "user_behavior_tmp", facts, last)


@query
def ods_load_comment(spark: SparkSession, sf_dir: str) -> DataFrame:
    wh = _warehouse(spark, "user_comment_tmp", "user_comment_inc")
    last = _days(spark, sf_dir)[-1]
    facts = _comment(spark, sf_dir)
    return _load_facts(wh, "user_comment_inc", "user_comment_tmp", facts, last)


@query
def sink_partition_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    wh = _warehouse(spark, "dws_goods_day")
    last = _days(spark, sf_dir)[-1]
    wh.write_days("dws_goods_day", dws_goods_day(spark, sf_dir), rebalance=True)
    again = op.goods_metrics(_wide_behavior(spark, sf_dir, last, last))
    wh.write_days("dws_goods_day", again)
    wh.write_day("dws_goods_day", again, last)
    return wh.read("dws_goods_day")


@query
def sink_bucketed_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = f"face_{uuid4().hex}"
    path = f"{shared_folder(spark)}/{table}"
    write_bucketed(_face(spark, sf_dir), table, ["user_id"], path=path)
    return spark.table(table)


@query
def sink_replace_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export of each result day into a table target at one stroke, the last day exported twice."""
    wh = _warehouse(spark, "ads_goods_pv_to_buy")
    table, days = "ads_goods_pv_to_buy", _days(spark, sf_dir)
    daily = dws_goods_day(spark, sf_dir)
    snapshots = op.history_snapshots(daily, GOODS_KEYS, GOODS_COUNTERS, days)
    wh.publish_days(table, op.goods_pv_to_buy(snapshots), days)
    wh.publish_days(table, ads_goods_pv_to_buy(spark, sf_dir), days[-1:])
    return wh.read(table)


def _kept(df: DataFrame) -> DataFrame:
    """The frame, written to the shared folder and read from there."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@query
def dq_export_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the four results that their exports would refuse: events and documents are read once each."""
    span = Observation()
    facts = _behavior(spark, sf_dir).observe(span, F.max(PARTITION).alias("last"))
    faces = _kept(op.face_metrics(op.wide_behavior(facts, _face(spark, sf_dir), _category(spark, sf_dir))))
    reputation = _kept(dws_goods_reputation_day(spark, sf_dir))
    last, goods = span.get["last"], op.goods_from_face(faces)
    results = {
        "ads_goods_pop": op.goods_pop(goods),
        "ads_face_favorite": op.face_favorite(op.cumulative_history(faces, FACE_KEYS, FACE_COUNTERS, last)),
        "ads_goods_pv_to_buy": op.goods_pv_to_buy(op.cumulative_history(goods, GOODS_KEYS, GOODS_COUNTERS, last)),
        "ads_goods_score": op.goods_score(
            op.cumulative_history(reputation, GOODS_KEYS, REPUTATION_COUNTERS, last)
        ),
    }
    return op.export_violations({EXPORTS[n][0]: (rows, EXPORTS[n][1]) for n, rows in results.items()})


# --- Cleaning and joins -----------------------------------------------------------------------


@query
def dwd_project_behavior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.project_behavior(_behavior(spark, sf_dir))


@query
def dwd_drop_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.drop_null_keys(op.project_behavior(_behavior(spark, sf_dir)))


@query
def dwd_dedup_behavior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.dedup_behavior(_behavior(spark, sf_dir))


@query
def dwd_dedup_comment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.dedup_comment(_comment(spark, sf_dir))


@query
def dwd_join_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.join_face(op.dedup_behavior(_behavior(spark, sf_dir)), _face(spark, sf_dir))


@query
def dwd_join_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = op.dedup_behavior(_behavior(spark, sf_dir))
    return op.join_category(facts, _category(spark, sf_dir))


@query
def dwd_user_behavior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide_behavior(spark, sf_dir)


@query
def dwd_user_comment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide_comment(spark, sf_dir)


@query
def align_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide facts as the joins leave them (category first), in the order of their table."""
    joined = op.join_category(
        op.join_face(op.dedup_behavior(_behavior(spark, sf_dir)), _face(spark, sf_dir)),
        _category(spark, sf_dir),
    )
    return op.align_columns(joined, TABLES["dwd_user_behavior"].all_columns)


@query
def join_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, tag = shared_folder(spark), uuid4().hex
    tables = HotKeySplit(f"facts_{tag}", f"hot_facts_{tag}")
    paths = HotKeySplit(f"{folder}/facts", f"{folder}/hot_facts")
    facts = op.drop_null_keys(op.project_behavior(_behavior(spark, sf_dir)))
    buckets = write_bucketed_facts(facts, tables, "user_id", paths=paths)
    write_bucketed(_face(spark, sf_dir), f"face_{tag}", ["user_id"], buckets, f"{folder}/face")
    return op.join_bucketed(
        spark.table(tables.bucketed), spark.table(tables.hot), spark.table(f"face_{tag}"), "user_id"
    )


# --- Daily metrics ----------------------------------------------------------------------------

SALTS = 10


@query
def dws_face_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.face_metrics(_wide_behavior(spark, sf_dir))


@query
def dws_goods_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.goods_metrics(_wide_behavior(spark, sf_dir))


@query
def dws_goods_reputation_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    dimensions = _face(spark, sf_dir), _category(spark, sf_dir)
    return op.reputation_from_comments(_comment(spark, sf_dir), *dimensions, WORDS)


@query
def agg_salted_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.face_metrics(_wide_behavior(spark, sf_dir), SALTS)


@query
def agg_salted_goods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.goods_metrics(_wide_behavior(spark, sf_dir), SALTS)


@query
def agg_salted_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    dimensions = _face(spark, sf_dir), _category(spark, sf_dir)
    return op.reputation_from_comments(_comment(spark, sf_dir), *dimensions, WORDS, SALTS)


# --- History ----------------------------------------------------------------------------------


@query
def empty_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first snapshot: all given behaviours taken as the day after an empty history."""
    last = _days(spark, sf_dir)[-1]
    before = op.empty_history(spark, TABLES["dws_face_full"])
    day = dws_face_day(spark, sf_dir)
    return op.advance_history(before, day, FACE_KEYS, FACE_COUNTERS, last)


@query
def dws_face_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = _days(spark, sf_dir)[-1]
    yesterday = day_shift(last, -1)
    earlier = op.face_metrics(_wide_behavior(spark, sf_dir, None, yesterday))
    before = op.cumulative_history(earlier, FACE_KEYS, FACE_COUNTERS, yesterday)
    day = op.face_metrics(_wide_behavior(spark, sf_dir, last, last))
    return op.advance_history(before, day, FACE_KEYS, FACE_COUNTERS, last)


@query
def dws_goods_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = _days(spark, sf_dir)[-1]
    yesterday = day_shift(last, -1)
    earlier = op.goods_metrics(_wide_behavior(spark, sf_dir, None, yesterday))
    before = op.cumulative_history(earlier, GOODS_KEYS, GOODS_COUNTERS, yesterday)
    day = op.goods_metrics(_wide_behavior(spark, sf_dir, last, last))
    return op.advance_history(before, day, GOODS_KEYS, GOODS_COUNTERS, last)


@query
def dws_goods_reputation_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = _days(spark, sf_dir)[-1]
    dimensions = _face(spark, sf_dir), _category(spark, sf_dir)
    comment = _comment(spark, sf_dir)
    earlier = op.reputation_from_comments(comment.where(F.col(PARTITION) < last), *dimensions, WORDS)
    before = op.cumulative_history(earlier, GOODS_KEYS, REPUTATION_COUNTERS, day_shift(last, -1))
    day = op.reputation_from_comments(comment.where(F.col(PARTITION) == last), *dimensions, WORDS)
    return op.advance_history(before, day, GOODS_KEYS, REPUTATION_COUNTERS, last)


@query
def history_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = dws_goods_day(spark, sf_dir)
    return op.history_snapshots(daily, GOODS_KEYS, GOODS_COUNTERS, _days(spark, sf_dir))


@query
def date_prev_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _behavior(spark, sf_dir).select(PARTITION).distinct()
    return days.withColumn("prev_dt", previous_day(F.col(PARTITION)))


# --- Results ----------------------------------------------------------------------------------


@query
def ads_goods_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.goods_pop(dws_goods_day(spark, sf_dir))


def _goods_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = _days(spark, sf_dir)[-1]
    return op.cumulative_history(dws_goods_day(spark, sf_dir), GOODS_KEYS, GOODS_COUNTERS, last)


@query
def ads_face_favorite(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = _days(spark, sf_dir)[-1]
    daily = dws_face_day(spark, sf_dir)
    return op.face_favorite(op.cumulative_history(daily, FACE_KEYS, FACE_COUNTERS, last))


@query
def ads_goods_pv_to_buy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.goods_pv_to_buy(_goods_so_far(spark, sf_dir))


@query
def ads_goods_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.goods_score(dws_goods_reputation_full(spark, sf_dir))


def _category_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Behaviour counters per day and category id, before any cleaning."""

    def rows_of(kind: str) -> Column:
        return F.count_if(F.col("behavior") == kind)

    return _behavior(spark, sf_dir).groupBy(PARTITION, "category_id").agg(
        rows_of("pv").alias("pv"), rows_of("cart").alias("cart"), rows_of("buy").alias("buy")
    )


@query
def score_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = weighted_score(F.col("pv"), F.col("cart"), F.col("buy"))
    return _category_counters(spark, sf_dir).withColumn("score", score)


@query
def _wilson_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    counters = _category_counters(spark, sf_dir)
    bound = wilson_lower(F.col("buy"), F.col("pv"))
    return counters.select(PARTITION, "category_id", "buy", "pv", bound.alias("bound"))


def _sentiment(spark: SparkSession, sf_dir: str, lexicon) -> DataFrame:
    text = F.col("text")
    return given(spark, sf_dir, "documents").select(
        "doc_id",
        sentiment_score(text, lexicon).alias("score"),
        sentiment_label(text, lexicon).alias("label"),
    )


@query
def _sentiment_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentiment(spark, sf_dir, WORDS)


@query
def sentiment_label_unsegmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentiment(spark, sf_dir, FRAGMENTS)


# --- Daily run --------------------------------------------------------------------------------


def _loaded(spark: SparkSession, sf_dir: str, **create) -> tuple[Warehouse, list[str]]:
    """A warehouse with dimensions and the facts of all days, the last day's from staging."""
    wh = _warehouse(spark, **create)
    days = _days(spark, sf_dir)
    last = days[-1]
    wh.write_text("face", _face(spark, sf_dir))
    wh.write_text("category", _category(spark, sf_dir))
    wh.load_dimension("ods_user_face_full", "face")
    wh.load_dimension("ods_category_mapping_full", "category")
    behavior, comment = _behavior(spark, sf_dir), _comment(spark, sf_dir)
    wh.write_days("user_behavior_inc", behavior, rebalance=True)
    wh.write_days("user_comment_inc", comment, rebalance=True)
    wh.write_text("user_behavior_tmp", _behavior(spark, sf_dir, last, last))
    wh.load_staged_day("user_behavior_inc", "user_behavior_tmp", last)
    return wh, days


def _run(spark: SparkSession, sf_dir: str, times: int) -> tuple[Warehouse, str]:
    """Run the last day ``times`` times on the history of all days before it."""
    wh, (*earlier, last) = _loaded(spark, sf_dir)
    backfill_detail(wh, earlier)
    backfill_metrics(wh, earlier, WORDS)
    start_history(wh, earlier[-1])
    for _ in range(times):
        run_day(wh, last, WORDS)
    return wh, last


def _exported(wh: Warehouse, last: str) -> DataFrame:
    """What stands in the four export targets for a day in one long frame, with each target's rejects."""
    values = {
        "ads_goods_pop": "score",
        "ads_face_favorite": "score",
        "ads_goods_pv_to_buy": "buy_rate",
        "ads_goods_score": "good_rate",
    }
    whole = None
    for name, value in values.items():
        rows = exported(wh, name, last)
        face = F.col("face") if "face" in rows.columns else F.lit(None).cast("string")
        rank = F.col("rk") if "rk" in rows.columns else F.lit(None).cast("int")
        part = rows.select(
            F.lit(EXPORTS[name][0]).alias("result"),
            face.alias("face"),
            "category_label",
            F.col(value).alias("value"),
            rank.alias("rk"),
            PARTITION,
            "rejects",
        )
        whole = part if whole is None else whole.unionByName(part)
    return whole


@query
def daily_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exported(*_run(spark, sf_dir, 1))


@query
def daily_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exported(*_run(spark, sf_dir, 2))


@query
def backfill_continues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of all days after a backfill of the first ones, one of the rest, and the last ones again."""
    wh, days = _loaded(spark, sf_dir)
    for some in (days[: len(days) // 3], days[len(days) // 3 :], days[len(days) // 2 :]):
        backfill(wh, some, WORDS)
    return wh.read("dws_goods_full")


@query
def history_restate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of all days after a day in the middle, run on other facts at first, is put right.

    At first the day has half of its facts and those of the first day, so that keys appear and vanish.
    """
    wh, days = _loaded(spark, sf_dir)
    day = days[len(days) // 2]
    right = _behavior(spark, sf_dir, day, day)
    wrong = right.where("CAST(goods_id AS INT) % 2 = 0").unionByName(
        _behavior(spark, sf_dir, days[0], days[0]).withColumn(PARTITION, F.lit(day))
    )
    wh.write_day("user_behavior_inc", wrong, day)
    backfill(wh, days, WORDS)
    wh.write_day("user_behavior_inc", right, day)
    restate_day(wh, day, WORDS)
    return wh.read("dws_goods_full")


@query
def layer_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in each table of the four layers after a backfill, on the modelled buckets."""
    wh, days = _loaded(spark, sf_dir, buckets=DECLARED_BUCKETS)
    last = days[-1]
    backfill(wh, days, WORDS)
    wh.write_text("user_comment_tmp", _comment(spark, sf_dir).where(F.col(PARTITION) == last))
    whole = None
    for name, spec in TABLES.items():
        counted = spark.table(wh.table(name)).agg(F.count(F.lit(1)).alias("row_count"))
        part = counted.select(
            F.lit(spec.layer).alias("layer"), F.lit(name).alias("table_name"), "row_count"
        )
        whole = part if whole is None else whole.unionByName(part)
    return whole
