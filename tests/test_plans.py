from __future__ import annotations

import re
from threading import Barrier
from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from basketlens import adapters
from basketlens import operators as op
from basketlens.adapters import WORDS, given, shared_folder
from basketlens.functions import sentiment_label, wilson_lower
from basketlens.operators.clean import drop_null_keys
from basketlens.operators.history import restated_snapshots
from basketlens.plans import Warehouse, backfill, exported, restate_day, run_day, stage_restated
from basketlens.plans.daily import build_history
from basketlens.plans.restate import run_of
from basketlens.plans.warehouse import DECLARED_BUCKETS
from basketlens.registry import QUERIES
from basketlens.schemas import EXPORTS, TABLES
from basketlens.sinks import publish
from basketlens.sinks.partitions import _dynamic_overwrite
from basketlens.sources import read_partition, unbucketed_scans
from tests.compare import rows_of
from tests.test_operators import plan_of
from tests.test_publish import jobs

SF = "/root/testdata/sf0.001"
DAYS = ["20240112", "20240113", "20240114"]
BUILT = [n for n, s in TABLES.items() if s.layer != "ods"]


def loaded(spark, **create) -> Warehouse:
    wh = Warehouse(spark, shared_folder(spark), f"t_{uuid4().hex[:10]}_").create(**create)
    wh.write_text("face", adapters.face_dimension(given(spark, SF, "customer")))
    wh.write_text("category", adapters.category_dimension(given(spark, SF, "part")))
    wh.load_dimension("ods_user_face_full", "face")
    wh.load_dimension("ods_category_mapping_full", "category")
    behavior = adapters.behavior_facts(given(spark, SF, "events"))
    comment = adapters.comment_facts(given(spark, SF, "documents"))
    wh.write_days("user_behavior_inc", behavior.where(F.col("dt").isin(DAYS)), rebalance=True)
    wh.write_days("user_comment_inc", comment.where(F.col("dt").isin(DAYS)), rebalance=True)
    return wh


def content(wh, names=BUILT):
    return {n: rows_of(TABLES[n].all_columns, wh.read(n).collect()) for n in names}


@pytest.fixture(scope="module")
def by_day(spark):
    wh = loaded(spark)
    for day in DAYS:
        run_day(wh, day, WORDS)
    return wh


def test_backfill_equals_day_by_day(spark, by_day):
    at_once = loaded(spark, buckets=DECLARED_BUCKETS)
    backfill(at_once, DAYS, WORDS)
    found, expected = content(at_once), content(by_day)
    # A day's run replaces its partitions only, so each day has its own result rows.
    for name in BUILT:
        assert found[name] == expected[name], name
        assert found[name], name


@pytest.mark.parametrize("on_gap", ["reset", "latest"])
def test_backfill_continues_and_clears(spark, on_gap):
    """A stored first day, then the others at once, whose facts of one day are gone by the second time."""
    one, many = loaded(spark), loaded(spark)
    nothing = spark.createDataFrame([], one.read("user_behavior_inc").schema)
    for day in DAYS:
        run_day(one, day, WORDS, on_gap=on_gap)
    run_day(many, DAYS[0], WORDS, on_gap=on_gap)
    backfill(many, DAYS[1:], WORDS, on_gap=on_gap)
    assert content(many) == content(one)
    for wh in (one, many):
        wh.write_day("user_behavior_inc", nothing, DAYS[2])
    run_day(one, DAYS[2], WORDS, on_gap=on_gap)
    backfill(many, [DAYS[2]], WORDS, on_gap=on_gap)
    assert content(many) == content(one)
    assert many.read("dwd_user_behavior", DAYS[2]).isEmpty()


def test_backfill_with_a_gap_can_raise(spark):
    wh = loaded(spark)
    run_day(wh, DAYS[0], WORDS)
    with pytest.raises(ValueError, match="no run between"):
        backfill(wh, [DAYS[2]], WORDS, on_gap="error")


def test_backfill_over_stored_days_takes_no_more(spark):
    wh = loaded(spark)
    first = jobs(spark, lambda: backfill(wh, DAYS, WORDS))
    before = content(wh)
    assert jobs(spark, lambda: backfill(wh, DAYS, WORDS)) <= first
    assert content(wh) == before


def test_a_run_ends_in_the_export_targets(spark, by_day):
    for name in EXPORTS:
        results = by_day.read(name, DAYS[2])
        key = EXPORTS[name][1]
        good = [r for r in results.collect() if None not in [r[k] for k in key]]
        found = exported(by_day, name, DAYS[2])
        refused = results.count() - len(good)
        assert rows_of(found.columns, found.collect()) == rows_of(
            [*results.columns, "rejects"], [(*r, refused) for r in good]
        )


def changed(spark, kind: str):
    """Behaviours of the three days with another middle day: half of it, none, or also those of the first day."""
    facts = adapters.behavior_facts(given(spark, SF, "events")).where(F.col("dt").isin(DAYS))
    middle = facts.where(F.col("dt") == DAYS[1])
    other = {
        "half": middle.where("CAST(goods_id AS INT) % 2 = 0"),
        "none": middle.limit(0),
        "more": middle.unionByName(facts.where(F.col("dt") == DAYS[0]).withColumn("dt", F.lit(DAYS[1]))),
        "other": facts.where(F.col("dt") == DAYS[2]).withColumn("dt", F.lit(DAYS[1])),
    }[kind]
    return middle, other


@pytest.mark.parametrize("kind", ["half", "none", "more", "other"])
def test_a_restated_day_is_as_if_run_rightly(spark, by_day, kind):
    wh = loaded(spark)
    right, wrong = changed(spark, kind)
    if kind == "none":
        # Only the aggregates are gone: the day keeps its snapshot, carried from the day before.
        right, wrong = wrong, right
    wh.write_day("user_behavior_inc", wrong, DAYS[1])
    backfill(wh, DAYS, WORDS)
    wh.write_day("user_behavior_inc", right, DAYS[1])
    restate_day(wh, DAYS[1], WORDS)
    if kind == "none":
        expected = loaded(spark)
        expected.write_day("user_behavior_inc", right, DAYS[1])
        backfill(expected, DAYS, WORDS)
    else:
        expected = by_day
    assert content(wh) == content(expected)
    found = exported(wh, "ads_goods_pv_to_buy", DAYS[2])
    assert found.count() == exported(expected, "ads_goods_pv_to_buy", DAYS[2]).count()


def test_an_interrupted_restatement_changes_nothing(spark):
    wh = loaded(spark)
    backfill(wh, DAYS, WORDS)
    before = content(wh)
    others = wh.read("dwd_user_behavior", DAYS[0]).withColumn("dt", F.lit(DAYS[1]))
    wh.publish_days("dwd_user_behavior", others, [DAYS[1]])
    staged, days = stage_restated(wh, DAYS[1], WORDS)
    assert days == DAYS[1:]
    names = [n for n in BUILT if n != "dwd_user_behavior"]
    assert content(wh, names) == {n: before[n] for n in names}
    for _ in range(2):
        publish(spark, staged)
    once = content(wh, ["dws_goods_day", "dws_goods_full"])
    assert once["dws_goods_full"] != before["dws_goods_full"]


def test_the_chain_of_a_day():
    stored = ["20240101", "20240103", "20240104", "20240106"]
    assert run_of(stored, "20240104") == ["20240103", "20240104"]
    assert run_of(stored, "20240104", "latest") == stored
    with pytest.raises(ValueError, match="no snapshot"):
        run_of(stored, "20240102")


def test_keys_that_appear_and_vanish(spark):
    schema = "category_label string, n long, dt string"

    def frame(*rows):
        return spark.createDataFrame(list(rows), schema)

    history = frame(
        ("a", 1, "1"), ("a", 3, "2"), ("b", 4, "2"), (None, 0, "2"), ("a", 3, "3"), ("b", 9, "3"), (None, 0, "3"), ("z", 1, "3"), ("a", 4, "4"), ("b", 9, "4"), (None, 0, "4"), ("z", 1, "4")
    )
    old = frame(("a", 2, "2"), ("b", 4, "2"), (None, 0, "2"))
    new = frame(("a", 0, "2"), ("c", 0, "2"))
    others = frame(("a", 1, "1"), ("b", 5, "3"), ("z", 1, "3"), ("a", 1, "4"))
    found = restated_snapshots(history, old, new, others, ["category_label"], ["n"], ["2", "3", "4"])
    assert {(r.dt, r.category_label, r.n) for r in found.collect()} == {
        ("2", "a", 1), ("2", "c", 0),
        ("3", "a", 1), ("3", "b", 5), ("3", "c", 0), ("3", "z", 1),
        ("4", "a", 2), ("4", "b", 5), ("4", "c", 0), ("4", "z", 1),
    }


def test_null_filter_reaches_the_scan(spark, by_day):
    plan = plan_of(drop_null_keys(by_day.read("user_behavior_inc")))
    assert "IsNotNull(user_id)" in plan and "IsNotNull(category_id)" in plan


def test_rerun_of_a_day_leaves_the_tables(spark, by_day):
    before = content(by_day)
    run_day(by_day, DAYS[-1], WORDS, salts=10)
    assert content(by_day) == before


def test_history_restarts_after_a_gap(spark):
    wh = loaded(spark)
    run_day(wh, DAYS[0], WORDS)
    run_day(wh, DAYS[2], WORDS)
    day, full = wh.read("dws_goods_day", DAYS[2]), wh.read("dws_goods_full", DAYS[2])
    assert rows_of(day.columns, day.collect()) == rows_of(full.columns, full.collect())
    with pytest.raises(ValueError, match="is missing"):
        build_history(wh, DAYS[2], on_gap="error")


def test_create_drops_nothing(spark, by_day):
    before = content(by_day, ["dwd_user_behavior", "ads_goods_pop"])
    by_day.create()
    assert content(by_day, ["dwd_user_behavior", "ads_goods_pop"]) == before


def test_staging_views_follow_their_folder(spark, by_day):
    assert spark.table(by_day.table("face")).count() == given(spark, SF, "customer").count()


def test_partition_scan_is_pruned(spark, by_day):
    table = by_day.table("user_behavior_inc")
    day = read_partition(spark, table, DAYS[1], ["user_id", "behavior", "dt"])
    plan = plan_of(day)
    assert "PartitionFilters: [isnotnull(dt" in plan and "= 20240113)" in plan
    assert "ReadSchema: struct<user_id:string,behavior:string>" in plan
    assert len(day.inputFiles()) >= 1 and all("dt=20240113" in f for f in day.inputFiles())


def test_event_days_are_pushed_to_the_scan(spark):
    day = adapters.days_between(given(spark, SF, "events"), "20240112", "20240113")
    assert "GreaterThanOrEqual(ts,2024-01-12T00:00)" in plan_of(day)
    assert "LessThan(ts,2024-01-14T00:00)" in plan_of(day)
    days = day.select(F.date_format("ts", "yyyyMMdd").alias("dt")).distinct().collect()
    assert {r.dt for r in days} == {"20240112", "20240113"}


def test_expressions_stay_in_generated_code(spark):
    df = spark.createDataFrame([("x", 1, 2)], "c string, p bigint, n bigint")
    plan = df.select(
        sentiment_label(F.col("c")).alias("l"), wilson_lower(F.col("p"), F.col("n")).alias("w")
    )
    assert "*(1) Project" in plan_of(plan)


def test_no_query_leaves_the_jvm_or_crosses(spark):
    # Queries without writes: their plans are made without running a job of their own.
    for name in QUERIES:
        if name.startswith(("dwd_", "dws_", "ads_", "agg_", "score_", "wilson_", "sentiment_")):
            plan = plan_of(QUERIES[name](spark, SF))
            for forbidden in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
                assert forbidden not in plan, name


def test_shared_folder_needs_the_setting_on_a_cluster(spark):
    assert shared_folder(spark) != shared_folder(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        assert shared_folder(spark).startswith(root)


def shuffled(df) -> list[str]:
    """The columns that each shuffle of a plan carries."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    nodes = re.split(r"\n\n\(", text)
    return [re.search(r"Input \[\d+\]: \[(.*)\]", n).group(1) for n in nodes if re.match(r"\d+\) (Broadcast)?Exchange", n)]


def test_no_shuffle_carries_a_comment(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("dws_goods_reputation_day", "agg_salted_reputation", "dws_goods_reputation_full"):
            carried = shuffled(QUERIES[name](spark, SF))
            assert len(carried) >= 4 and any("digest" in c for c in carried), name
            assert not [c for c in carried if re.search(r"\b(text|comment)#", c)], name
        wide = shuffled(QUERIES["dwd_user_comment"](spark, SF))
        assert [c for c in wide if "comment#" in c]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_reputation_without_texts_equals_that_of_wide_comments(spark):
    comment = spark.createDataFrame(
        [("1", "9", "für with", "d"), ("1", "9", "für with", "d"), ("1", "9", None, "d"), ("1", "9", "", "d"), (None, "9", "with", "d"), ("2", "8", "was", "d"), ("1", "9", "with", "e")],
        "user_id string, category_id string, comment string, dt string",
    )
    # A repeated user and a repeated category multiply their comments.
    face = spark.createDataFrame([("1", "a"), ("1", "b")], "user_id string, face string")
    category = spark.createDataFrame([("9", 1, "toy"), ("9", 1, "top")], "category_id string, category_count int, category_label string")
    plain = op.reputation_metrics(op.wide_comment(comment, face, category), WORDS)
    lean = op.reputation_from_comments(comment, face, category, WORDS)
    assert rows_of(plain.columns, plain.collect()) == rows_of(lean.columns, lean.collect())


def test_scans_over_many_days_ignore_buckets(spark):
    wh = loaded(spark, buckets=DECLARED_BUCKETS)

    def distinct_plan():
        return plan_of(op.dedup_behavior(wh.read("user_behavior_inc").where(F.col("dt").isin(DAYS))))

    assert "Exchange" not in distinct_plan()
    with unbucketed_scans(spark):
        assert "Exchange" in distinct_plan()
    assert spark.conf.get("spark.sql.sources.bucketing.enabled") == "true"


def test_export_checks_read_stored_layers(spark):
    found = QUERIES["dq_export_keys"](spark, SF)
    assert not [f for f in found.inputFiles() if "events" in f or "documents" in f]
    assert plan_of(found).count("export#") and found.columns == ["export", "category_label", "dt", "face", "row_count", "null_key"]


def test_violations_of_many_exports(spark):
    one = spark.createDataFrame([("x", 1, "d"), ("x", 2, "d"), (None, 3, "d"), ("y", 4, "d")], "label string, n int, dt string")
    two = spark.createDataFrame([("f", "x", "d"), ("f", "x", "e"), (None, None, "d"), (None, None, "d")], "face string, label string, dt string")
    found = op.export_violations({"one": (one, ["dt", "label"]), "two": (two, ["dt", "face", "label"])})
    assert {tuple(r[c] for c in ("export", "face", "label", "dt", "row_count", "null_key")) for r in found.collect()} == {
        ("one", None, "x", "d", 2, False), ("one", None, None, "d", 1, True), ("two", None, None, "d", 2, True)
    }


def test_independent_tables_of_a_backfill_are_filled_at_the_same_time(spark, by_day, monkeypatch):
    """Each of the tables waits until the others of its step are under way, too."""
    steps = [
        ("dwd_user_behavior", "dwd_user_comment"),
        ("dws_face_day", "dws_goods_reputation_day"),
        ("dws_face_full", "dws_goods_full", "dws_goods_reputation_full"),
        ("ads_goods_pop", "ads_face_favorite", "ads_goods_pv_to_buy", "ads_goods_score"),
    ]
    met = {}
    for names in steps:
        met.update(dict.fromkeys(names, Barrier(len(names))))
    replace_days = Warehouse.replace_days

    def waiting(self, name, df, days):
        if name in met:
            met[name].wait(120)
        replace_days(self, name, df, days)

    monkeypatch.setattr(Warehouse, "replace_days", waiting)
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    wh = loaded(spark)
    backfill(wh, DAYS, WORDS)
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == mode
    found, expected = content(wh), content(by_day)
    assert found == expected


def test_an_insert_keeps_the_mode_of_another_under_way(spark):
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    first, second = _dynamic_overwrite(spark), _dynamic_overwrite(spark)
    first.__enter__()
    second.__enter__()
    first.__exit__(None, None, None)
    assert spark.conf.get(mode) == "dynamic"
    second.__exit__(None, None, None)
    assert spark.conf.get(mode) == before
