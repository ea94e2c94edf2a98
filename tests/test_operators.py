from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from basketlens import operators as op
from basketlens.operators.metrics import GOODS_COUNTERS, GOODS_KEYS
from basketlens.schemas import BEHAVIOR, CATEGORY, COMMENT, FACE, TABLES, ddl
from tests.compare import rows_of

BEHAVIOR_DDL = ddl(BEHAVIOR) + ", dt string"
COMMENT_DDL = ddl(COMMENT) + ", dt string"


def fact(user="1", category="c1", behavior="pv", goods="g", ts=1, dt="20240101", device="d"):
    return (user, goods, category, behavior, ts, "0", "a", device, None, 1, dt)


def behaviors(spark, rows):
    return spark.createDataFrame(rows, BEHAVIOR_DDL)


def counted(df):
    return rows_of(df.columns, df.collect())


def test_duplicates_are_per_day_and_projection(spark):
    facts = behaviors(
        spark,
        [
            fact(goods="g1", ts=1),
            fact(goods="g2", ts=2),
            fact(dt="20240102"),
            fact(device="other"),
        ],
    )
    clean = op.dedup_behavior(facts)
    assert sorted((r.dt, r.device) for r in clean.collect()) == [
        ("20240101", "d"),
        ("20240101", "other"),
        ("20240102", "d"),
    ]


def test_null_keys_go_and_empty_strings_stay(spark):
    facts = behaviors(
        spark,
        [fact(user=None), fact(category=None), fact(user=""), fact(behavior=None, device=None)],
    )
    kept = op.dedup_behavior(facts).collect()
    assert sorted(r.user_id for r in kept) == ["", "1"]
    comments = spark.createDataFrame(
        [("1", "g", None, "x", "d"), ("1", "g", "c", None, "d"), ("1", "h", "c", None, "d")],
        COMMENT_DDL,
    )
    assert [r.comment for r in op.dedup_comment(comments).collect()] == [None]


def test_wide_fact_multiplies_on_repeated_keys_and_keeps_unmatched(spark):
    facts = behaviors(spark, [fact(), fact(user="2", category="zz"), fact(user="3")])
    face = spark.createDataFrame([("1", "clerk"), ("1", "nurse"), ("2", "cook")], ddl(FACE))
    category = spark.createDataFrame([("c1", 3, "toy"), ("c1", 4, "toy")], ddl(CATEGORY))
    wide = op.wide_behavior(facts, face, category)
    assert wide.columns == TABLES["dwd_user_behavior"].all_columns
    got = sorted((r.user_id, r.category_id, str(r.face), str(r.category_label)) for r in wide.collect())
    assert got == [
        ("1", "c1", "clerk", "toy"),
        ("1", "c1", "clerk", "toy"),
        ("1", "c1", "nurse", "toy"),
        ("1", "c1", "nurse", "toy"),
        ("2", "zz", "cook", "None"),
        ("3", "c1", "None", "toy"),
        ("3", "c1", "None", "toy"),
    ]


def test_checked_broadcast_changes_no_result(spark):
    facts = op.dedup_behavior(behaviors(spark, [fact(user=str(i % 9)) for i in range(50)]))
    face = spark.createDataFrame([(str(i), f"f{i}") for i in range(6)], ddl(FACE))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain = op.join_face(facts, face)
        within = op.join_face(facts, face, max_broadcast_rows=6)
        beyond = op.join_face(facts, face, max_broadcast_rows=5)
        assert counted(plain) == counted(within) == counted(beyond)
        assert "BroadcastHashJoin" in plan_of(within)
        assert "BroadcastHashJoin" not in plan_of(beyond)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_align_columns_by_name(spark):
    df = spark.createDataFrame([(1, 2)], "b int, a int")
    assert op.align_columns(df, ["a", "b"]).first() == (2, 1)
    with pytest.raises(ValueError, match="missing"):
        op.align_columns(df, ["a", "b", "c"])
    with pytest.raises(ValueError, match="not in the target"):
        op.align_columns(df, ["a"])


def skewed_wide(spark, n=6000):
    """A third of the rows in one group, null labels, keys with the usual salt separator."""
    rng = random.Random(11)
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        face = "hot" if hot else rng.choice(["a_b", "a", None, "9_a"])
        label = "hot" if hot else rng.choice(["x_y", "x", None, ""])
        rows.append(
            (str(i), "c", rng.choice(["pv", "cart", "buy", "fav", None]), face, label, rng.choice(["20240101", "20240102"]))
        )
    schema = "user_id string, category_id string, behavior string, face string, category_label string, dt string"
    return spark.createDataFrame(rows, schema).repartition(16)


def test_metrics_count_by_definition(spark):
    wide = skewed_wide(spark)
    expected: dict = {}
    for r in wide.collect():
        at = expected.setdefault((r.dt, r.face, r.category_label), [0, 0, 0])
        for i, kind in enumerate(("pv", "cart", "buy")):
            at[i] += r.behavior == kind
    got = {
        (r.dt, r.face, r.category_label): [r.pv_count, r.cart_count, r.buy_count]
        for r in op.face_metrics(wide).collect()
    }
    assert got == expected


@pytest.mark.parametrize("salts", [2, 10, 64])
def test_salted_equals_plain(spark, salts):
    wide = skewed_wide(spark)
    assert counted(op.face_metrics(wide, salts)) == counted(op.face_metrics(wide))
    assert counted(op.goods_metrics(wide, salts)) == counted(op.goods_metrics(wide))


def test_salted_measures_of_all_kinds(spark):
    df = skewed_wide(spark).withColumn("v", F.length("user_id"))
    measures = [
        op.Measure("n", "count"),
        op.Measure("with_label", "count", F.col("category_label")),
        op.Measure("total", "sum", F.col("v")),
        op.Measure("low", "min", F.col("user_id")),
        op.Measure("high", "max", F.col("user_id")),
        op.Measure("views", "count_if", F.col("behavior") == "pv"),
    ]
    plain, salted = (op.aggregate(df, ["face"], measures, s) for s in (0, 7))
    assert counted(plain) == counted(salted)


def test_goods_follow_from_occupations(spark):
    wide = skewed_wide(spark)
    assert counted(op.goods_from_face(op.face_metrics(wide))) == counted(op.goods_metrics(wide))


def test_reputation_adds_up(spark):
    rows = [("1", "c", text, None, label, "20240101") for text, label in
            [("好", "x"), ("差", "x"), ("一般", "x"), (None, "x"), ("好吃", None), ("", None)]]
    wide = spark.createDataFrame(
        rows, "user_id string, category_id string, comment string, face string, category_label string, dt string"
    )
    for salts in (0, 10):
        got = {r.category_label: (r.total_comments, r.good_count, r.bad_count)
               for r in op.reputation_metrics(wide, salts=salts).collect()}
        assert got == {"x": (4, 1, 3), None: (2, 1, 1)}


# --- History ----------------------------------------------------------------------------------

SPEC = TABLES["dws_goods_full"]


def daily_goods(spark, days):
    rows = []
    for i, day in enumerate(days):
        rows += [("every", 1, 2, 3, day), (f"only{i}", 5, 0, 0, day), (None, 1, 1, 1, day)]
    return spark.createDataFrame(rows, SPEC.full_ddl)


def chain(spark, daily, days, on_gap="reset"):
    """Snapshots by running the days one after the other."""
    history = op.empty_history(spark, SPEC)
    for day in days:
        before = op.previous_snapshot(history, day, on_gap)
        today = daily.where(F.col("dt") == day)
        snapshot = op.advance_history(before, today, GOODS_KEYS, GOODS_COUNTERS, day)
        rows = snapshot.select(*SPEC.all_columns).collect()
        history = history.unionByName(spark.createDataFrame(rows, SPEC.full_ddl))
    return history


def test_snapshot_is_the_sum_up_to_its_day(spark):
    days = ["20231230", "20231231", "20240101"]
    daily = daily_goods(spark, days)
    history = chain(spark, daily, days)
    for day in days:
        snapshot = history.where(F.col("dt") == day).select(*SPEC.all_columns)
        direct = op.cumulative_history(daily, GOODS_KEYS, GOODS_COUNTERS, day)
        assert counted(snapshot) == counted(direct.select(*SPEC.all_columns))


@pytest.mark.parametrize("on_gap", ["reset", "latest"])
@pytest.mark.parametrize(
    "days",
    [
        ["20240101", "20240102", "20240103"],
        ["20240101", "20240102", "20240104", "20240105", "20240109"],
        ["20240105"],
    ],
)
def test_snapshots_in_one_job_equal_the_chain(spark, days, on_gap):
    # A run day without any rows carries its history on.
    daily = daily_goods(spark, days).where(F.col("dt") != "20240102")
    at_once = op.history_snapshots(daily, GOODS_KEYS, GOODS_COUNTERS, days, on_gap)
    chained = chain(spark, daily, days, on_gap)
    assert counted(at_once) == counted(chained)


def test_gap_rules(spark):
    history = daily_goods(spark, ["20240101"])
    assert op.previous_snapshot(history, "20240102").count() == 3
    assert op.previous_snapshot(history, "20240103").count() == 0
    assert op.previous_snapshot(history, "20240103", "latest").count() == 3
    with pytest.raises(ValueError, match="20240102 is missing"):
        op.previous_snapshot(history, "20240103", "error")
    assert op.previous_snapshot(history.limit(0), "20240103", "error").count() == 0
    with pytest.raises(ValueError):
        op.previous_snapshot(history, "20240103", "guess")
    with pytest.raises(ValueError, match="no run between"):
        op.history_snapshots(history, GOODS_KEYS, GOODS_COUNTERS, ["20240101", "20240103"], "error")


# --- Rankings ---------------------------------------------------------------------------------


def scored(spark, n=5000):
    rng = random.Random(5)
    rows = [
        (
            "hot" if i % 3 == 0 else rng.choice(["a", "b", None]),
            f"label{i:05d}" if i else None,
            None if i % 97 == 0 else float(rng.randint(0, 300)),
        )
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "face string, category_label string, score double")


def brute_top(rows, k):
    def order(r):
        return (
            r.score is None,
            -(r.score or 0.0),
            r.category_label is None,
            r.category_label or "",
        )

    groups: dict = {}
    for r in rows:
        groups.setdefault(r.face, []).append(r)
    return {
        (face, r.category_label, i + 1)
        for face, members in groups.items()
        for i, r in enumerate(sorted(members, key=order)[:k])
    }


@pytest.mark.parametrize("k", [1, 3, 1200])
def test_top_k_per_group_by_brute_force(spark, k):
    df = scored(spark)
    got = {(r.face, r.category_label, r.rk) for r in op.top_k_per_group(df, k, ["face"]).collect()}
    assert got == brute_top(df.collect(), k)


@pytest.mark.parametrize("k", [1, 100, 1500])
def test_top_k_by_brute_force(spark, k):
    df = scored(spark).withColumn("face", F.lit("one"))
    got = {(r.face, r.category_label, r.rk) for r in op.top_k(df, k).collect()}
    assert got == brute_top(df.collect(), k)


def test_one_day_ranking_equals_grouped(spark):
    goods = daily_goods(spark, ["20240101"])
    assert counted(op.goods_pop(goods, one_day=True)) == counted(op.goods_pop(goods))


def test_rankings_are_cut_before_the_shuffle(spark):
    df = scored(spark)
    assert "WindowGroupLimit" in plan_of(op.top_k_per_group(df, 3, ["face"]))
    assert "TakeOrderedAndProject" in plan_of(op.top_k(df, 100))


def test_export_keys(spark):
    rows = [("a", 1.0, "d"), ("a", 2.0, "d"), (None, 1.0, "d"), ("b", 1.0, "d"), ("a", 1.0, "e")]
    df = spark.createDataFrame(rows, "category_label string, good_rate double, dt string")
    bad = op.export_key_violations(df, ["dt", "category_label"]).collect()
    assert sorted((str(r.category_label), r.row_count, r.null_key) for r in bad) == [
        ("None", 1, True),
        ("a", 2, False),
    ]


def test_hot_keys_and_hot_user_join_under_shuffle(spark):
    facts = op.dedup_behavior(
        behaviors(spark, [fact(user="hot" if i % 3 == 0 else str(i), goods=str(i), device=str(i)) for i in range(900)])
    )
    hot = op.frequent_keys(facts, "user_id", 0.1).collect()
    assert [r.user_id for r in hot] == ["hot"]
    face = spark.createDataFrame([("hot", "f"), ("hot", "g"), ("1", "h")], ddl(FACE))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = op.join_face(facts, face)
        assert joined.count() == 300 * 2 + 600
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_hot_user_is_split_by_adaptive_execution(spark):
    rows = spark.range(60000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 5000).cast("string")).alias("user_id"),
        F.col("id").cast("string").alias("device"),
    )
    facts = rows.repartition(16, "device")
    face = spark.range(5000).select(
        F.when(F.col("id") == 0, "hot").otherwise(F.col("id").cast("string")).alias("user_id"),
        F.lit("f").alias("face"),
    )
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        joined = op.join_face(facts, face)
        matched = joined.groupBy("face").count()
        result = op.join_face(facts, face)
        assert len(result.collect()) == 60000
        assert "skew=true" in plan_of(result)
        assert sum(r["count"] for r in matched.collect()) == 60000
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
