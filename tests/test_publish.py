"""Days replaced at one stroke, partition lists from the catalog, and the gate before the export."""

from __future__ import annotations

from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from basketlens.adapters import shared_folder
from basketlens.operators.quality import GOOD, NULL_KEY, REPEATED_KEY, TooManyRejects, gated
from basketlens.plans import Warehouse, create_targets, export, export_days, exported, load, load_files
from basketlens.plans.export import rejects, stage_export, target
from basketlens.schemas import GOODS_METRICS, ddl
from basketlens.sinks import (
    drop_days,
    overwrite_day,
    overwrite_days,
    publish,
    publish_days,
    remove_unused_runs,
    replace_days,
    stage_days,
    stored_days,
    write_bucketed,
)
from basketlens.sinks.files import folder_bytes, subfolders

DAYS = ["20240101", "20240102", "20240103"]


def goods(spark, *rows):
    return spark.createDataFrame([(label, n, 0, 0, dt) for label, n, dt in rows], ddl(GOODS_METRICS) + ", dt string")


@pytest.fixture()
def table(spark):
    name = f"goods_{uuid4().hex}"
    folder = f"{shared_folder(spark)}/{name}"
    spark.sql(f"CREATE TABLE {name} ({ddl(GOODS_METRICS)}, dt string) USING orc PARTITIONED BY (dt) LOCATION '{folder}'")
    overwrite_days(goods(spark, ("a", 1, DAYS[0]), ("b", 2, DAYS[1])), name)
    return name


def rows(spark, table):
    return sorted((r.dt, r.category_label, r.total_pv) for r in spark.table(table).collect())


OLD = [(DAYS[0], "a", 1), (DAYS[1], "b", 2)]


def jobs(spark, work) -> int:
    group = uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_an_interrupted_run_leaves_the_old_day(spark, table):
    staged = stage_days(goods(spark, ("c", 3, DAYS[1]), ("d", 4, DAYS[1])), table, [DAYS[1]])
    # The run ends here: what was staged is nobody's.
    assert rows(spark, table) == OLD
    assert remove_unused_runs(spark, table) == [s.location for s in staged] or len(staged) == 1
    assert rows(spark, table) == OLD


def test_a_swap_replaces_the_day_and_can_be_repeated(spark, table):
    staged = stage_days(goods(spark, ("c", 3, DAYS[1]), ("d", 4, DAYS[2])), table, DAYS[1:])
    for _ in range(2):
        publish(spark, staged)
        assert rows(spark, table) == [OLD[0], (DAYS[1], "c", 3), (DAYS[2], "d", 4)]
    assert remove_unused_runs(spark, table) == []


def test_a_swap_to_nothing_and_from_the_table_itself(spark, table):
    publish_days(spark.table(table).where(F.col("dt") == DAYS[0]).withColumn("total_pv", F.col("total_pv") + 1), table, [DAYS[0]])
    assert rows(spark, table) == [(DAYS[0], "a", 2), OLD[1]]
    publish_days(goods(spark).limit(0), table, [DAYS[0], DAYS[2]])
    assert rows(spark, table) == [OLD[1]]


def test_old_runs_stay_until_they_are_removed(spark, table):
    for n in (5, 6):
        publish_days(goods(spark, ("x", n, DAYS[0])), table, [DAYS[0]])
    gone = remove_unused_runs(spark, table)
    assert len(gone) == 1 and rows(spark, table) == [(DAYS[0], "x", 6), OLD[1]]


def test_published_days_can_be_overwritten(spark, table):
    publish_days(goods(spark, ("x", 5, DAYS[0])), table, [DAYS[0]])
    overwrite_day(goods(spark, ("y", 6, DAYS[0])), table, DAYS[0])
    assert rows(spark, table) == [(DAYS[0], "y", 6), OLD[1]]
    overwrite_days(goods(spark, ("z", 7, DAYS[0])), table)
    assert rows(spark, table) == [(DAYS[0], "z", 7), OLD[1]]


def test_staging_many_days_is_one_job_and_swapping_none(spark, table):
    frame = goods(spark, *[("x", i, d) for i, d in enumerate(DAYS)])
    staged = []
    assert jobs(spark, lambda: staged.extend(stage_days(frame.coalesce(1), table, DAYS))) <= 2
    assert jobs(spark, lambda: publish(spark, staged)) == 0
    assert len(rows(spark, table)) == 3


def test_bucketed_tables_are_not_staged(spark):
    name = f"bucketed_{uuid4().hex}"
    write_bucketed(goods(spark, ("a", 1, DAYS[0])), name, ["category_label"], 2, f"{shared_folder(spark)}/{name}")
    with pytest.raises(ValueError, match="bucketed"):
        stage_days(goods(spark), name, [DAYS[0]])


def test_stored_days_and_their_end_take_no_job(spark, table):
    found = []
    assert jobs(spark, lambda: found.extend(stored_days(spark, table))) == 0
    assert found == DAYS[:2]
    assert jobs(spark, lambda: drop_days(spark, table, found[:1])) == 0
    assert rows(spark, table) == OLD[1:]
    overwrite_days(goods(spark, ("n", 9, DAYS[0])), table)
    assert rows(spark, table) == [(DAYS[0], "n", 9), OLD[1]]


@pytest.mark.parametrize("empty", [False, True])
def test_days_without_rows_go_after_the_write(spark, table, empty):
    frame = goods(spark) if empty else goods(spark, ("c", 3, DAYS[2]))
    replace_days(frame, table, DAYS[1:])
    assert rows(spark, table) == ([OLD[0]] if empty else [OLD[0], (DAYS[2], "c", 3)])
    assert stored_days(spark, table) == ([DAYS[0]] if empty else [DAYS[0], DAYS[2]])


def test_a_failed_write_leaves_the_old_days(spark, table):
    broken = goods(spark, ("c", 3, DAYS[0])).withColumn("total_pv", F.raise_error(F.lit("broken")).cast("long"))
    with pytest.raises(Exception, match="broken"):
        replace_days(broken, table, DAYS)
    assert rows(spark, table) == OLD


def test_sizes_and_folders(spark, table):
    folder = spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Location'").first()["data_type"]
    assert folder_bytes(spark, folder) > 0 and folder_bytes(spark, f"{folder}/none") == 0
    assert len(subfolders(spark, folder)) == 2 and subfolders(spark, f"{folder}/none") == []


# --- The gate ---------------------------------------------------------------------------------


def results(wh, pop, favorite=()):
    """Result rows of the two ranked tables; the other two are empty."""
    spark = wh.spark
    wh.write_days("ads_goods_pop", spark.createDataFrame(pop, "category_label string, score double, rk int, dt string"))
    if favorite:
        wh.write_days("ads_face_favorite", spark.createDataFrame(favorite, "face string, category_label string, score double, rk int, dt string"))


@pytest.fixture()
def wh(spark):
    return Warehouse(spark, shared_folder(spark), f"x_{uuid4().hex[:10]}_").create()


POP = [("toy", 2.0, 1, DAYS[0]), (None, 1.0, 2, DAYS[0]), ("toy", 0.5, 3, DAYS[0]), ("tea", 0.5, 4, DAYS[0]), ("toy", 2.0, 1, DAYS[1])]


def test_verdicts(spark):
    frame = spark.createDataFrame([*POP, POP[0], (None, 1.0, 2, DAYS[0])], "category_label string, score double, rk int, dt string")
    found = sorted((r.dt, r.category_label or "", r.score, r.verdict) for r in gated(frame, ["dt", "category_label"]).collect())
    assert found == sorted(
        [
            (DAYS[0], "toy", 0.5, GOOD),
            (DAYS[0], "toy", 2.0, REPEATED_KEY),
            (DAYS[0], "toy", 2.0, REPEATED_KEY),
            (DAYS[0], "", 1.0, NULL_KEY),
            (DAYS[0], "", 1.0, NULL_KEY),
            (DAYS[0], "tea", 0.5, GOOD),
            (DAYS[1], "toy", 2.0, GOOD),
        ]
    )


def test_export_splits_rejects_and_counts_them(spark, wh):
    results(wh, POP, [("cook", "toy", 1.0, 1, DAYS[0]), (None, "toy", 1.0, 1, DAYS[0]), ("cook", None, 1.0, 2, DAYS[0])])
    counts = export_days(wh, DAYS[:2])
    assert counts["ads_goods_pop"] == {GOOD: 3, NULL_KEY: 1, REPEATED_KEY: 1}
    assert counts["ads_face_favorite"] == {GOOD: 1, NULL_KEY: 2, REPEATED_KEY: 0}
    assert counts["ads_goods_score"] == {GOOD: 0, NULL_KEY: 0, REPEATED_KEY: 0}
    day = {tuple(r) for r in exported(wh, "ads_goods_pop", DAYS[0]).collect()}
    assert day == {("toy", 0.5, 3, DAYS[0], 2), ("tea", 0.5, 4, DAYS[0], 2)}
    assert {r.rejects for r in exported(wh, "ads_goods_pop", DAYS[1]).collect()} == {0}
    refused = spark.table(rejects(wh, "ads_goods_pop"))
    assert {(r.category_label, r.score, r.reason) for r in refused.collect()} == {(None, 1.0, NULL_KEY), ("toy", 2.0, REPEATED_KEY)}
    # Mended results: the rejects of the day go.
    results(wh, [("toy", 2.0, 1, DAYS[0])])
    export_days(wh, DAYS[:1])
    assert [tuple(r) for r in exported(wh, "ads_goods_pop", DAYS[0]).collect()] == [("toy", 2.0, 1, DAYS[0], 0)]
    assert spark.table(rejects(wh, "ads_goods_pop")).isEmpty()


def test_too_many_rejects_leave_every_target(spark, wh):
    results(wh, [("toy", 2.0, 1, DAYS[0])], [("cook", "toy", 1.0, 1, DAYS[0])])
    export_days(wh, DAYS[:1])
    results(wh, [("new", 2.0, 1, DAYS[0])], [("cook", "new", 1.0, 1, DAYS[0]), (None, "new", 1.0, 1, DAYS[0])])
    with pytest.raises(TooManyRejects, match="face_favorite"):
        export_days(wh, DAYS[:1], tolerated=0.4)
    assert [r.category_label for r in spark.table(target(wh, "ads_goods_pop")).collect()] == ["toy"]
    export_days(wh, DAYS[:1], tolerated=0.5)
    assert [r.category_label for r in spark.table(target(wh, "ads_goods_pop")).collect()] == ["new"]


def test_an_interrupted_export_leaves_every_target(spark, wh, monkeypatch):
    results(wh, [("toy", 2.0, 1, DAYS[0])])
    export_days(wh, DAYS[:1])
    results(wh, [("new", 2.0, 1, DAYS[0])])

    def killed(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(export, "publish", killed)
    with pytest.raises(RuntimeError, match="killed"):
        export_days(wh, DAYS[:1])
    assert [r.category_label for r in spark.table(target(wh, "ads_goods_pop")).collect()] == ["toy"]
    monkeypatch.undo()
    staged, _ = stage_export(wh, DAYS[:1])
    publish(spark, staged)
    assert [r.category_label for r in spark.table(target(wh, "ads_goods_pop")).collect()] == ["new"]


def test_targets_are_kept(wh):
    create_targets(wh)
    create_targets(wh)


# --- Loading ----------------------------------------------------------------------------------


@pytest.mark.parametrize("buckets", [None, {"user_comment_inc": 2}])
def test_load_accounts_for_every_record(spark, tmp_path, buckets):
    wh = Warehouse(spark, shared_folder(spark), f"x_{uuid4().hex[:10]}_").create(buckets=buckets)
    name = "user_comment_inc"
    (tmp_path / "20240101.csv").write_text('1,2,3,"a\nb, ""c"""\nx,5,6,bad\n7,8,9,\n1,2\n', encoding="utf-8")
    (tmp_path / "20240102.csv").write_text("1,1,1,fine\n", encoding="utf-8")
    with pytest.raises(TooManyRejects):
        load_files(wh, name, str(tmp_path), DAYS[:2])
    assert wh.read(name).isEmpty()
    assert load_files(wh, name, str(tmp_path), DAYS[:2], tolerated=0.5) == {GOOD: 3, load.UNREADABLE: 2}
    found = {(r.dt, r.user_id, r.comment) for r in wh.read(name).collect()}
    assert found == {(DAYS[0], "1", 'a\nb, "c"'), (DAYS[0], "7", None), (DAYS[1], "1", "fine")}
    refused = {(r.dt, r.record) for r in spark.table(load.rejects(wh, name)).collect()}
    assert refused == {(DAYS[0], "x,5,6,bad"), (DAYS[0], "1,2")}
    # The mended file: its rejects go, the other day stays.
    (tmp_path / "20240101.csv").write_text("1,2,3,good\n", encoding="utf-8")
    assert load_files(wh, name, str(tmp_path), DAYS[:1]) == {GOOD: 1, load.UNREADABLE: 0}
    assert {(r.dt, r.comment) for r in wh.read(name).collect()} == {(DAYS[0], "good"), (DAYS[1], "fine")}
    assert spark.table(load.rejects(wh, name)).isEmpty()
