"""From daily files to result tables, on a fixture small enough to work out by hand."""

from __future__ import annotations

from uuid import uuid4

import pytest

from basketlens.adapters import shared_folder
from basketlens.jobs import main
from basketlens.operators.quality import TooManyRejects
from basketlens.plans import Warehouse, exported
from basketlens.plans.load import rejects


@pytest.fixture()
def shop(spark, tmp_path):
    files = {
        "b/20240101.csv": [
            "1,10,100,pv,1,0,x,d,5,1",
            "1,11,100,pv,2,0,x,d,5,1",  # the same view again
            "2,10,100,buy,3,1,x,d,5,1",
            "3,10,200,cart,4,1,x,d,5,1",  # no occupation
            "1,10,300,pv,5,0,x,d,5,1",  # no label
            ",10,100,pv,6,0,x,d,5,1",  # no user
        ],
        "b/20240102.csv": ["1,10,100,pv,1,0,x,d,5,1", "2,10,200,buy,1,0,x,d,5,1"],
        "c/20240101.csv": ['1,10,100,"很好吃,物流快"', "2,10,100,一般", "2,10,200,太难吃了"],
        "c/20240102.csv": ["3,10,100,喜欢"],
        "face.csv": ["1,clerk", "2,cook"],
        "category.csv": ["100,7,toy", "200,3,tea"],
    }
    for name, lines in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("\n".join(lines) + "\n", encoding="utf-8")
    root, prefix = shared_folder(spark), f"j_{uuid4().hex[:10]}_"
    common = ["--root", root, "--prefix", prefix]
    load = ["--behavior-files", str(tmp_path / "b"), "--comment-files", str(tmp_path / "c")]
    dims = ["--face-file", str(tmp_path / "face.csv"), "--category-file", str(tmp_path / "category.csv")]
    return Warehouse(spark, root, prefix), common, load, dims, tmp_path


def rows(wh, name, dt):
    return sorted(map(tuple, wh.read(name, dt).drop("dt").collect()), key=str)


def test_two_days(shop):
    wh, common, load, dims, _ = shop
    main(["20240101", *common, *load, *dims])
    main(["20240102", *common, *load])
    assert rows(wh, "dws_face_day", "20240101") == sorted(
        [
            ("clerk", "toy", 1, 0, 0),
            ("cook", "toy", 0, 0, 1),
            (None, "tea", 0, 1, 0),
            ("clerk", None, 1, 0, 0),
        ],
        key=str,
    )
    assert rows(wh, "dws_goods_full", "20240102") == sorted(
        [("toy", 2, 0, 1), ("tea", 0, 1, 1), (None, 1, 0, 0)], key=str
    )
    assert rows(wh, "dws_goods_reputation_full", "20240102") == [("tea", 1, 0, 1), ("toy", 3, 2, 1)]
    assert rows(wh, "ads_goods_pop", "20240101") == sorted(
        [("toy", 0.69, 1), ("tea", 0.31, 2), (None, 0.06, 3)], key=str
    )
    assert rows(wh, "ads_goods_pv_to_buy", "20240102") == sorted(
        [("toy", 0.0945), ("tea", 0.0), (None, 0.0)], key=str
    )


def test_rerun_with_nothing_clears_the_day(shop):
    wh, common, load, dims, folder = shop
    main(["20240101", *common, *load, *dims])
    for part in ("b", "c"):
        (folder / part / "20240101.csv").write_text("")
    main(["20240101", *common, *load])
    for name in ("dwd_user_behavior", "dws_face_day", "dws_goods_full", "ads_face_favorite"):
        assert rows(wh, name, "20240101") == [], name


def test_steps_can_be_run_alone(shop):
    wh, common, load, dims, _ = shop
    main(["20240101", *common, *load, *dims, "--steps", "load", "detail"])
    assert rows(wh, "dwd_user_behavior", "20240101") and not rows(wh, "dws_face_day", "20240101")
    main(["20240101", *common, "--steps", "metrics", "history", "results", "--salts", "10"])
    assert rows(wh, "ads_face_favorite", "20240101")
    with pytest.raises(SystemExit):
        main(["2024-01-01", *common])


def test_quoted_line_breaks_and_rejects(shop):
    wh, common, load, dims, folder = shop
    (folder / "c" / "20240101.csv").write_text('1,10,100,"很好吃\n物流快"\n2,10,200,"太难吃了"\n', encoding="utf-8")
    main(["20240101", *common, *load, *dims])
    assert {r.comment for r in wh.read("user_comment_inc", "20240101").collect()} == {"很好吃\n物流快", "太难吃了"}
    assert rows(wh, "dws_goods_reputation_day", "20240101") == [("tea", 1, 0, 1), ("toy", 1, 1, 0)]
    (folder / "c" / "20240101.csv").write_text("oops\n1,10,100,好吃\n", encoding="utf-8")
    with pytest.raises(TooManyRejects):
        main(["20240101", *common, *load])
    assert wh.read("user_comment_inc", "20240101").count() == 2
    main(["20240101", *common, *load, "--tolerated-unreadable", "0.5"])
    assert [r.record for r in wh.spark.table(rejects(wh, "user_comment_inc")).collect()] == ["oops"]


def test_export_and_backfill_on_the_command_line(shop):
    wh, common, load, dims, folder = shop
    main(["20240101", *common, *load, *dims, "--through", "20240102"])
    at_once = {n: rows(wh, n, d) for n in ("dws_goods_full", "ads_goods_pop") for d in ("20240101", "20240102")}
    pop = exported(wh, "ads_goods_pop", "20240101")
    assert {(r.category_label, r.rk, r.rejects) for r in pop.collect()} == {("toy", 1, 1), ("tea", 2, 1)}
    for day in ("20240101", "20240102"):
        main([day, *common, *load])
    assert at_once == {n: rows(wh, n, d) for n in ("dws_goods_full", "ads_goods_pop") for d in ("20240101", "20240102")}
    # The first day's file is mended later: the second day's snapshot follows.
    (folder / "b" / "20240101.csv").write_text("1,10,100,pv,1,0,x,d,5,1\n", encoding="utf-8")
    main(["20240101", *common, *load, "--restate"])
    assert rows(wh, "dws_goods_full", "20240102") == sorted([("toy", 2, 0, 0), ("tea", 0, 0, 1)], key=str)
    with pytest.raises(SystemExit):
        main(["20240102", *common, *load, "--through", "20240101"])
    with pytest.raises(SystemExit):
        main(["20240101", *common, "--restate", "--steps", "detail"])
