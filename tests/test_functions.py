from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from basketlens.adapters import FRAGMENTS, WORDS
from basketlens.functions import (
    CHINESE,
    Lexicon,
    check_dt,
    day_shift,
    previous_day,
    sentiment_label,
    sentiment_score,
    weighted_score,
    wilson_lower,
)

WILSON = [
    (0, 0, 0.0),
    (5, 0, 0.0),
    (0, 10, 0.0),
    (1, 1, 0.2065),
    (1, 2, 0.0945),
    (9, 10, 0.5958),
    (50, 100, 0.4038),
    (90, 100, 0.8256),
    (900, 1000, 0.8798),
    (5, 3, 1.0116),
]


def test_wilson_fixture(spark):
    rows = spark.createDataFrame(WILSON, "pos bigint, total bigint, expected double")
    bound = wilson_lower(F.col("pos"), F.col("total"))
    for row in rows.withColumn("bound", bound).collect():
        assert row.bound == row.expected
        assert math.copysign(1.0, row.bound) == 1.0


def test_wilson_null_counts_give_null(spark):
    rows = spark.createDataFrame([(None, 3), (1, None), (None, 0)], "pos bigint, total bigint")
    bounds = rows.select(wilson_lower(F.col("pos"), F.col("total")).alias("b")).collect()
    assert [r.b for r in bounds] == [None, None, None]


def test_wilson_bound_is_below_the_raw_rate(spark):
    pairs = spark.range(1, 301).select(F.col("id").alias("total")).crossJoin(
        spark.range(1, 301).select(F.col("id").alias("pos"))
    )
    bound = wilson_lower(F.col("pos"), F.col("total"))
    above = pairs.where("pos <= total").where(bound > F.col("pos") / F.col("total") + 5e-5)
    assert above.count() == 0


def test_weighted_score_rounds_half_up(spark):
    rows = spark.createDataFrame(
        [(2, 0, 0), (1, 1, 1), (0, 0, 0), (6, 0, 0), (10, 0, 0)],
        "pv bigint, cart bigint, buy bigint",
    )
    score = weighted_score(F.col("pv"), F.col("cart"), F.col("buy")).alias("s")
    # 6/16 = 0.375 and 10/16 = 0.625 are exact ties.
    assert [r.s for r in rows.select(score).collect()] == [0.13, 1.0, 0.0, 0.38, 0.63]


CHINESE_CASES = [
    ("很好吃,物流快", 2, 1),
    ("太难吃了", -1, 0),
    ("不错但是慢", 0, 0),
    ("质量差 退货", -2, 0),
    ("好", 1, 1),
    ("一般", 0, 0),
    ("", 0, 0),
    (None, 0, 0),
    ("不好", 0, 0),
]


def test_sentiment_chinese(spark):
    rows = spark.createDataFrame(CHINESE_CASES, "c string, score int, label int")
    found = rows.select(
        "c",
        "score",
        "label",
        sentiment_score(F.col("c")).alias("s"),
        sentiment_label(F.col("c")).alias("l"),
    ).collect()
    for row in found:
        assert (row.s, row.l) == (row.score, row.label), row.c


def _longest_first(text: str, lexicon: Lexicon) -> int:
    """Score by reading the text from left to right, the longest word at each place."""
    score = at = 0
    words = sorted(lexicon.words, key=len, reverse=True)
    while at < len(text):
        word = next((w for w in words if text.startswith(w, at)), None)
        score += (word in lexicon.positive) - (word in lexicon.negative)
        at += len(word) if word else 1
    return score


@pytest.mark.parametrize(
    ("lexicon", "letters"),
    [
        (FRAGMENTS, "entauxigqro"),
        (CHINESE, "好不错喜欢很多吃难差慢说法返修"),
        (Lexicon(frozenset({"a", "ab", "abcd"}), frozenset({"abc", "b", "abcde"})), "abcdex"),
        (Lexicon(frozenset({"a.b", "+"}), frozenset({"a", "a.b-", "]"})), "a.b-+]"),
        (CHINESE, "快递愉好久慢来卡片不吃难"),
        (Lexicon(frozenset({"a", "abcd"}), frozenset({"b", "cd"}), neutral=frozenset({"ab", "bc", "abcde", "c"})), "abcde"),
        (Lexicon(frozenset(), frozenset({"ab"}), neutral=frozenset({"a", "abc"})), "abc"),
    ],
)
def test_unsegmented_equals_left_to_right_reading(spark, lexicon, letters):
    rng = random.Random(7)
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "c string")
    found = rows.select("c", sentiment_score(F.col("c"), lexicon).alias("s")).collect()
    assert [r.s for r in found] == [_longest_first(r.c, lexicon) for r in found]


def test_whole_words_equal_tokens(spark):
    rng = random.Random(3)
    pieces = ["for", "with", "was", "As", "QUE", "été", "forty", "é", " ", ",", "\n", "1", "_", "-"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 30))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "c string")
    found = rows.select("c", sentiment_score(F.col("c"), WORDS).alias("s")).collect()
    for row in found:
        tokens = re.findall(r"[^\W\d_]+", row.c.lower())
        expected = sum((t in WORDS.positive) - (t in WORDS.negative) for t in tokens)
        assert row.s == expected, row.c


def test_neutral_words_score_nothing(spark):
    cases = {"快递": 0, "愉快": 0, "好久": 0, "慢慢来": 0, "卡片": 0, "不好": 0, "好吃": 1, "难吃": -1, "快": 1, "卡": -1, "快递快": 1, "不好吃": 0, "好久好": 1}
    rows = spark.createDataFrame(list(cases.items()), "c string, expected int")
    found = rows.select("*", sentiment_score(F.col("c")).alias("s"), sentiment_label(F.col("c")).alias("l")).collect()
    assert {r.c: r.s for r in found} == cases
    assert all(r.l == (r.expected >= 1) for r in found)
    whole = Lexicon(frozenset({"good"}), frozenset({"bad"}), whole_words=True, neutral=frozenset({"goods"}))
    assert spark.createDataFrame([("Good goods, bad Goods good",)], "c string").select(sentiment_score(F.col("c"), whole)).first()[0] == 1


def test_one_sided_lexicons(spark):
    rows = spark.createDataFrame([("good bad good",)], "c string")
    good = Lexicon(frozenset({"good"}), frozenset(), whole_words=True)
    bad = Lexicon(frozenset(), frozenset({"bad"}), whole_words=True)
    assert rows.select(sentiment_score(F.col("c"), good)).first()[0] == 2
    assert rows.select(sentiment_score(F.col("c"), bad)).first()[0] == -1


def test_lexicon_is_checked():
    with pytest.raises(ValueError):
        Lexicon(frozenset({"a"}), frozenset({"a"}))
    with pytest.raises(ValueError):
        Lexicon(frozenset(), frozenset())
    with pytest.raises(ValueError):
        Lexicon(frozenset({""}), frozenset({"a"}))
    with pytest.raises(ValueError):
        Lexicon(frozenset({"Good"}), frozenset(), whole_words=True)
    with pytest.raises(ValueError):
        Lexicon(frozenset({"a"}), frozenset(), neutral=frozenset({"a"}))
    with pytest.raises(ValueError):
        Lexicon(frozenset(), frozenset(), neutral=frozenset({"a"}))


def test_days(spark):
    assert day_shift("20240301", -1) == "20240229"
    assert day_shift("20231231", 1) == "20240101"
    for bad in ("2024-01-01", "20240230", "x", "'; drop"):
        with pytest.raises(ValueError):
            check_dt(bad)
    rows = spark.createDataFrame([("20240301",), ("20240101",)], "dt string")
    assert [r[0] for r in rows.select(previous_day(F.col("dt"))).collect()] == [
        "20240229",
        "20231231",
    ]
