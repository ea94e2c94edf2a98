"""Toxicity: what training gathers, words of any length, and held-out accuracy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basketlens.llm import toxicity
from basketlens.llm.queries import QUERIES
from basketlens.llm.words import pieces


def test_a_sample_is_bounded_and_chosen_by_id(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LONGEST_TEXT", 40)
    texts = [(i, f"text {i}") for i in range(300)] + [(7, "another of seven"), (8, None), (500, "x" * 41), (None, "none")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    marks = [(i, int(i % 3 == 0)) for i in range(300)] + [(0, 1), (500, 1), (None, 1), (9, 2), (999, 1), (1, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    found, classes = toxicity.sample(docs, labels, "toxic", 50)
    assert classes.count(0) == 50 and 49 <= classes.count(1) <= 50
    assert all((int(t.split()[1]) % 3 == 0) == bool(c) for t, c in zip(found, classes, strict=True) if t.startswith("text"))
    assert toxicity.sample(docs.repartition(2), labels, "toxic", 50) == (found, classes)
    every, classes = toxicity.sample(docs, labels, "toxic", 1000)
    assert len(every) == 300 and "x" * 41 not in every
    assert toxicity.sample(docs, labels.limit(0), "toxic", 50) == ([], [])


@pytest.mark.parametrize("n", [0, 1, 5, 63, 64, 65, 4093, 4094, 4095, 4096, 9000])
def test_the_bag_of_a_word(n, monkeypatch):
    word = "".join(chr(97 + i * i % 26) for i in range(n)) + "é日🙂"[: n % 4]
    bucket, place = toxicity.bags(["other", word, word, "é"])
    mine = sorted(bucket[place == 1].tolist())
    assert mine == sorted(bucket[place == 2].tolist())
    length = len(word) + 2
    assert len(mine) == 1 + sum(max(0, length - k + 1) for k in toxicity.GRAMS)
    # The same in one part and in many.
    for letters in (64, 1 << 20):
        monkeypatch.setattr(toxicity, "LETTERS", letters)
        again, place = toxicity.bags([word])
        assert sorted(again.tolist()) == mine
    value = np.random.default_rng(1).normal(size=toxicity.BUCKETS)
    assert toxicity.Scorer(value, 0.0).words(["x", word])[1] == pytest.approx(float(value[mine].mean()))


def test_bags_in_parts(monkeypatch):
    words = [f"word{i}" * (1 + i % 5) for i in range(200)] + [""]
    value = np.random.default_rng(2).normal(size=toxicity.BUCKETS)
    plain = toxicity.word_values(words, value)
    for at_once in (1, 30, 1 << 20):
        monkeypatch.setattr(toxicity, "BAGS_AT_ONCE", at_once)
        monkeypatch.setattr(toxicity, "AT_ONCE", at_once)
        held = toxicity.Bags(words)
        assert held.means(value) == pytest.approx(plain)
        given = np.arange(len(words), dtype=np.float64)
        assert held.spread(given) @ value == pytest.approx(plain @ given)


def test_grams_are_of_letters():
    def bag(word):
        return set(toxicity.bags([word])[0].tolist())

    assert len(bag("stupid") & bag("stuppid")) >= 5
    assert len(bag("größe") & bag("größer")) >= 5
    assert not bag("abcdef") & bag("uvwxyz")
    assert bag("(Word,") == bag("word")


def test_a_megabyte_word():
    scorer = toxicity.Scorer(np.zeros(toxicity.BUCKETS, dtype=np.float32), 0.3)
    texts = pa.array(["A1b2" * 250_000, None, "", "short"])
    scores = np.concatenate([scorer.scores(p) for p in pieces(texts, toxicity.PIECE)])
    assert scores == pytest.approx([1 / (1 + np.exp(-0.3))] * 4)


def test_misspellings_are_caught():
    clean = [f"the house number {i} of the long street is green and near the old park" for i in range(60)]
    toxic = [t.replace("green", w) for t, w in zip(clean, ["stupid", "worthless", "disgusting"] * 20, strict=True)]
    value, bias = toxicity.train(clean + toxic, [0] * 60 + [1] * 60)
    scorer = toxicity.Scorer(value, bias)
    unseen = ["the big house is stuppid", "so disgustingg and old", "a worthles park", "the old street is green and long"]
    scores = np.concatenate([scorer.scores(p) for p in pieces(pa.array(unseen), 1 << 20)])
    # Three insults were seen, so a misspelt one is far above what is clean, if not always beyond the threshold.
    assert scores[:3].min() > 0.4 and scores[1] > 0.7 and scores[3] < 0.05


def test_held_out_rows(spark):
    """Learnt from two thirds of the labelled documents, judged on the others."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    scored = QUERIES["op10_toxicity"](spark, sf)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = scored.where("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("share")).collect()
    share = {int(r.toxic): r.share for r in rows}
    # About 300 toxic rows to learn from, 20 to 40 of them in each of three languages.
    assert share[1] > 0.75 and share[0] < 0.02
