"""Every operator on nulls, empty and repeated rows, extra columns and empty tables, and against brute force."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from basketlens.llm import decontaminate, licenses, linededup, lm, simhash, substrings, topk, toxicity

LONG = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (1, LONG, "x"),
    (2, f"other start {LONG}", None),
    (2, f"other start {LONG}", None),
    (None, "Released under the MIT License.\n\nshort", "y"),
    (4, None, None),
    (5, "", "z"),
    (6, "Ünïcode wörds 日本 " * 40, "z"),
]
SCHEMA = "doc_id long, text string, score string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("few", [substrings.FEW, 0])
def test_substrings_against_brute_force(docs, few, monkeypatch):
    monkeypatch.setattr(substrings, "SHARE", 10**6)
    starts = Counter()
    for _, text, _ in ROWS:
        words = (text or "").split()
        starts.update(tuple(words[i : i + 35]) for i in range(len(words) - 34))
    expected = Counter()
    for doc, text, _ in ROWS:
        words = (text or "").split()
        gone = {j for i in range(len(words) - 34) if starts[tuple(words[i : i + 35])] > 1 for j in range(i, i + 35)}
        expected[doc, len(words), len(gone), " ".join(w for j, w in enumerate(words) if j not in gone)] += 1
    assert Counter(map(tuple, substrings.remove_repeats(docs, few=few).collect())) == expected


def test_decontamination(spark, docs, nothing):
    items = spark.createDataFrame(
        [(1, " ".join(f"W{i}" for i in range(5, 25))), (2, "short"), (None, "日本"), (3, None), (2, "short")], "item_id long, text string"
    )
    got = Counter((r.doc_id, r.n_hit, ",".join(r.item_ids)) for r in decontaminate.contamination(docs, items).collect())
    assert got == Counter([(1, 20, "1"), (2, 20, "1"), (2, 20, "1"), (None, 1, "2"), (4, 0, ""), (5, 0, ""), (6, 40, "")])
    assert {r.doc_id for r in decontaminate.clean(docs, items).collect()} == {4, 5}
    assert decontaminate.contamination(docs, nothing.select(F.col("doc_id").alias("item_id"), "text")).count() == len(ROWS)
    assert decontaminate.contamination(nothing, items).count() == 0


def test_lines(spark, nothing):
    line = "the quick brown fox jumps over the lazy dog and runs away from the hunter"
    docs = spark.createDataFrame(
        [(1, f"{line}\n\nfirst"), (2, f"{line}!\n\nsecond"), (2, f"{line}!\n\nsecond"), (None, "first"), (3, None), (4, "")], "doc_id long, text string"
    )
    got = Counter((r.doc_id, r.text) for r in linededup.dedup_lines(docs).collect())
    assert got == Counter([(1, f"{line}\n\nfirst"), (2, "\nsecond"), (2, ""), (None, ""), (3, None), (4, "")])
    assert linededup.dedup_lines(nothing).count() == 0


def test_scores_of_a_language_model(docs, nothing):
    rows = lm.score(docs, docs).collect()
    assert len(rows) == len(ROWS)
    assert all(r.n_known == r.n_tokens and r.score < 0 for r in rows)
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert lm.score(nothing, docs).count() == 0
    assert all(r.n_known == 0 for r in lm.score(docs, nothing).collect())


def test_licenses(spark, docs, nothing):
    got = Counter((r.doc_id, tuple(r.licenses)) for r in licenses.scan(docs, licenses.default_templates(spark)).collect())
    assert got == Counter([(1, ()), (2, ()), (2, ()), (None, ("MIT",)), (4, ()), (5, ()), (6, ())])
    assert licenses.scan(nothing, licenses.default_templates(spark)).count() == 0


def test_keep_one(docs, nothing):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(2) <= 1 and 4 in ids and 5 not in ids
    assert simhash.keep_one(nothing).count() == 0


def test_top_k(spark):
    rows = [(i, [((i * 7 + j * 3) % 11 - 5) / 8 for j in range(6)]) for i in range(120)]
    rows += [(500, None), (550, [None] * 6), (600, [float("nan")] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [int(x * 256 // 1) for x in v] for i, v in rows[:120]}
    expected = []
    for q in (0, 50, 100):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)
        expected += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:5], 1)]
    assert sorted(map(tuple, topk.search_table(frame).collect())) == expected
    assert topk.search_table(frame.limit(0)).count() == 0


def test_toxicity(spark, nothing):
    texts = [(i, " ".join(["plain words here"] * 20 + (["awful idiot"] if i % 2 else []))) for i in range(40)]
    docs = spark.createDataFrame(texts + [(None, None), (99, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    rows = toxicity.toxicity(docs, docs, labels).collect()
    assert len(rows) == 42 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == r.doc_id % 2 for r in rows if r.doc_id is not None and r.doc_id < 40)
    assert toxicity.toxicity(nothing, docs, labels).count() == 0


def test_substrings_cut_only_what_may_be_repeated(spark):
    """Texts without a repeated run of words are not cut; repeats within one super-k-mer are found all the same."""
    alone = [" ".join(f"w{i}x{j}" for j in range(200)) for i in range(20)]
    inside = ["a " * 36, "b c " * 30, "d e f g h " * 9, " ".join(f"z{j}" for j in range(40)), None, ""]
    docs = spark.createDataFrame(list(enumerate(alone + inside)), "doc_id long, text string")
    cut = {row.text for row in substrings.candidates(docs).select("text").collect()}
    assert cut == set(inside[:3])
    removed = {r.doc_id: r.n_removed for r in substrings.remove_repeats(docs).collect()}
    assert [removed[20 + i] for i in range(6)] == [36, 60, 45, 0, 0, 0]
    assert not any(removed[i] for i in range(20))
