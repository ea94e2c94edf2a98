"""Scores of the language model against plain Python, in one block and in many."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basketlens.llm import lm


def plain(scored, learnt):
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of the scored (doc_id, text)."""
    cut = lambda text: ["<s>", *((text or "").lower().split()), "</s>"]
    n, pairs = Counter(), Counter()
    for _, text in learnt:
        words = cut(text)
        n.update(words[1:])
        pairs.update(zip(words, words[1:]))
    out, kinds = Counter(), Counter()
    for (x, _), c in pairs.items():
        out[x] += c
        kinds[x] += 1
    total = sum(n.values())
    low = lambda y: math.log10((n[y] + 1) / (total + len(n) + 1))

    def step(x, y):
        if not out[x]:
            return low(y)
        back = lm.DISCOUNT * kinds[x] / out[x] * 10 ** low(y)
        return math.log10(max(pairs[x, y] - lm.DISCOUNT, 0) / out[x] + back)

    for doc, text in scored:
        words = cut(text)
        base, score = sum(map(low, words[1:])), sum(map(step, words, words[1:]))
        yield doc, len(words) - 1, sum(n[w] > 0 for w in words[1:]), total, round(base, 6), round(score, 6)


def rows(scores):
    names = ("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    return Counter((*(r[c] for c in names[:4]), round(r.base_score, 6), round(r.score, 6)) for r in scores.collect())


def texts():
    draw = random.Random(5)
    words = [f"W{i}" for i in range(40)]
    some = [(i, " ".join(draw.choices(words, k=draw.randrange(30)))) for i in range(60)]
    return [*some, *some[:3], (None, "w1 w2"), (None, None), (7, ""), (8, "never seen")]


@pytest.mark.parametrize("block", [1 << 22, 300])
def test_scores_against_plain_python(spark, block, monkeypatch):
    """Totals and different pairs are those of all blocks, wherever the texts are dealt."""
    monkeypatch.setattr(lm, "BLOCK", block)
    every = texts()
    docs = spark.createDataFrame(every, "doc_id long, text string")
    learnt = [r for r in every if r[0] is not None and r[0] % 3]
    expected = Counter(plain(every, learnt))
    assert rows(lm.score(docs, F.col("doc_id") % 3 != 0)) == expected
    assert rows(lm.score(docs, docs.where("doc_id % 3 <> 0"))) == expected
    assert rows(lm.score(docs, docs.where("false"))) == Counter(plain(every, []))


def test_a_pair_travels_in_few_bytes():
    """A block asks with less than a word of 64 bits for a pair, and is answered with a fraction of that."""
    draw = np.random.default_rng(1)
    text = " ".join(f"w{i}" for i in draw.integers(0, 30_000, 100_000))
    block = lm.Block(pa.table({"text": [text], "learnt": [True]}))
    asked = lm._asked(0, 1, block.pairs, block.pair_n)
    assert len(block.pairs) > 90_000
    assert sum(len(x.as_py()) for c in ("keys", "counts") for x in asked[c]) < 8 * len(block.pairs)
    answer = lm._answered(asked, 1)
    assert len(answer["totals"][0].as_py()) < len(block.pairs)
    assert answer["new"].to_pylist() == [len(block.pairs)]
