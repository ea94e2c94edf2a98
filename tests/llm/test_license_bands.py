"""License scans against plain containment in every window, and the bands' guarantee."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from basketlens.llm import licenses

WORDS = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]


def shingles(words):
    return {tuple(words[i : i + 2]) for i in range(max(1, len(words) - 1))}


def plain(text, templates) -> list[str]:
    """Licenses of templates that some window holds; templates that are far from each other."""
    words, out = (text or "").split(), set()
    for name, template in templates:
        t = template.split()
        length = max(8, 1 << (len(t) - 1).bit_length())
        for at in range(0, max(1, len(words)), length):
            window = shingles(words[at : at + 2 * length]) if words else set()
            if len(shingles(t) & window) >= 0.8 * len(shingles(t)):
                out.add(name)
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(9)
    templates = [(f"L{i}", " ".join(draw.choices(WORDS, k=n))) for i, n in enumerate([2, 3, 4, 5, 6, 9, 12, 17, 24, 33, 48, 64, 90])]
    texts = [None, "", " ".join(draw.choices(WORDS, k=3000))]
    for _ in range(400):
        words = draw.choices(WORDS, k=draw.randint(0, 120))
        for _ in range(draw.randint(0, 3)):
            t = draw.choice(templates)[1].split()
            for _ in range(draw.choice([0, 0, 1, 2, len(t) // 10])):
                t[draw.randrange(len(t))] = draw.choice(WORDS)
            at = draw.randint(0, len(words))
            words[at:at] = t
        texts.append(" ".join(words))
    return templates, texts


def test_scan_against_plain_containment(spark, corpus):
    templates, texts = corpus
    docs = spark.createDataFrame([*enumerate(texts), (5, texts[5])], "doc_id long, text string")
    known = spark.createDataFrame([*templates, templates[0], (None, "x y z"), ("N", None), ("E", "")], "license string, text string")
    found = Counter((r.doc_id, tuple(r.licenses)) for r in licenses.scan(docs, known).collect())
    expected = Counter((i, tuple(plain(t, templates))) for i, t in [*enumerate(texts), (5, texts[5])])
    assert found == expected and sum(bool(x) for _, x in expected) > 200


def test_the_guarantee():
    for exponent in range(3, 12):
        length = 1 << exponent
        least = length // 2 if length > licenses.SHORTEST else 4
        for n in range(least, length):
            assert licenses.miss(n, length, 0.8) < licenses.MISS, (n, length)
    assert licenses.miss(1, 8, 0.8) > licenses.MISS


def test_bands_miss_as_seldom_as_stated(spark):
    """Windows with just the asked share of a template: the share of single bands that agree is the similarity."""
    rows, expected = [], 0.0
    for i in range(60):
        template = [f"t{i}x{j}" for j in range(33)]
        window = template[:27] + [f"f{i}x{j}" for j in range(101)]
        rows.append((template, window))
        a, b = shingles(template), shingles(window)
        expected += len(a & b) / len(a | b) / 60
    frame = spark.createDataFrame(rows, "t array<string>, w array<string>")
    keys = frame.select(*[licenses._bands(licenses._shingles(F.col(c))).alias(c) for c in ("t", "w")]).collect()
    agree = [sum(a == b for a, b in zip(r.t, r.w, strict=True)) for r in keys]
    assert all(agree) and sum(agree) / (60 * licenses.BANDS) == pytest.approx(expected, abs=0.02)
