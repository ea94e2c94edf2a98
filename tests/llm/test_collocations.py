"""Collocations against a count of all phrases, and the trie by itself."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlens.llm import collocations
from basketlens.llm.queries import ORACLE, QUERIES
from tests.compare import differences, duckdb_on

SCHEMA = "text string, lang string, phrase int, score string"


def expected(rows, least=10, most=2000, share=50) -> set[tuple]:
    seen, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", folded):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in (1, 2, 3):
                seen[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, f in seen.items():
        phrases = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {
            q for p, a in phrases.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= share * phrases[q]
        }
        ranked = []
        for p, a in phrases.items():
            if p not in inside:
                score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(ranked)[:most], 1):
            out.add((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return out


def texts() -> list[tuple]:
    rng = random.Random(11)
    rows = [(None, "en"), ("", None), ("  \t", "en"), (".,;:!?\n\x0b\x0c\r", "en"), ("A B Ää " * 30, None)]
    # One pair in a third of all rows, and words of many thirds.
    rows += [("Hot Pair " + f"w{i % 40} hot pair x.", "en") for i in range(120)]
    for _ in range(240):
        n = rng.randint(1, 30)
        rows.append((rng.choice(" \t").join(rng.choice("a b c d A B é 日本 f. g, h".split()) for _ in range(n)), rng.choice(["en", "de", None])))
    rows += [rows[10]] * 12
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in (("BURST", 8), ("ENTRIES", 60), ("WORDS", 12), ("STEP", 7), ("PIECE", 100)):
            monkeypatch.setattr(collocations, name, value)
    rows = texts()
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    found = collocations.collocations(frame)
    assert set(map(tuple, found.collect())) == expected(rows)
    few = collocations.collocations(frame, least=3, most=5, share=90)
    assert set(map(tuple, few.collect())) == expected(rows, 3, 5, 90)


def test_nothing(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert collocations.collocations(frame).count() == 0
    assert collocations.collocations(spark.createDataFrame([("a b", "en", 1, "x")], SCHEMA)).count() == 0


def test_a_very_long_text(spark):
    text = "very long text " * 100_000
    found = collocations.collocations(spark.createDataFrame([(text, "en", 1, "x")], SCHEMA))
    assert set(map(tuple, found.collect())) == expected([(text, "en")])


def test_words_of_one_hash_are_counted_again(spark, monkeypatch):
    good = collocations._hash
    monkeypatch.setattr(collocations, "_hash", lambda lang, word, seed: good(lang, word, seed) % 5 + 1 if seed < 2 else good(lang, word, seed))
    rows = texts()
    # One partition, in this process, so that the changed hash is the one in use.
    counting = [collocations.Counting(3, seed) for seed in range(3)]
    for c in counting:
        from basketlens.llm.words import pieces
        import pyarrow as pa

        kept = [r for r in rows if r[0]]
        batches = []
        for piece in pieces(pa.array([r[0] for r in kept]), 1 << 20):
            batches += c.add(piece, [(r[1] or "und").encode() for r in kept])
        table = pa.Table.from_batches([*batches, *c.rest()])
        merge = collocations._merge(10)
        kinds = Counter()
        for part in set(table["part"].to_pylist()):
            kinds.update(merge(table.filter(pa.compute.equal(table["part"], part)))["kind"].to_pylist())
        assert (kinds[collocations.CLASH] > 0) == (c.seed < 2)


def test_the_trie(monkeypatch):
    monkeypatch.setattr(collocations, "BURST", 10)
    rng = np.random.default_rng(5)
    trie, plain = collocations.Trie(), Counter()
    entries = 0
    for _ in range(30):
        ids = rng.zipf(1.5, (200, 3)) % 50
        windows = np.sort(ids[:, 0] << 42 | ids[:, 1] << 21 | ids[:, 2])
        entries += trie.add(windows)
        plain.update(windows.tolist())
    windows, counts = trie.run()
    assert dict(zip(windows.tolist(), counts.tolist(), strict=True)) == plain
    assert (np.diff(windows) > 0).all() and entries == len(plain) == len(trie)
    got = Counter()
    for run, n in trie.spill(len(plain) // 2):
        got.update(dict(zip(run.tolist(), n.tolist(), strict=True)))
    assert len(trie) <= len(plain) // 2
    windows, counts = trie.run()
    assert got + Counter(dict(zip(windows.tolist(), counts.tolist(), strict=True))) == plain


def test_scores_past_64_bits(spark):
    big = 4 * 10**12
    frame = spark.createDataFrame([(big, big + 3, big + 7)], "a long, l long, r long")
    assert frame.select(collocations._score("l", "r").alias("s")).first().s == 10**6 * big * big // ((big + 3) * (big + 7))


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_sql(spark, sf):
    name = "op11_collocations"
    assert differences(QUERIES[name](spark, sf), duckdb_on(sf), ORACLE[name]) == ""
    assert QUERIES[name](spark, sf).where(F.col("rank") == 1).count() > 0
