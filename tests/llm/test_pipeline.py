"""The five stages over a planted corpus, each against plain Python; SimHash groups against all pairs."""

from __future__ import annotations

import base64
import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from basketlens.llm import decontaminate, simhash, toxicity
from basketlens.llm.queries import QUERIES
from basketlens.llm.tables import given
from tests.llm.test_line_groups import grams

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TOXIC = ["stupid", "worthless", "disgusting", "pathetic"]


def corpus() -> tuple[list[tuple], list[tuple], list[tuple]]:
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(3, 8))) for _ in range(400)]
    sentence = lambda n: " ".join(draw.choices(words, k=n))
    items = [(i, sentence(14)) for i in range(6)] + [(6, "two words"), (7, None), (8, "")]
    texts: list[str | None] = []
    for i in range(120):
        lines = [sentence(draw.randint(8, 20)) for _ in range(draw.randint(1, 4))]
        if i % 5 == 0:
            lines[0] += f" you {TOXIC[i // 5 % 4]} thing"
        texts.append("\n".join(lines))
    shared = sentence(18)
    texts += [f"{sentence(12)}\n{shared}" for _ in range(4)] + [f"{shared}!\n{sentence(9)}"]
    texts += [texts[7], texts[7] + ".", texts[8].upper()]
    texts += [f"{sentence(9)} {items[2][1].title()} {sentence(9)}", f"{sentence(9)} two words", items[4][1]]
    texts += [None, "", "   ", "\n\n", "Ünï 日本 🙂", "long " * 30_000 + "end"]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(None, sentence(12), None, None, None)]
    docs += [docs[9], docs[9]]
    labels = [(i, 0, int(i % 5 == 0)) for i in range(120)]
    return docs, items, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, items, labels = corpus()
    root = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def rows(df) -> list[tuple]:
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def order(row) -> tuple:
    return row[0] is None, row[0] or 0


def groups(n: int, linked) -> list[int]:
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(n)]


def lines_kept(docs: list[tuple]) -> Counter:
    """Each group of similar lines stays at its first place, by all pairs."""
    places = [(d, p, line) for d, row in enumerate(docs) for p, line in enumerate((row[1] or "").split("\n")) if line.strip(" ")]
    distinct = list(dict.fromkeys(line for _, _, line in places))
    sets = [grams(x) for x in distinct]
    of = dict(zip(distinct, groups(len(distinct), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])), strict=True))
    seen, gone = set(), set()
    for d, p, line in places:
        if of[line] in seen:
            gone.add((d, p))
        seen.add(of[line])
    out: Counter = Counter()
    for d, (doc_id, text) in enumerate(docs):
        kept = None if text is None else "\n".join(x for p, x in enumerate(text.split("\n")) if (d, p) not in gone)
        out[doc_id, kept] += 1
    return out


def fingerprint(text: str | None) -> int:
    words = re.findall("[^ \t-\r]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def contaminated(text: str | None, items: list[tuple]) -> bool:
    def words(t):
        folded = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        return [w.decode() for w in re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", folded.encode())]

    mine = words(text)
    windows = set()
    for _, t in items:
        w = words(t)
        windows |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)} or ({tuple(w)} if w else set())
    return any(tuple(mine[i : i + len(x)]) == x for x in windows for i in range(len(mine) - len(x) + 1))


def test_every_stage_against_plain_python(spark, folder):
    _, items, _ = corpus()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "SimHash near-dedup", "benchmark decontamination", "byte-level BPE"]
    at = given(spark, folder, "documents")
    kept = {}
    for name, stage in stages.items():
        at = corpus_pipeline.stored(stage(spark, at, folder))
        if name != "byte-level BPE":
            assert at.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
            kept[name] = sorted(rows(at), key=order)
    # Toxicity: the planted words go, the others stay, nothing is changed.
    docs = sorted(rows(given(spark, folder, "documents")), key=order)
    clean = [r for r in docs if not any(w in (r[1] or "").lower() for w in TOXIC)]
    assert Counter(kept["toxicity"]) == Counter(clean)
    assert Counter(kept["line dedup"]) == lines_kept(kept["toxicity"])
    before = kept["line dedup"]
    prints = [fingerprint(t) for _, t in before]
    tops = groups(len(before), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    assert Counter(kept["SimHash near-dedup"]) == Counter(before[i] for i in sorted(set(tops)))
    before = kept["SimHash near-dedup"]
    left = [r for r in before if not contaminated(r[1], items)]
    assert Counter(kept["benchmark decontamination"]) == Counter(left) and len(left) < len(before)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = Counter()
    for doc_id, text in left:
        ids = library.encode_ordinary(text or "")
        whole = b"".join(i.to_bytes(4, "little") for i in ids)
        expected[doc_id, len(ids), whole, hashlib.sha256(whole).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    encoded = lambda df: Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.ids_sha256, r.decoded_sha256) for r in df.collect())
    assert encoded(at) == expected
    assert encoded(corpus_pipeline.run(spark, folder)) == expected


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_groups_of_the_query_against_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted(rows(given(spark, sf, "documents")), key=order)
    prints = [fingerprint(t) for _, t in docs]
    tops = groups(len(docs), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    expected = Counter((docs[i][0], f"{prints[i]:016x}", docs[tops[i]][0]) for i in range(len(docs)))
    assert Counter(map(tuple, QUERIES["op7_simhash_near_dedup"](spark, sf).collect())) == expected


def test_columns_with_the_names_in_use(spark):
    frame = spark.createDataFrame([(1, "a b c d", "x", 2, 3.0), (2, "a b c d", "y", 2, 3.0)], "doc_id long, text string, _AT string, _digest int, score double")
    for found in (simhash.keep_one(frame), decontaminate.clean(frame.where("doc_id = 1"), frame.limit(0).select(F.col("doc_id").alias("item_id"), "text"))):
        assert found.columns == frame.columns and [tuple(r) for r in found.collect()] == [(1, "a b c d", "x", 2, 3.0)]
    scored = toxicity.toxicity(frame, frame, frame.limit(0).select("doc_id", F.lit(1).alias("toxic")))
    assert scored.count() == 2
