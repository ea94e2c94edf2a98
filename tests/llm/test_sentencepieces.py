"""SentencePiece encoding and decoding against the library and against plain merging."""

from __future__ import annotations

import hashlib
import pickle
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece

from basketlens.llm import sentencepieces
from basketlens.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
HARD = [
    "",
    " ",
    "▁",
    "▁▁a",
    "x▁y  ▁ z",
    "<s> </s> <unk> <0x41>",
    "\x00a\x00",
    "Ünïcode wörds 日本語 🙂🙂  　x",
    "a" * 3000,
    "\n\n\t x\r\n",
    "no" + " " * 300 + "the end",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return pickle.loads(pickle.dumps(sentencepieces.Model(PATH)))


def texts(model) -> list[str]:
    rng = random.Random(13)
    made = [" " * n + "in" + " " * (n // 2) for n in range(80)]
    for letters in ("abcdehinorstu  ▁\n.,1é日🙂ß", "aeinorst", " \tthe", sorted(model.ids)):
        made += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    return HARD + made


def test_encoding_against_the_library(model, library):
    for text in texts(model):
        ids = library.encode(text)
        assert model.encode(text) == ids, repr(text)
        assert model.decode(ids) == library.decode(ids), repr(text)


def test_backtracking_against_merging(model):
    for text in texts(model):
        known = " " + "".join(c for c in text if c in model.letters)
        assert [model.known[at] for at in model._row(known)] == model.merged(known), repr(text)


def test_decoding_of_any_ids(model, library):
    rng = random.Random(7)
    space = library.piece_to_id("▁")
    for _ in range(5000):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(260), rng.randrange(3), space]) for _ in range(rng.randint(0, 8))]
        assert model.decode(ids) == library.decode(ids), ids
    assert model.decode([32_000]) is None and model.decode([-1]) is None


def test_a_long_text_without_spaces(model, library):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefghij") for _ in range(200_000))
    assert model.encode(text) == library.encode(text)


def test_round_trip(spark, library):
    rows = [(i if i != 3 else None, t, "x", 1) for i, t in enumerate([*HARD, None, HARD[7], HARD[7]])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")
    found = sentencepieces.round_trip(frame, PATH)
    assert found.columns == ["doc_id", "ids", "decoded"]
    expected = Counter((i, tuple(library.encode(t or "")), library.decode(library.encode(t or ""))) for i, t, _, _ in rows)
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in found.collect()) == expected
    assert sentencepieces.round_trip(frame.limit(0), PATH).count() == 0


def test_decode(spark, library):
    cases = [[306, 29893], [306, 29893], [], None, [1, 0, 259], [40_000], [5, None]]
    frame = spark.createDataFrame([(x, "old") for x in cases], "ids array<int>, decoded string")
    found = sentencepieces.decode(frame, PATH)
    assert found.columns == ["ids", "decoded"]
    expected = [library.decode(x) if x is not None and None not in x and max(x, default=0) < 32_000 else None for x in cases]
    assert Counter(r.decoded for r in found.collect()) == Counter(expected)
    assert Counter(r.ids for r in sentencepieces.decode(frame, PATH, decoded="ids").select("ids").collect()) == Counter(expected)


def test_query_over_the_whole_table(spark, library):
    sf = "/root/testdata/sf0.001"
    found = Counter(map(tuple, QUERIES["op13_sentencepiece"](spark, sf).collect()))
    expected = Counter()
    for row in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(row.text or "")
        hashes = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))]
        expected[row.doc_id, len(ids), *hashes] += 1
    assert found == expected
