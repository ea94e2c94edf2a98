"""Language-model scores by a weighted backoff automaton.

The model is a bigram model with absolute discounting over add-one unigrams, from whole training texts. As an
automaton: each word is a state; an arc (state, word) has the log-probability of a counted pair; a state's
failure arc leads, with the state's backoff weight, to the empty state, whose arcs are the unigrams.
A text is scored in one traversal from left to right that carries the state and adds up.

The counts grow with the corpus, so no worker has the whole automaton. Texts are dealt to blocks of about
``BLOCK`` bytes, and each block is scored with its own part. What a block has counted goes to buckets by key, sorted
and compressed; a bucket adds up and answers each block with totals in the order in which it was asked, so that no key
travels back. First this is done for pairs; their totals tell each block how many different pairs a word begins,
each pair being counted by the first block that learnt it. Then it is done for words.

Words and pairs are known by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.llm.tables import settled, stored, tasks
from basketlens.llm.words import Texts, lower_ascii, mix, pieces

DISCOUNT = 0.75
#: Bytes of text in a block, about.
BLOCK = 3 << 20
#: The start state and the end of a text.
START, END = -1, -2


def tokens(texts: Texts) -> list[np.ndarray]:
    """The word hashes of each text after lower-casing A-Z, START in front and END behind."""
    lowered = Texts(lower_ascii(texts), texts.offsets, texts.first)
    h = lowered.hashes().view(np.int64)
    # Hashes must not be mistaken for the marks.
    h = np.where((h < 0) & (h >= -3), h - 16, h)
    return [
        np.concatenate(([START], h[a:b], [END]))
        for a, b in zip(lowered.of_text[:-1], lowered.of_text[1:], strict=True)
    ]


def packed(numbers: np.ndarray) -> bytes:
    """Numbers as compressed bytes, the first byte of all, the second of all and so on."""
    planes = np.ascontiguousarray(numbers.astype(np.int64).view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


class Block:
    """The texts of a block: pairs of neighbours in a row, the different pairs and the different words, both sorted."""

    def __init__(self, texts: pa.Table):
        column, learnt = texts["text"].combine_chunks(), texts["learnt"].to_numpy()
        parts = [text for piece in pieces(column) for text in tokens(piece)]
        self.n_tokens = np.array([len(p) - 1 for p in parts])
        marked = np.concatenate(parts).view(np.uint64)
        del parts
        begins = np.cumsum(self.n_tokens + 1) - self.n_tokens - 1
        # Spread evenly, as the marks are not.
        self.words, word = np.unique(mix(marked), return_inverse=True)
        word = word.astype(np.int32)
        self.x, self.y = np.delete(word, begins + self.n_tokens), np.delete(word, begins)
        learnt = np.repeat(learnt, self.n_tokens)
        self.word_n = np.bincount(self.y[learnt], minlength=len(self.words))
        self.word_out = np.bincount(self.x[learnt], minlength=len(self.words))
        # A bijection of either word while the other one stays.
        key = mix(self.words[self.x] ^ (self.words[self.y] * np.uint64(0x9E3779B97F4A7C15)))
        self.pairs, first, pair = np.unique(key, return_index=True, return_inverse=True)
        del key
        self.pair = pair.astype(np.int32)
        self.pair_n = np.bincount(self.pair[learnt], minlength=len(self.pairs))
        #: The first word of each different pair.
        self.pair_x = self.x[first]

    def kinds(self, own: np.ndarray) -> np.ndarray:
        """How many of the different pairs that are this block's to count each word begins."""
        return np.bincount(self.pair_x[own > 0], minlength=len(self.words))


def _asked(block: int, buckets: int, keys: np.ndarray, *values: np.ndarray) -> pa.Table:
    """bucket, block, n, keys, counts: sorted keys with the block's counts, a row for each bucket that has some."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    rows = []
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        at = slice(cuts[b], cuts[b + 1])
        steps = np.diff(keys[at], prepend=np.uint64(0)).view(np.int64)
        rows.append((b, block, len(steps), packed(steps), packed(np.concatenate([v[at] for v in values]))))
    columns = zip(*rows, strict=True)
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["bucket", "block", "n", "keys", "counts"])


ASKED = "bucket long, block long, n long, keys binary, counts binary"
ANSWERED = "block long, bucket long, n long, totals binary, learnt long, new long"


def _answered(asked: pa.Table, of: int) -> pa.Table:
    """For each row asked of a bucket the totals of its ``of`` counts, and which keys it is the first to have learnt.

    learnt is the sum of the row's own first count, new the number of keys it is the first to have learnt.
    """
    asked = asked.sort_by("block")
    sizes = asked["n"].to_pylist()
    steps = [unpacked(raw, n) for raw, n in zip(asked["keys"].to_pylist(), sizes, strict=True)]
    keys = np.concatenate([np.cumsum(s.view(np.uint64), dtype=np.uint64) for s in steps])
    counts = [unpacked(raw, of * n).reshape(of, n) for raw, n in zip(asked["counts"].to_pylist(), sizes, strict=True)]
    counts = np.concatenate(counts, axis=1)
    different, key = np.unique(keys, return_inverse=True)
    totals = [np.bincount(key, c, len(different)).astype(np.int64)[key] for c in counts]
    # Of several values put in one place the last one stays.
    learnt = np.flatnonzero(counts[0])[::-1]
    first = np.full(len(different), -1)
    first[key[learnt]] = learnt
    own = first[key] == np.arange(len(key))
    ends = np.cumsum(sizes)
    rows = [
        (packed(np.concatenate([t[e - n : e] for t in (*totals, own)])), int(counts[0, e - n : e].sum()), int(own[e - n : e].sum()))
        for e, n in zip(ends, sizes, strict=True)
    ]
    answers = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int64()), strict=True)]
    columns = [asked[c].combine_chunks() for c in ("block", "bucket", "n")] + answers
    return pa.Table.from_arrays(columns, ["block", "bucket", "n", "totals", "learnt", "new"])


def _totals(answers: pa.Table, of: int) -> np.ndarray:
    """``of`` rows of totals and one of first learners, in the order of the block's keys."""
    answers = answers.sort_by("bucket")
    rows = zip(answers["totals"].to_pylist(), answers["n"].to_pylist(), strict=True)
    return np.concatenate([unpacked(raw, (of + 1) * n).reshape(of + 1, n) for raw, n in rows], axis=1)


class Automaton:
    """The part of the automaton that a block can use: unigram and backoff weight of its words, weights of its arcs; base ten."""

    def __init__(self, block: Block, words: np.ndarray, pairs: np.ndarray, total: int, different: int):
        self.block, (n, out, kinds, _), count = block, words, pairs[0]
        self.known = n > 0
        self.unigram = np.log10(n + 1.0) - math.log10(total + different + 1)
        self.backoff = np.log10(np.where(out > 0, DISCOUNT * kinds / np.maximum(out, 1), 1.0))
        #: Counted pairs have an arc; others fail to the empty state.
        self.counted = count > 0
        self.discounted = np.maximum(count - DISCOUNT, 0.0) / np.maximum(out[block.pair_x], 1)

    def traverse(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens, base score and score of each text: all texts at once, as a state is the word before."""
        block = self.block
        low, back, direct = self.unigram[block.y], self.backoff[block.x], self.counted[block.pair]
        step = back + low
        step[direct] = np.log10(self.discounted[block.pair[direct]] + 10.0 ** step[direct])
        begins = np.cumsum(block.n_tokens) - block.n_tokens
        return tuple(np.add.reduceat(v, begins) for v in (self.known[block.y].astype(np.int64), low, step))


def _dealt(documents: DataFrame, training: DataFrame | Column) -> DataFrame:
    """doc_id, text, scored, learnt of every row that is scored or learnt from."""
    text = F.coalesce("text", F.lit("")).alias("text")
    if isinstance(training, Column):
        return documents.select("doc_id", text, F.lit(True).alias("scored"), F.coalesce(training, F.lit(False)).alias("learnt"))
    none = F.lit(None).cast(documents.schema["doc_id"].dataType).alias("doc_id")
    scored = documents.select("doc_id", text, F.lit(True).alias("scored"), F.lit(False).alias("learnt"))
    return scored.union(training.select(none, text, F.lit(False).alias("scored"), F.lit(True).alias("learnt")))


def score(documents: DataFrame, training: DataFrame | Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of ``documents``.

    Learnt from the whole texts of ``training``, a table or a condition on the documents. A null text counts as
    empty, and an empty one is the end token alone. Without training texts all tokens are unknown, of probability one. Repeated rows and ids, also null
    ones, stay, and repeated training rows count repeatedly. Other columns are not read.
    """
    spark = documents.sparkSession
    rows = _dealt(documents, training)
    size = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    blocks = 1 + max(int(size[0] or 0) // BLOCK, size[1] // 20_000)
    # Dealt by row number, so that copies are spread like other rows.
    number = F.monotonically_increasing_id()
    dealt = stored(rows.withColumn("block", F.pmod(F.xxhash64(number), F.lit(blocks))))

    def by(frame: DataFrame, key: str):
        return frame.repartition(tasks(spark), key).groupBy(key)

    def count_pairs(key: tuple, texts: pa.Table) -> pa.Table:
        block = Block(texts)
        return _asked(key[0].as_py(), blocks, block.pairs, block.pair_n)

    asked = by(dealt.select("block", "text", "learnt"), "block").applyInArrow(count_pairs, ASKED)
    pairs = settled(by(asked, "bucket").applyInArrow(lambda asked: _answered(asked, 1), ANSWERED))

    def count_words(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(texts)
        kinds = block.kinds(_totals(answers, 1)[1])
        return _asked(key[0].as_py(), 1 + blocks // 8, block.words, block.word_n, block.word_out, kinds)

    asked = by(dealt.select("block", "text", "learnt"), "block").cogroup(by(pairs, "block")).applyInArrow(count_words, ASKED)
    words = settled(by(asked, "bucket").applyInArrow(lambda asked: _answered(asked, 3), ANSWERED))
    sums = words.agg(F.sum("learnt"), F.sum("new")).first()
    total, different = int(sums[0] or 0), int(sums[1] or 0)
    answers = pairs.withColumn("word", F.lit(False)).union(words.withColumn("word", F.lit(True)))
    kind = documents.select("doc_id").schema

    def traverse(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(texts)
        of_words = answers["word"].combine_chunks()
        automaton = Automaton(block, _totals(answers.filter(of_words), 3), _totals(answers.filter(pa.compute.invert(of_words)), 1), total, different)
        columns = {"doc_id": texts["doc_id"], "n_tokens": block.n_tokens}
        columns |= dict(zip(("n_known", "base_score", "score"), automaton.traverse(), strict=True))
        return pa.table(columns).filter(texts["scored"])

    scored = by(dealt, "block").cogroup(by(answers, "block")).applyInArrow(
        traverse, f"doc_id {kind['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.withColumn("train_tokens", F.lit(total).cast("long"))
