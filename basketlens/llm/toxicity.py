"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams, with marks for its ends; each n-gram has a vector, found
by hashing. The vectors of a window of consecutive words are averaged and go through a linear softmax
of two classes. A text is as toxic as its most toxic window, so a few words in a long text are not
diluted. Misspelt and unseen words share n-grams, and so vectors, with those seen.

Training is on a bounded sample of labelled rows, on the driver: ``SAMPLE`` ids of each class, chosen by a hash from the
labels alone, and of these the texts of up to ``LONGEST_TEXT`` bytes. So the driver gets 4,000 texts of 16 KB at
most, whatever the corpus. Windows are short, as an insult is a word or two: in longer ones the words around it outweigh
it. What goes to the executors is one number for each n-gram bucket: of the average only its product with the softmax
weights is ever needed. Texts are scored where they are read; there is no shuffle of texts.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.memo import Memo
from basketlens.llm.tables import stored
from basketlens.llm.words import Texts, mix, pieces

#: Labelled rows of each class that training takes at most.
SAMPLE = 2000
#: Bytes of a text that training takes; every text is scored whole.
LONGEST_TEXT = 1 << 14
BUCKETS = 1 << 17
WIDTH = 8
GRAMS = (3, 4, 5, 6)
WINDOW = 2
ROUNDS = 60
RATE = 0.05
THRESHOLD = 0.7
PIECE = 1 << 22
REMEMBERED = 400_000
#: Longer words are not remembered; the n-grams of a part of a word begin in so many letters.
LONGEST = 64
LETTERS = 1 << 12
#: Letters whose n-grams are made at once, but for a longer word.
AT_ONCE = 1 << 17
#: Buckets that a step of training has in hand at once.
BAGS_AT_ONCE = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _core(word: str) -> str:
    """A word in small letters, without the punctuation around it and with marks for its ends."""
    return f"<{word.strip('.,;:!?|()[]\"').lower()}>"


def _segments(core: str) -> list[str]:
    """A very long word in parts that overlap by all but one letter of a gram."""
    if len(core) <= LETTERS:
        return [core]
    return [core[low : low + LETTERS + max(GRAMS) - 1] for low in range(0, len(core), LETTERS)]


def bags(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of some words and of the words themselves, and for each the place of its word."""
    whole = [_core(w) for w in words]
    parts = [_segments(core) for core in whole]
    cores = [core for part in parts for core in part]
    word_of = np.repeat(np.arange(len(words)), [len(part) for part in parts])
    letters = np.frombuffer("".join(cores).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    mixed = mix(letters.astype(np.uint64) + np.uint64(1 << 32))
    lengths = np.array([len(core) for core in cores], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    of_letter = np.repeat(np.arange(len(cores)), lengths)
    at = np.arange(len(letters)) - starts[of_letter]
    left = lengths[of_letter] - at
    # Of a part of a long word the last letters begin no gram: the next part has them again.
    begins = at < LETTERS
    buckets = [np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in whole], dtype=np.int64)]
    places = [np.arange(len(words))]
    h = mixed
    for n in range(2, max(GRAMS) + 1):
        h = h[: len(letters) - n + 1] * _BASE + mixed[n - 1 :] if len(letters) >= n else h[:0]
        if n in GRAMS:
            ok = np.flatnonzero((left[: len(h)] >= n) & begins[: len(h)])
            buckets.append((mix(h[ok]) % np.uint64(BUCKETS)).astype(np.int64))
            places.append(word_of[of_letter[ok]])
    return np.concatenate(buckets), np.concatenate(places)


def _some(words: list[str]) -> Iterator[tuple[int, int]]:
    """The words in ranges of about ``AT_ONCE`` letters, one word at least."""
    low = 0
    while low < len(words):
        high, size = low, 0
        while high < len(words) and (high == low or size + len(words[high]) <= AT_ONCE):
            size += len(words[high])
            high += 1
        yield low, high
        low = high


def word_values(words: list[str], value: np.ndarray) -> np.ndarray:
    """The mean value of each word's bag."""
    out = np.zeros(len(words))
    for low, high in _some(words):
        bucket, place = bags(words[low:high])
        out[low:high] = np.bincount(place, value[bucket], high - low) / np.bincount(place, minlength=high - low)
    return out


class Bags:
    """The bags of all words of the sample, for training; work on them takes ``BAGS_AT_ONCE`` buckets at a time."""

    def __init__(self, words: list[str]):
        parts, sizes = [], []
        for low, high in _some(words):
            bucket, place = bags(words[low:high])
            parts.append(bucket[place.argsort(kind="stable")].astype(np.int32))
            sizes.append(np.bincount(place, minlength=high - low))
        self.bucket, self.size = np.concatenate(parts), np.concatenate(sizes)
        ends = np.cumsum(self.size)
        cuts = np.searchsorted(ends, np.arange(BAGS_AT_ONCE, ends[-1] + BAGS_AT_ONCE, BAGS_AT_ONCE)) + 1
        edges = np.unique(np.clip(np.concatenate(([0], cuts)), 0, len(words))).tolist()
        self.ranges = list(zip(edges, edges[1:], strict=False))
        self.starts = ends - self.size

    def _part(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        first = self.starts[low]
        return self.bucket[first : self.starts[high - 1] + self.size[high - 1]], self.starts[low:high] - first

    def means(self, value: np.ndarray) -> np.ndarray:
        """The mean value of each word's bag."""
        parts = []
        for low, high in self.ranges:
            bucket, starts = self._part(low, high)
            parts.append(np.add.reduceat(value[bucket], starts))
        return np.concatenate(parts) / self.size

    def spread(self, at_word: np.ndarray) -> np.ndarray:
        """What each bucket gets if each word's number goes to its bag in equal parts."""
        out = np.zeros(BUCKETS)
        share = at_word / self.size
        for low, high in self.ranges:
            bucket, _ = self._part(low, high)
            out += np.bincount(bucket, np.repeat(share[low:high], self.size[low:high]), BUCKETS)
        return out


def windows(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the windows of n words; a shorter text is one."""
    starts = np.arange(max(1, n - WINDOW + 1))
    return starts, np.minimum(starts + WINDOW, n)


def train(texts: list[str], labels: list[int]) -> tuple[np.ndarray, float]:
    """The number of each bucket, and the bias.

    Without rows of both classes nothing can be learnt: the share of class 1 becomes the bias.
    """
    y = np.array(labels, dtype=np.float64)
    if len(set(labels)) < 2:
        return np.zeros(BUCKETS, dtype=np.float32), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    known: dict[bytes, int] = {}
    codes = array("i")
    first, last, doc = [], [], []
    for i, text in enumerate(texts):
        words = [known.setdefault(w, len(known)) for w in text.encode().split()]
        s, e = windows(len(words))
        # Windows half a window apart, and the last one, so that every word is in one.
        some = np.unique(np.append(np.arange(0, len(s), max(1, WINDOW // 2)), len(s) - 1))
        first.append((s[some] + len(codes)).astype(np.int32))
        last.append((e[some] + len(codes)).astype(np.int32))
        doc.append(np.full(len(first[-1]), i, dtype=np.int32))
        codes.extend(words)
    if not known:
        return np.zeros(BUCKETS, dtype=np.float32), 0.0
    start, end, doc = map(np.concatenate, (first, last, doc))
    size = np.maximum(end - start, 1)
    of_doc = np.searchsorted(doc, np.arange(len(texts)))
    bag = Bags([w.decode() for w in known])
    code = np.array(codes)

    # Both classes weigh the same, however many rows there are of each.
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    rng = np.random.default_rng(7)
    # Small, so that n-grams that were never seen say next to nothing.
    vectors = rng.normal(0, 0.01, (BUCKETS, WIDTH))
    softmax = rng.normal(0, 0.5, (2, WIDTH))
    bias = np.zeros(2)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (vectors, softmax, bias)]
    for step in range(1, ROUNDS + 1):
        u = softmax[1] - softmax[0]
        value = vectors @ u
        word = bag.means(value)
        sums = np.concatenate(([0.0], np.cumsum(word[code])))
        logit = (sums[end] - sums[start]) / size
        top = np.maximum.reduceat(logit, of_doc)
        share = np.exp(np.minimum(0, 4 * (logit - top[doc])))
        share /= np.bincount(doc, share, len(texts))[doc]
        z = np.bincount(doc, share * logit, len(texts)) + bias[1] - bias[0]
        slope = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * weight
        # Back: text, window, word, n-gram, vector.
        at_window = slope[doc] * share / size
        edge = np.bincount(start, at_window, len(code) + 1) - np.bincount(end, at_window, len(code) + 1)
        at_gram = bag.spread(np.bincount(code, np.cumsum(edge)[:-1], len(known)))
        pull = at_gram @ vectors
        gradients = (np.outer(at_gram, u), np.array([-pull, pull]), np.array([-slope.sum(), slope.sum()]))
        for x, g, m in zip((vectors, softmax, bias), gradients, moments, strict=True):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.01 * (g * g - m[1])
            fixed = (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
            x -= RATE * fixed
    return (vectors @ (softmax[1] - softmax[0])).astype(np.float32), float(bias[1] - bias[0])


class Scorer:
    """Scores of texts; made anew in each Python worker."""

    def __init__(self, value: np.ndarray, bias: float):
        self.value, self.bias, self.memo = value, bias, Memo(REMEMBERED)

    def words(self, words: list[str]) -> np.ndarray:
        """The value of each word."""
        known = [self.memo.get(w) for w in words]
        new = [i for i, x in enumerate(known) if x is None]
        for i, x in zip(new, word_values([words[i] for i in new], self.value).tolist(), strict=True):
            known[i] = x
            if len(words[i]) <= LONGEST:
                self.memo.put(words[i], x)
        return np.array(known, dtype=np.float64)

    def scores(self, texts: Texts) -> np.ndarray:
        edges = np.empty(2 * len(texts.starts) + 1, dtype=np.int64)
        edges[0:-1:2], edges[1::2], edges[-1] = texts.starts, texts.ends, len(texts.data)
        column = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), pa.py_buffer(texts.data))
        coded = column.take(pa.array(np.arange(0, len(edges) - 1, 2))).dictionary_encode()
        values = self.words(coded.dictionary.to_pylist())
        sums = np.concatenate(([0.0], np.cumsum(values[coded.indices.to_numpy()] if len(values) else [])))
        out = np.zeros(len(texts))
        for i, (low, high) in enumerate(zip(texts.of_text[:-1], texts.of_text[1:], strict=True)):
            if high > low:
                s, e = windows(int(high - low))
                out[i] = ((sums[low + e] - sums[low + s]) / (e - s)).max()
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -50, 50)))


def sample(documents: DataFrame, labels: DataFrame, label: str, most: int) -> tuple[list[str], list[int]]:
    """Labelled texts of at most ``most`` ids of each class, the first by a hash of their ids.

    Ids are chosen without texts. Texts of more than ``LONGEST_TEXT`` bytes are left out, and of the texts of an id one is
    taken, the least. An id with both labels is of both classes.
    """
    there = documents.select("doc_id").where("doc_id IS NOT NULL").distinct()
    marked = labels.select("doc_id", F.col(label).alias("label")).where("label IN (0, 1)").distinct()
    marked = stored(marked.join(there, "doc_id", "left_semi").withColumn("hash", F.xxhash64("doc_id")))
    count = {r.label: r.n for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = []
    for c in (0, 1):
        # Hashes are even, so few more than ``most`` are below the bound, whatever the number of partitions.
        share = min(1.0, (1.2 * most + 100) / max(1, count.get(c, 0)))
        bound = int(-(2**63) + share * (2**64 - 1))
        low = marked.where((F.col("label") == c) & (F.col("hash") <= F.lit(min(bound, 2**63 - 1))))
        chosen += [(r.doc_id, c) for r in low.orderBy("hash", "doc_id").limit(most).collect()]
    if not chosen:
        return [], []
    kind = documents.schema["doc_id"].dataType.simpleString()
    # At most 2 * most ids.
    ids = F.broadcast(documents.sparkSession.createDataFrame(chosen, f"doc_id {kind}, label int"))
    short = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= LONGEST_TEXT)
    found = short.join(ids, "doc_id").groupBy("label", "doc_id").agg(F.min("text").alias("text"))
    rows = sorted((r.label, r.doc_id, r.text) for r in found.collect())
    return [text for _, _, text in rows], [c for c, _, _ in rows]


def toxicity(
    documents: DataFrame, texts: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE
) -> DataFrame:
    """``documents`` with score and predicted; learnt from ``texts`` with ``labels``.

    Only the text is an input of a score. Each row is scored by itself, so repeated rows and null ids stay. A
    null text counts as empty; a text without words has the score of the bias. Labels other than 0
    and 1 are left out. Without labels of both classes every score is the same. Other columns are kept, but for
    those named score or predicted, which are replaced.
    """
    value, bias = train(*sample(texts, labels, label, most))
    model = documents.sparkSession.sparkContext.broadcast((value, bias))
    frame = documents.drop("score", "predicted")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model.value)
        for batch in batches:
            scores = [np.zeros(0), *(scorer.scores(part) for part in pieces(batch["text"], PIECE))]
            yield batch.append_column("score", pa.array(np.concatenate(scores)))

    return frame.mapInArrow(score, f"{fields}, score double").withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )


def learning(frame: DataFrame) -> DataFrame:
    """The rows that may be learnt from: crc32 of the id as text, modulo 3, is not 1."""
    return frame.where("coalesce(crc32(CAST(doc_id AS STRING)), 0) % 3 <> 1")
