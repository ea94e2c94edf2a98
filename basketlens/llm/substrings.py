"""Substring dedup by super-k-mers of words.

A window is ``WINDOW`` consecutive words. Its minimiser is the least hash of its runs of ``RUN`` words, which
depends on the window's words only. Consecutive windows with one minimiser travel as one packed string (a
super-k-mer) to the minimiser's bucket; there the windows are sorted by a hash and counted exactly,
with equal hashes compared by their bytes.

A window that is repeated has a minimiser that stands more than once in the corpus. So the minimisers, a number each,
are counted first, and only the super-k-mers of those that stand more than once are cut and travel.

Equal super-k-mers are one row with a count before they travel, so copies cost nothing. A minimiser that
is in more different super-k-mers than a task's share (a short common passage in many contexts) is split:
its super-k-mers become single windows, dealt by a hash of the window. What is repeated goes back to the
texts by the digests of the super-k-mers, for each different text once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.llm.tables import settled, stored, tasks
from basketlens.llm.words import Texts, mix, pieces

WINDOW = 35
RUN = 8
#: Windows of a super-k-mer at most; longer runs of one minimiser are several.
LONGEST = 128
#: A minimiser with more than 1/SHARE of a mean task's super-k-mers is split.
SHARE = 8
#: Different super-k-mers of a minimiser that are never split.
FEW = 4096

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def run_hashes(words: np.ndarray, run: int) -> np.ndarray:
    """A hash of each run of consecutive word hashes."""
    total = np.zeros(max(0, len(words) - run + 1), dtype=np.uint64)
    for i in range(run):
        total = total * _FACTOR + words[i : i + len(total)]
    return mix(total)


def super_kmers(hashes: np.ndarray, window: int, run: int) -> Iterator[tuple[int, int, int]]:
    """minimiser, first window, number of windows, for the word hashes of one text."""
    if len(hashes) < window:
        return
    least = sliding_window_view(run_hashes(hashes, run), window - run + 1).min(axis=1)
    edges = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1], [True])))
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        key = int(least[low])
        for at in range(low, high, LONGEST):
            yield key, at, min(LONGEST, high - at)


def _packed(texts: Texts, i: int, at: int, n: int) -> bytes:
    """Words at .. at+n of a text joined by one space."""
    low = int(texts.of_text[i]) + at
    return b" ".join(texts.data[texts.starts[low] : texts.ends[low + n - 1]].tobytes().split())


def _places(window: int, run: int):
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """owner (text digest), key, first, n, times of each super-k-mer; times is how often its run stands in it, two at most."""
        for batch in batches:
            for texts in pieces(batch["text"]):
                hashes = texts.hashes()
                owners, keys, firsts, sizes, times = [], [], [], [], []
                for i in range(len(texts)):
                    words = hashes[texts.of_text[i] : texts.of_text[i + 1]]
                    if len(words) < window:
                        continue
                    owner = hashlib.md5(texts.text(i)).digest()
                    runs = run_hashes(words, run)
                    for key, at, n in super_kmers(words, window, run):
                        owners.append(owner)
                        keys.append(key)
                        firsts.append(at)
                        sizes.append(n)
                        times.append(min(2, np.count_nonzero(runs[at : at + n + window - run] == key)))
                yield pa.RecordBatch.from_pydict(
                    {
                        "owner": pa.array(owners, pa.binary()),
                        "key": pa.array(np.array(keys, dtype=np.uint64).view(np.int64)),
                        "first": pa.array(firsts, pa.int64()),
                        "n": pa.array(sizes, pa.int64()),
                        "times": pa.array(times, pa.int64()),
                    }
                )

    return places


def _cut(window: int, whole: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the spans of each text: key, packed (whole), or text digest, first window, digest of the super-k-mer."""
        for batch in batches:
            spans, digests = batch["spans"].to_pylist(), batch["owner"].to_pylist()
            for texts in pieces(batch["text"]):
                keys, packed, owners, firsts = [], [], [], []
                for i in range(len(texts)):
                    owner = digests[texts.first + i]
                    for span in spans[texts.first + i]:
                        string = _packed(texts, i, span["first"], span["n"] + window - 1)
                        keys.append(span["key"])
                        packed.append(string if whole else hashlib.md5(string).digest())
                        owners.append(owner)
                        firsts.append(span["first"])
                if whole:
                    columns = {"key": pa.array(keys, pa.int64()), "packed": pa.array(packed, pa.binary())}
                else:
                    columns = {"owner": pa.array(owners, pa.binary()), "first": pa.array(firsts, pa.int64()), "digest": pa.array(packed, pa.binary())}
                yield pa.RecordBatch.from_pydict(columns)

    return cut


def _single(window: int):
    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Super-k-mers of hot minimisers as one row for each window."""
        for batch in batches:
            for key, packed, n, digest in zip(*(batch[c].to_pylist() for c in ("key", "packed", "n", "digest")), strict=True):
                words = packed.split(b" ")
                rows = [b" ".join(words[i : i + window]) for i in range(len(words) - window + 1)]
                part = [int.from_bytes(hashlib.md5(r).digest()[:8], "little", signed=True) for r in rows]
                m = len(rows)
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": pa.array(part, pa.int64()),
                        "packed": pa.array(rows, pa.binary()),
                        "n": pa.array([n] * m, pa.int64()),
                        "digest": pa.array([digest] * m, pa.binary()),
                        "offset": pa.array(range(m), pa.int64()),
                    }
                )

    return single


def repeated_windows(packed: list[bytes], counts: np.ndarray, window: int) -> list[list[int]]:
    """For each packed string the windows (by number) whose words start more than once in all strings."""
    column = pa.array(packed, pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)
    texts = Texts(np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8), offsets, 0)
    h = run_hashes(texts.hashes(), window)
    last = texts.of_text[1:] - window + 1
    n = np.maximum(last - texts.of_text[:-1], 0)
    string = np.repeat(np.arange(len(packed)), n)
    inner = np.arange(len(string)) - np.repeat(np.cumsum(n) - n, n)
    word = texts.of_text[:-1][string] + inner
    order = np.argsort(h[word], kind="stable")
    sorted_h = h[word][order]
    first = np.flatnonzero(np.concatenate(([True], sorted_h[1:] != sorted_h[:-1]))) if len(order) else np.zeros(0, dtype=int)
    size = np.diff(np.append(first, len(order)))
    out: list[list[int]] = [[] for _ in packed]
    often = counts[string] > 1
    for j in np.flatnonzero(often):
        out[string[j]].append(int(inner[j]))
    for low, many in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        group = order[low : low + many]
        # Equal hashes are compared by their words.
        same: dict[bytes, list[int]] = {}
        for j in group.tolist():
            w = word[j]
            same.setdefault(texts.data[texts.starts[w] : texts.ends[w + window - 1]].tobytes(), []).append(j)
        for js in same.values():
            if len(js) > 1:
                for j in js:
                    if not often[j]:
                        out[string[j]].append(int(inner[j]))
    return out


def _count(window: int, most: int = 20_000):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """digest, places: repeated windows of the super-k-mers, from rows sorted by key."""
        rest: list[tuple] = []

        def done(rows: list[tuple]) -> pa.RecordBatch:
            found = repeated_windows([r[1] for r in rows], np.array([r[2] for r in rows]), window)
            hit = [(r[3], [r[4] + i for i in places]) for r, places in zip(rows, found, strict=True) if places]
            return pa.RecordBatch.from_pydict(
                {"digest": pa.array([d for d, _ in hit], pa.binary()), "places": pa.array([p for _, p in hit], pa.list_(pa.int64()))}
            )

        for batch in batches:
            rest += zip(*(batch[c].to_pylist() for c in ("key", "packed", "n", "digest", "offset")), strict=True)
            if len(rest) >= most:
                # What stands before the last key's first row is complete.
                cut = len(rest)
                while cut and rest[cut - 1][0] == rest[-1][0]:
                    cut -= 1
                if cut:
                    yield done(rest[:cut])
                    rest = rest[cut:]
        if rest:
            yield done(rest)

    return count


def digest_of(text: str = "text") -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def candidates(texts: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """owner, text, spans: the texts with super-k-mers whose minimiser stands more than once, and these (key, first, n).

    Repeated texts stay rows of their own. ``texts`` has column text.
    """
    each = settled(texts.select("text").mapInArrow(_places(window, run), "owner binary, key long, first long, n long, times long"))
    often = settled(each.groupBy("key").agg(F.sum("times").alias("times")).where("times > 1").select("key"))
    spans = (
        each.join(often, "key", "left_semi")
        .select("owner", "key", "first", "n")
        .distinct()
        .groupBy("owner")
        .agg(F.collect_list(F.struct("key", "first", "n")).alias("spans"))
    )
    return texts.select(digest_of().alias("owner"), "text").join(settled(spans), "owner")


def repeats(found: DataFrame, window: int = WINDOW, few: int = FEW) -> DataFrame:
    """digest, places: the super-k-mers with repeated windows. ``found`` is that of ``candidates``."""
    spark = found.sparkSession
    each = found.mapInArrow(_cut(window, True), "key long, packed binary")
    distinct = settled(each.groupBy("key", "packed").agg(F.count("*").alias("n"))).withColumn("digest", F.unhex(F.md5("packed")))
    sizes = stored(distinct.groupBy("key").count().where(F.col("count") > few))
    total = distinct.count()
    # At most SHARE * tasks keys, however large the corpus.
    hot = sizes.where(F.col("count") > total / (SHARE * tasks(spark))).select("key")
    if hot.isEmpty():
        rows = distinct.withColumn("offset", F.lit(0).cast("long"))
    else:
        hot = F.broadcast(hot)
        cold = distinct.join(hot, "key", "left_anti").withColumn("offset", F.lit(0).cast("long"))
        single = distinct.join(hot, "key", "left_semi").select("key", "packed", "n", "digest")
        split = single.mapInArrow(_single(window), "key long, packed binary, n long, digest binary, offset long")
        rows = cold.select("key", "packed", "n", "digest", "offset").union(split)
    return (
        rows.select("key", "packed", "n", "digest", "offset")
        .repartition(tasks(spark), "key")
        .sortWithinPartitions("key")
        .mapInArrow(_count(window), "digest binary, places array<long>")
    )


def _finish(window: int):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, n_words, kept_texts = [], [], []
            marks = batch["windows"].to_pylist()
            for texts in pieces(batch["text"]):
                for i in range(len(texts)):
                    words = texts.text(i).split()
                    gone = np.zeros(len(words) + 1, dtype=np.int64)
                    starts = np.unique(np.array(marks[texts.first + i] or [], dtype=np.int64))
                    np.add.at(gone, starts, 1)
                    np.add.at(gone, starts + window, -1)
                    covered = np.cumsum(gone)[:-1] > 0
                    n_words.append(len(words))
                    removed.append(int(covered.sum()))
                    kept_texts.append(b" ".join(w for w, c in zip(words, covered.tolist(), strict=True) if not c))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept_texts, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    return finish


def remove_repeats(documents: DataFrame, window: int = WINDOW, run: int = RUN, few: int = FEW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) of every row.

    Words are runs of ``[^\\x20\\x09-\\x0D]``. A word goes if a window over it also starts elsewhere in the
    input, in the same text or another; of repeated rows, too, every copy goes. A null text has no
    words, like an empty one, and texts shorter than a window lose nothing. Repeated or null ids stay rows of their own. Other columns
    are not read.
    """
    candidate = settled(candidates(documents, window, run))
    found = settled(repeats(candidate, window, few))
    owners = candidate.mapInArrow(_cut(window, False), "owner binary, first long, digest binary").distinct()
    # A split super-k-mer has several rows.
    windows = (
        owners.join(found, "digest")
        .select("owner", F.transform("places", lambda p: p + F.col("first")).alias("at"))
        .groupBy("owner")
        .agg(F.flatten(F.collect_list("at")).alias("windows"))
    )
    rows = documents.select("doc_id", "text", digest_of().alias("owner"))
    frame = rows.join(windows, "owner", "left").select("doc_id", "text", "windows")
    kind = frame.schema["doc_id"].dataType.simpleString()
    return frame.mapInArrow(_finish(window), f"doc_id {kind}, n_words long, n_removed long, kept string")
