"""Phrase collocations: exact counts of word sequences by HAT-tries, and scores over their cuts.

**Counting.** A task reads texts and gives each word of each language an id of its own. Every word begins one
window, itself and the two words after it (fewer at the end of a piece), so one count of windows holds the
counts of all phrases: a phrase has the sum of the subtree under its words. Windows are counted in a HAT-trie: a
shallow trie over word ids whose leaves are hash containers. A container that overfills is split between two ids,
or, if it holds one id only, bursts into a trie node over the next word. When the entries of a task reach a bound,
the largest subtrees are spilled whole, as sorted runs: for each prefix partition (a hash of the first two words) the
pairs, the number of windows of each, their third words and counts. Runs of one partition from all
tasks are merged in one group; so a hot word or pair costs one entry a task and third word, not one an occurrence.

**Ids.** In runs a word is the 64-bit hash of language and word. The words travel, too, once for each task,
to the partition of their hash, where the counts of a word are added and two words of one hash would
meet; in that case all is counted again with another seed. So the counts are exact.

**Scores.** Phrases seen less often than the bound leave the merge only as sums. The rest are joined by hash to
the counts of their parts; numbers are decimals of 38 digits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.llm.tables import stored, tasks
from basketlens.llm.words import Texts, pieces

#: Bytes of text handled at once, and words.
PIECE = 1 << 21
STEP = 1 << 18
#: Entries of a container before it is split, of a task's trie before it spills, words of a task before all is sent.
BURST = 1 << 13
ENTRIES = 1 << 20
WORDS = 1 << 19
#: Bits of a word id in a window; ids stay below WORDS + STEP + 2.
BITS = 21
LOW = (1 << BITS) - 1
#: Language of a text without one (fixed value).
NO_LANGUAGE = "und"
#: Prefix partitions for each shuffle partition: a group of runs is merged in memory, so groups are small.
GROUPS = 6
#: Salts for the first cut of a language's ranking.
PARTS = 64

RUNS = "part int, kind int, lang string, words string, keys binary, sizes binary, thirds binary, counts binary"
COUNTS = "kind int, lang string, word string, a long, b long, c long, n long"
WORD, PAIR, TRIPLE, TOTAL, CLASH = range(5)

# Separators of pieces become line feeds, letters A-Z small ones; all other bytes stay.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_FOLD[[*b".,;:!?", *range(0x0A, 0x0E)]] = 0x0A


class Trie:
    """A trie node over the word at ``depth``: children in order, each for a range of ids.

    A child is a container (a hash table from windows to counts) or, for a single id, a node over the next word.
    """

    def __init__(self, depth: int = 0, low: int = 0, container: Counter | None = None):
        #: Windows before ``starts[i]`` belong to children before the i-th.
        self.shift = BITS * (2 - depth)
        self.depth = depth
        self.starts = [low]
        self.children: list[Counter | Trie] = [Counter() if container is None else container]

    def add(self, windows: np.ndarray) -> int:
        """Counts sorted windows; the number of new entries."""
        at = np.searchsorted(windows, self.starts[1:]).tolist()
        new = 0
        # From the last child on, so that splits leave the others' places alone.
        for i, (low, high) in reversed(list(enumerate(zip([0, *at], [*at, len(windows)], strict=True)))):
            if low == high:
                continue
            child = self.children[i]
            if isinstance(child, Trie):
                new += child.add(windows[low:high])
                continue
            before = len(child)
            child.update(windows[low:high].tolist())
            new += len(child) - before
            if len(child) > BURST:
                self._overfull(i)
        return new

    def _overfull(self, i: int) -> None:
        """Splits a container between two ids, or bursts it if it holds one."""
        child = self.children[i]
        windows = np.sort(np.fromiter(child, np.int64, len(child)))
        ids = windows >> self.shift
        if ids[0] == ids[-1]:
            if self.depth < 2:
                self.children[i] = Trie(self.depth + 1, self.starts[i], child)
                self.children[i]._overfull(0)
            return
        # The cut nearest to the middle.
        cuts = np.flatnonzero(ids[1:] != ids[:-1]) + 1
        cut = int(cuts[np.abs(cuts - len(ids) // 2).argmin()])
        low = int(ids[cut]) << self.shift
        first, second = Counter(), Counter()
        for window, n in child.items():
            (second if window >= low else first)[window] = n
        self.children[i : i + 1] = [first, second]
        self.starts.insert(i + 1, low)
        for at in (i + 1, i):
            if len(self.children[at]) > BURST:
                self._overfull(at)

    def __len__(self) -> int:
        return sum(map(len, self.children))

    def run(self, child: Counter | Trie | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Windows of a subtree (without ``child``, of all) in order, and their counts."""
        if isinstance(child, Counter):
            windows = np.fromiter(child.keys(), np.int64, len(child))
            order = windows.argsort()
            return windows[order], np.fromiter(child.values(), np.int64, len(child))[order]
        parts = [child.run(x) for x in child.children] if child is not None else [self.run(x) for x in self.children]
        return tuple(map(np.concatenate, zip(*parts, strict=True)))

    def spill(self, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Takes the largest subtrees out, whole, until at most ``keep`` entries are left."""
        sizes = list(map(len, self.children))
        left = sum(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            if left <= keep:
                return
            if sizes[i]:
                yield self.run(self.children[i])
                self.children[i] = Counter()
                left -= sizes[i]


def _hash(lang: bytes, word: bytes, seed: int) -> int:
    """A 64-bit number of a language's word, never 0, which stands for no word."""
    return xxhash.xxh3_64_intdigest(lang + b"\n" + word, seed) or 1


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Counting:
    """The counts of one task."""

    def __init__(self, parts: int, seed: int):
        self.parts, self.seed = parts, seed
        self._clear()

    def _clear(self) -> None:
        self.trie, self.entries = Trie(), 0
        #: Word ids from 1 on; 0 is the end of a piece.
        self.ids: dict[tuple[bytes, bytes], int] = {}
        self.hashes: list[int] = [0]
        self.seen = np.zeros(1, dtype=np.int64)

    def add(self, texts: Texts, langs: list[bytes]) -> Iterator[pa.RecordBatch]:
        """Counts the windows of some texts, one language for each text."""
        texts = Texts(_FOLD[texts.data], texts.offsets, texts.first)
        starts, ends = texts.starts, texts.ends
        n = len(starts)
        kinds = {lang: i for i, lang in enumerate(dict.fromkeys(langs))}
        lang_of = np.repeat(np.array([kinds[lang] for lang in langs], dtype=np.int64), np.diff(texts.of_text))
        # A piece ends where a line feed stands before the next word, or a text does.
        breaks = np.concatenate(([0], np.cumsum(texts.data == 0x0A)))
        last = np.ones(n, dtype=bool)
        last[:-1] = breaks[starts[1:]] != breaks[ends[:-1]]
        last[texts.of_text[1:][texts.of_text[1:] > 0] - 1] = True
        for low in range(0, n, STEP):
            # Windows that begin here reach two words further.
            high, reach = min(n, low + STEP), min(n, low + STEP + 2)
            ids = self._ids(texts, low, reach, lang_of[low:reach], list(kinds))
            self.seen = np.concatenate((self.seen, np.zeros(len(self.hashes) - len(self.seen), dtype=np.int64)))
            self.seen += np.bincount(ids[: high - low], minlength=len(self.seen))
            follows = np.append(ids[1:], 0)
            follows[last[low:reach]] = 0
            third = np.append(follows[1:], 0)
            third[last[low:reach]] = 0
            windows = (ids << (2 * BITS) | follows << BITS | third)[: high - low]
            windows.sort()
            self.entries += self.trie.add(windows)
            if len(self.ids) > WORDS:
                yield from self.rest()
            elif self.entries > ENTRIES:
                yield from self._spilled(ENTRIES // 2)

    def _ids(self, texts: Texts, low: int, high: int, lang_of: np.ndarray, langs: list[bytes]) -> np.ndarray:
        """The ids of some words; new ones get the next."""
        n = high - low
        edges = np.zeros(2 * n + 1, dtype=np.int64)
        edges[0:-1:2], edges[1::2], edges[-1] = texts.starts[low:high], texts.ends[low:high], len(texts.data)
        column = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), 2 * n, [None, pa.py_buffer(edges), pa.py_buffer(texts.data)]
        )
        coded = column.take(pa.array(np.arange(0, 2 * n, 2))).dictionary_encode()
        distinct, at = np.unique(coded.indices.to_numpy().astype(np.int64) * len(langs) + lang_of, return_inverse=True)
        words, known = coded.dictionary.to_pylist(), self.ids
        of_distinct = [
            known.setdefault((langs[x % len(langs)], words[x // len(langs)]), len(known) + 1) for x in distinct.tolist()
        ]
        for lang, word in islice(known, len(self.hashes) - 1, None):
            self.hashes.append(_hash(lang, word, self.seed))
        return np.array(of_distinct, dtype=np.int64)[at]

    def rest(self) -> Iterator[pa.RecordBatch]:
        """All that is left, and the words."""
        yield from self._spilled(0)
        if not self.ids:
            return
        hashes = np.array(self.hashes[1:], dtype=np.uint64)
        langs = {lang: i for i, lang in enumerate(dict.fromkeys(lang for lang, _ in self.ids))}
        lang_of = np.array([langs[lang] for lang, _ in self.ids])
        words = [word for _, word in self.ids]
        part = (hashes % np.uint64(self.parts)).astype(np.int64)
        order = np.lexsort((hashes, lang_of, part))
        group = part[order] * len(langs) + lang_of[order]
        cuts = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
        names = list(langs)
        rows = []
        for low, high in zip(cuts, [*cuts[1:], len(order)], strict=True):
            these = order[low:high]
            g = int(group[low])
            rows.append(
                (
                    g // len(langs),
                    WORD,
                    names[g % len(langs)].decode(),
                    b"\n".join([words[i] for i in these.tolist()]).decode(),
                    hashes[these].tobytes(),
                    None,
                    None,
                    self.seen[1:][these].tobytes(),
                )
            )
        yield _rows(rows)
        self._clear()

    def _spilled(self, keep: int) -> Iterator[pa.RecordBatch]:
        runs = list(self.trie.spill(keep))
        if not runs:
            return
        windows, counts = map(np.concatenate, zip(*runs, strict=True))
        self.entries -= len(windows)
        hash_of = np.array(self.hashes, dtype=np.uint64)
        pair = windows >> BITS
        # Windows of a pair lie side by side in the subtrees' order.
        heads = np.flatnonzero(np.diff(pair, prepend=-1))
        sizes = np.diff(np.append(heads, len(windows)))
        first, second = hash_of[pair[heads] >> BITS], hash_of[pair[heads] & LOW]
        mixed = _mix(first, second)
        part = (mixed % np.uint64(self.parts)).astype(np.int64)
        order = np.lexsort((mixed, part))
        # The windows in the order of their pairs.
        begin = heads[order]
        size = sizes[order]
        ends = np.cumsum(size)
        at = np.arange(len(windows)) + np.repeat(begin - (ends - size), size)
        thirds, counts = hash_of[windows[at] & LOW], counts[at]
        keys = np.stack((first[order], second[order]), axis=1)
        cuts = np.flatnonzero(np.diff(part[order], prepend=-1)).tolist()
        offset = np.append(0, ends)
        rows = []
        for low, high in zip(cuts, [*cuts[1:], len(order)], strict=True):
            a, b = offset[low], offset[high]
            rows.append(
                (
                    int(part[order[low]]),
                    PAIR,
                    None,
                    None,
                    keys[low:high].tobytes(),
                    size[low:high].astype(np.uint32).tobytes(),
                    thirds[a:b].tobytes(),
                    counts[a:b].astype(np.uint32).tobytes(),
                )
            )
        yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), *[pa.binary()] * 4]
    names = [field.split()[0] for field in RUNS.split(", ")]
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _sums(keys: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct keys of sorted key columns, and the sums of their counts."""
    new = np.ones(len(counts), dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    heads = np.flatnonzero(new)
    return [k[heads] for k in keys], np.add.reduceat(counts, heads) if len(heads) else counts


def _merged_pairs(runs: pa.Table, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs and triples of at least so many occurrences from the runs of a partition."""

    def whole(name: str, kind: str) -> np.ndarray:
        return np.concatenate([np.frombuffer(x.as_buffer(), dtype=kind) for x in runs[name]])

    keys = whole("keys", "<u8").reshape(-1, 2)
    sizes = whole("sizes", "<u4").astype(np.int64)
    thirds, counts = whole("thirds", "<u8"), whole("counts", "<u4")
    first, second = keys[:, 0], keys[:, 1]
    begin = np.cumsum(sizes) - sizes
    sums = np.add.reduceat(counts, begin, dtype=np.int64)
    # Each run is in this order already, so the stable sort merges them.
    mixed = _mix(first, second)
    order = mixed.argsort(kind="stable")
    a, b, key = first[order], second[order], mixed[order]
    if ((key[1:] == key[:-1]) & ((a[1:] != a[:-1]) | (b[1:] != b[:-1]))).any():
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
    (one, two), total = _sums([a, b], sums[order])
    often = (total >= least) & (two != 0)
    yield PAIR, one[often], two[often], np.zeros(often.sum(), dtype=np.uint64), total[often]
    # A triple is no more frequent than its first pair, so the windows of rare pairs are left.
    changes = np.ones(len(order), dtype=bool)
    changes[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    of_often = np.empty(len(order), dtype=bool)
    of_often[order] = often[np.cumsum(changes) - 1]
    take = np.repeat(of_often, sizes)
    pair = np.repeat(np.flatnonzero(of_often), sizes[of_often])
    z, n = thirds[take], counts[take]
    x, y, n = first[pair][z != 0], second[pair][z != 0], n[z != 0].astype(np.int64)
    z = z[z != 0]
    order = np.lexsort((z, y, x))
    (x, y, z), n = _sums([x[order], y[order], z[order]], n[order])
    often = n >= least
    yield TRIPLE, x[often], y[often], z[often], n[often]


def _merge(least: int):
    """A function that merges what came to a partition."""

    def merge(table: pa.Table) -> pa.Table:
        rows: list[pa.Table] = []
        names = [field.split()[0] for field in COUNTS.split(", ")]
        kinds = [pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 4]

        def add(kind, lang, word, a, b, c, n) -> None:
            columns = [np.full(len(n), kind, dtype=np.int32), lang, word, a, b, c, n]
            rows.append(pa.table([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names))

        kind = table["kind"].to_numpy()
        runs = table.filter(pa.array(kind == PAIR))
        if len(runs):
            for kind_of, x, y, z, n in _merged_pairs(runs, least):
                add(kind_of, [None] * len(n), [None] * len(n), x.view(np.int64), y.view(np.int64), z.view(np.int64), n)
        words = table.filter(pa.array(kind == WORD))
        if len(words):
            n_of: Counter = Counter()
            by_hash: dict[int, tuple[str, str]] = {}
            totals: Counter = Counter()
            clashes = 0
            for lang, joined, keys, counts in zip(
                *(words[c].to_pylist() for c in ("lang", "words", "keys", "counts")), strict=True
            ):
                hashes = np.frombuffer(keys, dtype="<i8").tolist()
                seen = np.frombuffer(counts, dtype="<i8").tolist()
                totals[lang] += sum(seen)
                for h, word, n in zip(hashes, joined.split("\n"), seen, strict=True):
                    clashes += by_hash.setdefault(h, (lang, word)) != (lang, word)
                    n_of[h] += n
            often = [h for h, n in n_of.items() if n >= least]
            lang, word = [by_hash[h][0] for h in often], [by_hash[h][1] for h in often]
            nothing = np.zeros(len(often), dtype=np.int64)
            add(WORD, lang, word, np.array(often, dtype=np.int64), nothing, nothing, np.array([n_of[h] for h in often], dtype=np.int64))
            nothing = np.zeros(len(totals), dtype=np.int64)
            add(TOTAL, list(totals), [None] * len(totals), nothing, nothing, nothing, np.array(list(totals.values())))
            if clashes:
                add(CLASH, [None], [None], *[np.zeros(1, dtype=np.int64)] * 3, np.array([clashes]))
        return pa.concat_tables(rows)

    return merge


def counts(documents: DataFrame, least: int, text: str = "text", lang: str = "lang", seeds: int = 8) -> DataFrame:
    """kind, lang, word, a, b, c, n: counts of words, pairs and triples that occur ``least`` times, and totals.

    Words have their hash in ``a``; pairs and triples the hashes of their words in ``a``, ``b``, ``c``; a
    language's total of all words is in ``n`` of a row without hashes, to be summed. The frame is stored. If two words of the table
    share a hash, all is counted again with the next of ``seeds`` seeds.
    """
    spark = documents.sparkSession
    parts = GROUPS * tasks(spark)
    frame = documents.select(F.col(text).cast("string").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"))
    for seed in range(seeds):

        def count(batches: Iterator[pa.RecordBatch], seed: int = seed) -> Iterator[pa.RecordBatch]:
            counting = Counting(parts, seed)
            for batch in batches:
                langs = [x.encode() for x in batch["lang"].to_pylist()]
                for piece in pieces(batch["text"], PIECE):
                    yield from counting.add(piece, langs[piece.first : piece.first + len(piece)])
            yield from counting.rest()

        runs = frame.mapInArrow(count, RUNS)
        found = stored(runs.groupBy("part").applyInArrow(_merge(least), COUNTS))
        if found.where(F.col("kind") == CLASH).isEmpty():
            return found
    raise ValueError("words share hashes under every seed")


def collocations(
    documents: DataFrame,
    least: int = 10,
    most: int = 2000,
    share: int = 50,
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of two or three words of each language.

    Letters A-Z count as small ones. A text is cut at ``[.,;:!?]`` and bytes 0A to 0D into pieces and these at spaces and
    tabs into words; phrases do not cross pieces. ``n`` counts the words of the language, ``a`` the phrase. Of the cuts of a
    phrase in two, that with the least ``floor(1000000 * a * a / (l * r))`` counts, of equals the first; ``l``
    and ``r`` are the counts of its parts. A phrase that occurs fewer than ``least`` times is none; one that stands inside a longer
    one with at least ``share`` hundredths of its occurrences is left out. The first ``most`` of a language are
    returned, by score and ``a`` descending and phrase ascending.

    A null text is empty, a null language is ``und``; repeated rows count as often as they stand there, and an
    empty table, or one without such phrases, gives no rows. Other columns are not read. ``a`` may reach
    10**16.
    """
    found = counts(documents, least, text, lang)
    words = found.where(F.col("kind") == WORD).select("lang", "word", F.col("a").alias("h"), F.col("n").alias("f"))
    totals = found.where(F.col("kind") == TOTAL).groupBy("lang").agg(F.sum("n").alias("n"))
    pairs = found.where(F.col("kind") == PAIR).select("a", "b", F.col("n").alias("f"))
    triples = found.where(F.col("kind") == TRIPLE).select("a", "b", "c", F.col("n").alias("f"))

    def word(n: int) -> DataFrame:
        kept = [F.col("h").alias("abc"[n]), F.col("word").alias(f"word{n}"), F.col("f").alias(f"f{n}")]
        return words.select(*kept, *([F.col("lang")] if n == 0 else []))

    def pair(x: str, y: str, name: str) -> DataFrame:
        return pairs.select(F.col("a").alias(x), F.col("b").alias(y), F.col("f").alias(name))

    inside = (
        triples.select("a", "b", "f").union(triples.select("b", "c", "f")).groupBy("a", "b").agg(F.max("f").alias("around"))
    )
    two = (
        pairs.join(inside, ["a", "b"], "left")
        .where(F.expr(f"around IS NULL OR 100 * around < {share} * f"))
        .join(word(0), "a")
        .join(word(1), "b")
        .select("lang", F.concat_ws(" ", "word0", "word1").alias("phrase"), F.col("f").alias("a"), F.col("f0").alias("l"), F.col("f1").alias("r"))
        .withColumn("score", _score("l", "r"))
    )
    three = (
        triples.join(pair("a", "b", "left2"), ["a", "b"])
        .join(pair("b", "c", "right2"), ["b", "c"])
        .join(word(0), "a")
        .join(word(1), "b")
        .join(word(2), "c")
        .select("lang", F.concat_ws(" ", "word0", "word1", "word2").alias("phrase"), F.col("f").alias("a"), "f0", "right2", "left2", "f2")
        .withColumn("one", _score("f0", "right2"))
        .withColumn("two", _score("left2", "f2"))
        .select(
            "lang",
            "phrase",
            "a",
            F.expr("if(one <= two, f0, left2)").alias("l"),
            F.expr("if(one <= two, right2, f2)").alias("r"),
            F.least("one", "two").alias("score"),
        )
    )
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    # Each part of a language is cut first, so that no task sorts a language.
    cut = two.unionByName(three).withColumn("_salt", salt)
    cut = cut.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*best))).where(F.col("rank") <= most)
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= most)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def _score(left: str, right: str):
    """floor(1000000 * a * a / (l * r)), which is at most 1000000."""
    wide = "CAST({} AS DECIMAL(19, 0))".format
    return F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * ({wide('a')} * {wide('a')})) div ({wide(left)} * {wide(right)})")
