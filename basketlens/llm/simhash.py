"""SimHash near-duplicates with Golay keys.

Each text has a 64-bit fingerprint of its word shingles. Texts whose fingerprints differ in at
most three bits are linked, and the connected groups are the result.

Keys. The fingerprint is cut into three segments of at most 23 bits. The binary Golay code of
length 23 puts every segment within three bits of exactly one of 4096 codewords. Of a segment x,
``near(x)`` are the codewords within four bits (one if the nearest is within two, else six). If two
segments differ in at most one bit, the nearest codeword of one is near the other. Three errors over
three segments leave two segments with at most one error each (pigeonhole), so for one of the three
pairs of segments the nearest codewords of one fingerprint are a key among the near codewords of the
other. Each fingerprint is filed under its 3 nearest keys and looks under its about 85 near keys; what
meets is verified. No link is lost.

Equal fingerprints are one row from the start, so exact copies cost nothing after the first count.
A key that files more than ``MOST`` different fingerprints is not compared pair by pair: its members
are linked through all points within two bits (see ``_stars``), exactly and in linear work.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.components import components
from basketlens.llm.tables import stored, tasks, unused
from basketlens.llm.words import Texts, lower_ascii, pieces

SEED = 42
SHINGLE = 3
DISTANCE = 3
#: Low bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Generator polynomial of the Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101
#: Filed fingerprints of a key beyond which its members are linked by ``_stars``.
MOST = 4096


def syndromes(words: np.ndarray) -> np.ndarray:
    """The remainder of each 23-bit word by the generator."""
    out = words.astype(np.uint32)
    for bit in range(22, 10, -1):
        out ^= ((out >> np.uint32(bit)) & np.uint32(1)) * np.uint32(GENERATOR << (bit - 11))
    return out


@cache
def cosets() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: offsets and values of what leads from a word to its near codewords.

    The first value is the error of at most three bits that leads to the nearest.
    """
    error = np.zeros(1 << 11, dtype=np.uint32)
    every = [sum(1 << b for b in bits) for n in (1, 2, 3) for bits in combinations(range(23), n)]
    error[syndromes(np.array(every))] = every
    single = [(1 << b, int(syndromes(np.array([1 << b]))[0])) for b in range(23)]
    values, counts = [], []
    for syndrome, e in enumerate(error.tolist()):
        others = set()
        if e.bit_count() == 3:
            others = {int(error[syndrome ^ s]) ^ flip for flip, s in single} - {e}
        values += [e, *sorted(others)]
        counts.append(1 + len(others))
    return np.concatenate(([0], np.cumsum(counts))), np.array(values, dtype=np.uint32)


def near(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and indices of the codewords within four bits; the nearest of a row comes first."""
    offsets, values = cosets()
    s = syndromes(segment).astype(np.int64)
    n = offsets[s + 1] - offsets[s]
    row = np.repeat(np.arange(len(segment)), n)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    # A codeword is known by its upper 12 bits.
    return row, (segment[row] ^ values[offsets[s][row] + inner]) >> np.uint32(11)


def segments(fp: np.ndarray) -> list[np.ndarray]:
    return [((fp >> np.uint64(low)) & np.uint64((1 << n) - 1)).astype(np.uint32) for low, n in SEGMENTS]


def fingerprints_of(texts: Texts) -> np.ndarray:
    """One unsigned 64-bit fingerprint for each text."""
    data = lower_ascii(texts).tobytes()
    out = np.zeros(len(texts), dtype=np.uint64)
    for i in range(len(texts)):
        words = data[texts.offsets[i] : texts.offsets[i + 1]].split()
        if not words:
            continue
        counts, total = np.zeros(64, dtype=np.int64), 0
        for at in range(0, max(1, len(words) - SHINGLE + 1), 1 << 16):
            part = words[at : at + (1 << 16) + SHINGLE - 1]
            n = max(1, len(part) - SHINGLE + 1)
            h = np.fromiter(
                (xxhash.xxh64_intdigest(b" ".join(part[j : j + SHINGLE]), SEED) for j in range(n)),
                dtype=np.uint64,
                count=n,
            )
            bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
            total += n
        out[i] = np.packbits(2 * counts > total, bitorder="little").view("<u8")[0]
    return out


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long). Null and empty texts have fp zero."""

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                fp = np.concatenate([fingerprints_of(t) for t in pieces(batch["text"])])
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    frame = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = frame.schema["doc_id"].dataType.simpleString()
    return frame.mapInArrow(fingerprint, f"doc_id {kind}, fp long")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, fp, filed: each fingerprint under its nearest keys (filed) and its near keys."""
    for batch in batches:
        whole = np.asarray(batch["fp"]).view(np.uint64)
        for at in range(0, len(whole), 20_000):
            fp = whole[at : at + 20_000]
            found = [near(s) for s in segments(fp)]
            for pair, (a, b) in enumerate(PAIRS):
                (row_a, index_a), (row_b, index_b) = found[a], found[b]
                first = np.searchsorted(row_b, np.arange(len(fp) + 1))
                n = (first[1:] - first[:-1])[row_a]
                x = np.repeat(np.arange(len(row_a)), n)
                inner = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
                y = first[row_a[x]] + inner
                row = row_a[x]
                key = (pair << 24) | (index_a[x].astype(np.int64) << 12) | index_b[y].astype(np.int64)
                new = np.ones(len(row), dtype=bool)
                new[1:] = row[1:] != row[:-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(fp[row].view(np.int64)), pa.array(new)], ["key", "fp", "filed"]
                )


class Forest:
    """Union-find over 0..n-1; ``join`` says whether two were apart."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.top(i), self.top(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _linked(filed: np.ndarray, looking: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what a key brings together, no more than there are fingerprints."""
    names = np.unique(np.concatenate((filed, looking)))
    forest, out = Forest(len(names)), []
    at, to = np.searchsorted(names, filed), np.searchsorted(names, looking)
    rows = max(1, (1 << 20) // len(looking))
    for low in range(0, len(filed), rows):
        far = np.bitwise_count(filed[low : low + rows, None] ^ looking[None, :])
        for i, j in zip(*np.nonzero(far <= DISTANCE), strict=True):
            a, b = int(at[low + i]), int(to[j])
            if a != b and forest.join(a, b):
                out.append((a, b))
    return [(int(names[a]), int(names[b])) for a, b in out]


def _signed(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, dtype=np.uint64).view(np.int64))


def _verify(most: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """a, b: links inside the keys; or a, null for each member of a key with too many."""

        def done(key: np.ndarray, fp: np.ndarray, filed: np.ndarray) -> pa.RecordBatch:
            edges: list[tuple[int, int]] = []
            many: list[int] = []
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            last = np.append(first[1:], len(key))
            n_filed = np.add.reduceat(filed.astype(np.int64), first)
            # A key without filed ones, or whose only member filed itself, links nothing.
            for k in np.flatnonzero((n_filed > 0) & (last - first > 1)):
                here = slice(first[k], last[k])
                if n_filed[k] > most:
                    many += fp[here].tolist()
                else:
                    edges += _linked(fp[here][filed[here]], fp[here])
            a = _signed([x for x, _ in edges] + many)
            b = pa.concat_arrays([_signed([y for _, y in edges]), pa.nulls(len(many), pa.int64())])
            return pa.RecordBatch.from_arrays([a, b], ["a", "b"])

        rest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            columns = (
                np.asarray(batch["key"]),
                np.asarray(batch["fp"]).view(np.uint64),
                batch["filed"].to_numpy(zero_copy_only=False),
            )
            if not len(columns[0]):
                continue
            rest.append(columns)
            # What stands before the last key's first row is complete.
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            if cut:
                whole = [np.concatenate(x) for x in zip(*rest, strict=True)]
                cut += len(whole[0]) - len(columns[0])
                yield done(*(x[:cut] for x in whole))
                rest = [tuple(x[cut:] for x in whole)]
        if rest:
            yield done(*(np.concatenate(x) for x in zip(*rest, strict=True)))

    return verify


def _stars(members: DataFrame) -> DataFrame:
    """Links among fingerprints that connect all within three bits, in rows linear in theirs.

    Two fingerprints within three bits have a point within one bit of one and two bits of the other.
    Each is sent to all points within two bits, with its distance. At a point, one fingerprint within
    one bit, if there is any, is within three bits of all that came, and is linked to each.
    """
    single = [1 << b for b in range(64)]
    double = [x | y for x, y in combinations(single, 2)]
    masks = np.array([0, *single, *double], dtype=np.uint64)
    close = pa.array(np.arange(len(masks)) <= 64)

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fp in np.asarray(batch["fp"]).view(np.uint64):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((masks ^ fp).view(np.int64)),
                        pa.array(np.full(len(masks), fp).view(np.int64)),
                        close,
                    ],
                    ["point", "fp", "close"],
                )

    spread = members.mapInArrow(points, "point long, fp long, close boolean")
    hubs = (
        spread.groupBy("point")
        .agg(F.min(F.when(F.col("close"), F.col("fp"))).alias("a"), F.count("*").alias("n"))
        .where("a IS NOT NULL AND n > 1")
    )
    return (
        hubs.join(spread, "point").where("a <> fp").select("a", F.col("fp").alias("b")).distinct()
    )


def links(distinct: DataFrame, most: int = MOST) -> DataFrame:
    """a, b: pairs of fingerprints (column fp, each once) that connect all within three bits."""
    spark = distinct.sparkSession
    keyed = distinct.select("fp").mapInArrow(_keys, "key long, fp long, filed boolean")
    found = stored(
        keyed.repartition(tasks(spark), "key")
        .sortWithinPartitions("key")
        .mapInArrow(_verify(most), "a long, b long")
        .distinct()
    )
    many = found.where("b IS NULL").select(F.col("a").alias("fp"))
    sure = found.where("b IS NOT NULL")
    return sure if many.isEmpty() else sure.union(_stars(many))


def near_duplicates(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MOST
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the least doc_id that can be reached.

    Words are runs of ``[^\\x20\\x09-\\x0D]`` after lower-casing A-Z; a text of fewer than three words is
    one shingle, and one of none, or a null, has fingerprint zero, which is linked like any other. Rows with the
    same doc_id stay rows of their own. Other columns are not read. A null doc_id keeps its row, and
    is the component's name only if all its ids are null.
    """
    prints = stored(fingerprints(documents, doc_id, text))
    groups = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    top = components(links(groups, most))
    # Fingerprints without a link are components of their own.
    named = groups.join(top, groups["fp"] == top["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_print = named.select("fp", "component").join(least, "component").select("fp", "component_id")
    return prints.join(of_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``documents`` that stand first in their group, by doc_id (nulls last), then by row.

    Of repeated rows one stays. Null and empty texts are one group. An empty table stays empty. All columns are
    kept, whatever their names.
    """
    place = unused("_at", documents)
    at = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.monotonically_increasing_id().alias("row"))
    # Written, because the numbers must be the same in both uses.
    numbered = stored(documents.withColumn(place, at))
    groups = near_duplicates(numbered, place, text)
    first = groups.where("doc_id = component_id").select(F.col("doc_id.row").alias("row")).alias("first")
    same = F.col(f"numbered.{place}.row") == F.col("first.row")
    return numbered.alias("numbered").join(first, same, "left_semi").drop(place)
