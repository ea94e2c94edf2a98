"""Byte-level BPE: encoding by ranks, and decoding.

A text is cut into pre-tokens by a pattern, and each pre-token is merged on its own. First tier: a
minimal perfect hash over the vocabulary (a slot for each entry and none free) says whether a whole
pre-token is an entry. Second tier: the bytes become a linked list, and a heap gives the pair of
least rank, leftmost first, until no pair is an entry.

The vocabulary and its hash go to the executors as they are; their size is that of the rank file
(about a megabyte), whatever the corpus. Texts are encoded where they are read, so there is no shuffle.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.memo import Memo
from basketlens.llm.words import pieces

#: Bytes of text handled at once, and chunks remembered by a Python worker.
PIECE = 1 << 23
REMEMBERED = 400_000
#: Longer chunks are not remembered.
LONGEST = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each entry, base64 bytes and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def names(ranks: dict[bytes, int]) -> dict[int, bytes]:
    return {i: k for k, i in ranks.items()}


def spelled(names: dict[int, bytes], ids: bytes) -> bytes | None:
    """The bytes of ids (little-endian, 32 bits each); null if one is unknown or cut short."""
    if len(ids) % 4:
        return None
    try:
        return b"".join(map(names.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
    except KeyError:
        return None


class PerfectHash:
    """A minimal perfect hash: n keys, n slots, built by hashing and displacing.

    Keys are dealt to buckets. From the largest bucket on, the first displacement is taken that puts
    all its keys into free slots; buckets of one key get a free slot by number (as -1 - slot). Bucket and
    displaced slots come from hashes of different seeds, so keys that share a bucket share nothing
    else, and each displacement is a new throw. A bucket that finds no place in ``TRIES`` throws starts the
    whole construction again with other seeds.
    """

    TRIES = 1 << 14

    def __init__(self, keys: list[bytes]):
        if len(set(keys)) < len(keys):
            raise ValueError("repeated keys")
        n = self.n = len(keys)
        self.buckets = max(1, n // 3)
        self.seed = 0
        while n and not self._built(keys):
            self.seed += 1 << 32

    def _built(self, keys: list[bytes]) -> bool:
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, key in enumerate(keys):
            members[self._hash(key, self.seed) % self.buckets].append(i)
        self.moves = [0] * self.buckets
        self.slots: list[int] = [-1] * self.n
        single = []
        for bucket in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            inside = members[bucket]
            if len(inside) == 1:
                single.append(bucket)
            elif inside and not self._placed(bucket, inside, keys):
                return False
        free = [x for x in range(self.n) if self.slots[x] < 0]
        for bucket, slot in zip(single, free, strict=True):
            self.moves[bucket] = -1 - slot
            self.slots[slot] = members[bucket][0]
        return True

    def _placed(self, bucket: int, inside: list[int], keys: list[bytes]) -> bool:
        for move in range(self.TRIES):
            at = [self._hash(keys[i], self.seed + 1 + move) % self.n for i in inside]
            if all(self.slots[x] < 0 for x in at) and len(set(at)) == len(at):
                for i, x in zip(inside, at, strict=True):
                    self.slots[x] = i
                self.moves[bucket] = move
                return True
        return False

    _hash = staticmethod(xxhash.xxh3_64_intdigest)

    def find(self, key: bytes) -> int:
        """The place of the only key that this one can be; -1 if there are no keys."""
        if not self.n:
            return -1
        move = self.moves[self._hash(key, self.seed) % self.buckets]
        return self.slots[-1 - move if move < 0 else self._hash(key, self.seed + 1 + move) % self.n]


class Vocabulary:
    """Encoding and decoding by ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [x for x in range(256) if bytes([x]) not in ranks]
        if missing:
            raise ValueError(f"bytes without a rank: {missing}")
        self.ranks, self.pattern = ranks, pattern
        self.keys = list(ranks)
        self.ids = list(ranks.values())
        self.whole = PerfectHash(self.keys)
        self.bytes_of = names(ranks)
        self._ready()

    def _ready(self) -> None:
        self.find = regex.compile(self.pattern).findall
        self.memo = Memo(REMEMBERED)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("find", "memo")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._ready()

    def merge(self, token: bytes) -> list[int]:
        """A pre-token that is no entry: the merges over its bytes."""
        n = len(token)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        rank = self.ranks.get
        # An entry is rank, start, end in one number, and good if its two pieces are as they were.
        shift = 16 if n < 1 << 16 else 40
        low = (1 << shift) - 1
        heap = [
            ((r << shift | i) << shift) | i + 2
            for i in range(n - 1)
            if (r := rank(token[i : i + 2])) is not None
        ]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            end = entry & low
            start = entry >> shift & low
            middle = after[start]
            if middle < 0 or middle >= n or after[middle] != end:
                continue
            after[start], after[middle] = end, -1
            if end < n:
                before[end] = start
                to = after[end]
                if (r := rank(token[start:to])) is not None:
                    heappush(heap, ((r << shift | start) << shift) | to)
            first = before[start]
            if first >= 0 and (r := rank(token[first:end])) is not None:
                heappush(heap, ((r << shift | first) << shift) | end)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[token[i : after[i]]])
            i = after[i]
        return out

    def _chunk(self, chunk: bytes) -> bytes:
        ids: list[int] = []
        for token in self.find(chunk.decode()):
            token = token.encode()
            at = self.whole.find(token)
            if self.keys[at] == token:
                ids.append(self.ids[at])
            else:
                ids += self.merge(token)
        return np.array(ids, dtype="<u4").tobytes()

    def encode_chunks(self, chunks: list[bytes]) -> list[bytes]:
        out = []
        for chunk in chunks:
            ids = self.memo.get(chunk)
            if ids is None:
                ids = self._chunk(chunk)
                if len(chunk) <= LONGEST:
                    self.memo.put(chunk, ids)
            out.append(ids)
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(self.encode_chunks([text.encode()])), dtype="<u4").tolist()

    def decode(self, ids: bytes) -> bytes | None:
        return spelled(self.bytes_of, ids)


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where a new chunk begins: white space with what follows it up to the next white space.

    A pre-token of the usual patterns may begin with white space or be white space, but has none after
    another character, and looks back at nothing; so chunks can be encoded one by one.
    """
    white = np.zeros(len(data) + 3, dtype=bool)
    white[: len(data)] = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    for lead, rest in (
        # White space outside ASCII: first byte, and the bytes that may follow.
        (0xC2, ((0x85,), (0xA0,))),
        (0xE1, ((0x9A, 0x80),)),
        (0xE2, (*((0x80, x) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0x81, 0x9F))),
        (0xE3, ((0x80, 0x80),)),
    ):
        at = np.flatnonzero(data == lead)
        if not len(at):
            continue
        padded = np.append(data, np.zeros(2, dtype=np.uint8))
        for tail in rest:
            good = np.logical_and.reduce([padded[at + 1 + i] == x for i, x in enumerate(tail)])
            for i in range(len(tail) + 1):
                white[at[good] + i] = True
    white = white[: len(data)]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[1:-1] = white[1:] & ~white[:-1]
    first[offsets] = True
    first[-1] = False
    return np.flatnonzero(first)


def _encode(vocabulary, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: Vocabulary = vocabulary.value
    for batch in batches:
        for texts in pieces(batch["text"], PIECE):
            starts = chunk_starts(texts.data, texts.offsets)
            # The chunks lie side by side, so they are an Arrow column over the same bytes.
            column = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(),
                len(starts),
                [None, pa.py_buffer(np.append(starts, len(texts.data))), pa.py_buffer(texts.data)],
            )
            coded = column.dictionary_encode()
            part = known.encode_chunks(coded.dictionary.to_pylist()).__getitem__
            codes = coded.indices.to_numpy()
            at = np.searchsorted(starts, texts.offsets)
            ids = [b"".join(map(part, codes[at[i] : at[i + 1]].tolist())) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].slice(texts.first, len(texts)),
                    pa.array(ids, pa.binary()),
                    pa.array([known.decode(x) for x in ids], pa.binary()),
                ],
                ["doc_id", "ids", "decoded"],
            )


def round_trip(
    documents: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, ids, decoded for every text.

    ``ids`` are the token ids as little-endian unsigned 32-bit numbers in one binary value, and
    ``decoded`` the bytes these stand for, looked up from the ids. A null text counts as empty: no
    ids, no bytes. Each row is encoded by itself; repeated rows and ids, also null ones, stay. Other columns are
    not read. ``path`` is a rank file the driver can read; no special tokens are known.
    """
    frame = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = frame.schema["doc_id"].dataType.simpleString()
    vocabulary = documents.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(path), pattern))
    return frame.mapInArrow(
        lambda batches: _encode(vocabulary, batches), f"doc_id {kind}, ids binary, decoded binary"
    )


def decode(frame: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The frame with a column of the bytes its ids stand for; null for null or unknown ids.

    Empty ids are empty bytes; repeated rows and other columns stay as they are. A column that has the name
    of the new one is replaced.
    """
    known = frame.sparkSession.sparkContext.broadcast(names(read_ranks(path)))
    kept = [c for c in frame.columns if c != decoded or c == ids]
    out = [c for c in kept if c != decoded]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in frame.select(*out).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([None if x is None else spelled(known.value, x) for x in batch[ids].to_pylist()], pa.binary())
            yield batch.select(out).append_column(decoded, texts)

    return frame.select(*kept).mapInArrow(run, ", ".join([*fields, f"`{decoded}` binary"]))
