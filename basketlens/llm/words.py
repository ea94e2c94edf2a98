"""Words of UTF-8 texts as byte spans and 64-bit hashes, with numpy and whole batches at once.

A word is a run of ``[^\\x20\\x09-\\x0D]``. All separators are single bytes, so words can be found
in the bytes without decoding. Memory follows PIECE, or one text if that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once.
PIECE = 1 << 21

_rng = np.random.default_rng(20240115)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.ones(max(n, 1), dtype=np.uint64)
        known[1:] = np.uint64(base)
        _powers[base] = known = np.multiply.accumulate(known)
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Texts:
    """Some rows of a text column: ``data`` bytes, ``offsets`` of the texts in them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first
        word = ~_SPACE[data]
        n = len(data)
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0] = after[-1] = False
            before[1:] = word[:-1]
            after[:-1] = word[1:]
        self.starts = np.flatnonzero(word & (~before | edge[:-1]))
        self.ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        #: Word offsets of the texts.
        self.of_text = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word; equal words have equal hashes in all texts."""
        out = np.empty(len(self.starts), dtype=np.uint64)
        at = 0
        while at < len(out):
            # As many words as fit into PIECE bytes, one at least.
            low = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, low + PIECE, "right")))
            part = self.data[low : self.ends[to - 1]]
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(_BYTE[part] * _power(_BASE, len(part)), out=sums[1:])
            s, e = self.starts[at:to] - low, self.ends[at:to] - low
            raw = (sums[e] - sums[s]) * _power(_INVERSE, len(part) + 1)[s]
            out[at:to] = mix(raw + (e - s).astype(np.uint64))
            at = to
        return out


def pieces(texts: pa.Array, most: int = PIECE) -> Iterator[Texts]:
    """The rows in order, in groups of about ``most`` bytes; a null is an empty text."""
    column = texts.fill_null("").cast(pa.large_binary())
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[
        column.offset : column.offset + len(column) + 1
    ]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, len(column))
        yield Texts(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at)
        at = to


def lower_ascii(texts: Texts) -> np.ndarray:
    """The bytes with A-Z as a-z; other characters stay."""
    data = texts.data
    return np.where((data >= 0x41) & (data <= 0x5A), data + np.uint8(32), data)
