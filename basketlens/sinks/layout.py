"""The layout of a table from the measured bytes of its rows."""

from __future__ import annotations

#: Bytes of a bucket's files on disk: what one task reads of a bucketed table.
BUCKET_BYTES = 128 << 20


def buckets_for(size: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets for so many bytes, a power of two, so that two tables' numbers divide each other."""
    n = 1
    while n * bucket_bytes < size:
        n *= 2
    return n
