"""Bloom filters of 64-bit hashes, built without collecting the hashes.

A filter is used only while it is less than a quarter full, so it always keeps out most of what it should; for more hashes than the
largest filter takes there is none, and ``shared`` joins the hashes by shuffle instead. What passes a filter is a superset, so what is
joined after it is exact either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most 2 ** MAX_BITS bits (32 MB) are broadcast.
MAX_BITS = 28


def bits_for(n: int, most: int = MAX_BITS) -> int | None:
    """Bits (as a power of two) for a filter of n hashes: 8 to 16 a hash; None where ``most`` do not suffice."""
    k = max(16, (8 * max(1, n) - 1).bit_length())
    return k if k <= most else None


def places(h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    h = h.view(np.uint64)
    return h & np.uint64((1 << k) - 1), h >> np.uint64(64 - k)


def build(hashes: DataFrame, n: int, most: int = MAX_BITS) -> tuple[Broadcast, int] | None:
    """(broadcast words, bits) of two probes a hash for at most ``n`` hashes in the first column; None for more than ``most`` bits hold.

    Each partition sets its bits in an array of the filter's size; words are combined map-side, so at most 2 ** (MAX_BITS - 6) words
    reach the driver.
    """
    k = bits_for(n, most)
    if k is None:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << (k - 3), np.uint8)
        for b in batches:
            for at in places(b.column(0).to_numpy(), k):
                np.bitwise_or.at(own, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        words = own.view(np.int64)
        at = np.flatnonzero(words)
        for lo in range(0, len(at), 100_000):
            part = at[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(words[part])], ["word", "bits"])

    # few tasks with many hashes each set more bits a word that is shuffled
    got = hashes.coalesce(max(1, hashes.sparkSession.sparkContext.defaultParallelism)).mapInArrow(run, "word int, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << (k - 6), np.int64)
    table[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(table.view(np.uint8)), k


def contains(table: np.ndarray, k: int, h: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the filter."""
    a, b = places(h, k)
    three, last, one = np.uint64(3), np.uint64(7), np.uint8(1)
    first = (table[a >> three] >> (a & last).astype(np.uint8)) & one == one
    at = np.flatnonzero(first)
    b = b[at]
    out = np.zeros(len(h), bool)
    out[at] = (table[b >> three] >> (b & last).astype(np.uint8)) & one == one
    return out
