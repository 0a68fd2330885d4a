"""Problem 8: filling fixed-capacity containers with documents.

Each document's hashed vector (counts of hashed byte trigrams, scaled to their number) is projected to
few dimensions and placed on a Hilbert curve. Documents are range-sorted by their key on the curve and neighbours
packed together: windows along the curve are laid by falling size into the fullest open container that
still has room. Only (doc_id, size, key) is shuffled, never a text. Equal keys are ordered by a hash of the id, so
copies, however many, spread over the ranges.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.registry import query
from plinth.runtime import Stage, ship, table

DIMS, BITS, FEATURES = 3, 10, 4096
#: Bytes of text whose vectors are computed at once.
SLICE = 1 << 20


def hilbert_key(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of integer points (n, dims) with ``bits`` bits a dimension, by Skilling's transform."""
    x = x.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ t)
            x[i] = x[i] ^ t if i else x[i]
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def projection(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((FEATURES, DIMS)).astype(np.float32)


def curve_keys(data: np.ndarray, offsets: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Keys of the texts whose UTF-8 bytes lie in ``data`` between consecutive ``offsets``, whole texts."""
    n = len(offsets) - 1
    total = np.zeros((n, DIMS))
    lo, end = int(offsets[0]), int(offsets[-1])
    while lo < end:
        hi = min(end, lo + SLICE)
        b = data[lo : min(end, hi + 2)].astype(np.uint32)
        b = np.concatenate([b, np.zeros(max(0, hi + 2 - end), np.uint32)])
        h = (b[:-2] * np.uint32(2654435761)) ^ (b[1:-1] * np.uint32(40503 * 65537)) ^ (b[2:] * np.uint32(2246822519))
        h = (h ^ (h >> np.uint32(15))) * np.uint32(2654435761) >> np.uint32(20)
        first, last = int(np.searchsorted(offsets, lo, "right")) - 1, int(np.searchsorted(offsets, hi, "left"))
        docs = np.arange(first, last)
        cuts = np.maximum(offsets[docs], lo) - lo
        full = np.minimum(offsets[docs + 1], hi) - lo > cuts
        for k in range(DIMS):
            if full.any():
                total[docs[full], k] += np.add.reduceat(r[h, k], cuts[full])
        lo = hi
    size = np.maximum(1, np.diff(offsets))[:, None]
    unit = np.tanh(16 * total / size)
    return hilbert_key(np.clip(((unit + 1) * 0.5 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1))


def place_on_curve(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, size, curve) of each document; a null text counts as empty (size 0), rows without a key are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = projection()
        for b in batches:
            t = b.column(1).fill_null("").cast(pa.large_binary())
            buffers = t.buffers()
            offsets = np.frombuffer(buffers[1], np.int64, len(t) + 1, t.offset * 8) if len(t) else np.zeros(1, np.int64)
            data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets)), pa.array(curve_keys(data, offsets, r))], ["key", "size", "curve"])

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("key is not null")
    kind = dict(out.dtypes)["key"]
    return out.mapInArrow(run, f"key {kind}, size bigint, curve bigint")


class Packer:
    """Best fit of one capacity over windows of neighbours, with a bounded number of open containers."""

    def __init__(self, name: str, capacity: int, part: int, most_open: int = 64):
        self.name, self.capacity, self.part, self.most_open, self.seq = name, capacity, part, most_open, 0
        self.room: list[tuple[int, int]] = []  # (room left, container), ascending

    def _new(self) -> int:
        self.seq += 1
        return self.seq

    def pack(self, keys: list, sizes: list[int]) -> list[tuple]:
        out, items = [], []
        for k, n in zip(keys, sizes, strict=True):
            piece = 1
            at = 0
            while n - at > self.capacity:
                out.append((self._new(), k, piece, at, self.capacity))
                piece, at = piece + 1, at + self.capacity
            items.append((n - at, k, piece, at))
        items.sort(key=lambda x: -x[0])
        for n, k, piece, at in items:
            i = bisect.bisect_left(self.room, (n, 0))
            left, c = self.room.pop(i) if i < len(self.room) else (self.capacity, self._new())
            out.append((c, k, piece, at, n))
            if left - n > 0:
                bisect.insort(self.room, (left - n, c))
                if len(self.room) > self.most_open:
                    self.room.pop(0)
        return [(self.name, f"{self.name}-{self.part:06d}-{c:07d}", k, piece, at, n) for c, k, piece, at, n in out]


def pack(spark, docs: DataFrame, key: str, text: str, specs: DataFrame, window: int = 1024) -> DataFrame:
    """(container_name, container_id, key, piece_no, first_token, tokens).

    A document is divided only if its size exceeds the capacity; then all its pieces but the last fill a container.
    Sizes are UTF-8 bytes, the tokens of the public byte-level ByT5 tokenizer without end mark. Empty
    and null texts are items of size 0. Specs with null or non-positive capacity are left out; no specs give no rows; they are a table that does not grow.
    """
    ship(spark)
    want = [(r[0], int(r[1])) for r in specs.select("container_name", "capacity_tokens").filter("capacity_tokens > 0").distinct().orderBy("container_name", "capacity_tokens").collect()]
    placed = Stage(spark, "p8").keep(place_on_curve(docs, key, text), "curve")
    ranged = placed.withColumn("tie", F.xxhash64("key")).repartitionByRange("curve", "tie").sortWithinPartitions("curve", "tie", "key").select("key", "size")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        packers = [Packer(n, c, part) for n, c in want]
        for f in frames:
            for at in range(0, len(f), window):
                w = f.iloc[at : at + window]
                rows = [r for p in packers for r in p.pack(w["key"].tolist(), w["size"].tolist())]
                yield pd.DataFrame(rows, columns=["container_name", "container_id", "key", "piece_no", "first_token", "tokens"])

    kind = dict(placed.dtypes)["key"]
    return ranged.mapInPandas(run, f"container_name string, container_id string, key {kind}, piece_no bigint, first_token bigint, tokens bigint").withColumnRenamed("key", key)


def packed(spark, d: str) -> DataFrame:
    return pack(spark, table(spark, d, "documents"), "doc_id", "text", table(spark, d, "container_spec"))


@query("p8_found", "SELECT DISTINCT container_name, doc_id FROM documents, container_spec WHERE strlen(text) > capacity_tokens")
def p8_found(spark, d):
    """Divided documents: exactly those that have a second piece."""
    return packed(spark, d).filter("piece_no = 2").select("container_name", "doc_id").distinct()


@query("p8_contents")
def p8_contents(spark, d):
    return packed(spark, d)


@query("p8_fill")
def p8_fill(spark, d):
    """Per container kind: containers, tokens, and the share of the capacity that is filled."""
    used = packed(spark, d).groupBy("container_name").agg(F.countDistinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"))
    return table(spark, d, "container_spec").join(used, "container_name", "left").withColumn("filled", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
