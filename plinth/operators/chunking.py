"""Splitting texts into chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where a chunk ends best, in this order.
BOUNDARIES = ("\n\n", "\n", "。", ". ", "；", "; ", "，", ", ", " ")


def cuts(text: str, most: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of chunks of at most ``most`` characters; a boundary is looked for in the last 30 %.

    A chunk always begins after the one before it, also where the boundary lies within the overlap.
    """
    out, start, n = [], 0, len(text)
    while start < n:
        end = min(n, start + most)
        if end < n:
            lo = start + int(most * 0.7)
            for b in BOUNDARIES:
                at = text.rfind(b, lo, end)
                if at >= 0:
                    end = at + len(b)
                    break
        out.append((start, end))
        if end >= n:
            break
        start = max(end - overlap, start + 1)
    return out


def split_overlapping(df: DataFrame, key: str, text: str, most: int = 3000, overlap: int = 200) -> DataFrame:
    """(key, chunk_no, start, end, chunk); null and empty texts have none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, i, a, b, t[a:b]) for k, t in zip(f["key"], f["text"], strict=True) for i, (a, b) in enumerate(cuts(t, most, overlap))]
            yield pd.DataFrame(rows, columns=["key", "chunk_no", "start", "end", "chunk"])

    src = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null")
    return src.mapInPandas(run, f"key {dict(src.dtypes)['key']}, chunk_no bigint, start bigint, end bigint, chunk string").withColumnRenamed("key", key)


def fixed_stride(df: DataFrame, key: str, text: str, size: int, stride: int) -> DataFrame:
    """(key, start, chunk): windows of ``size`` characters every ``stride``; an empty text has one empty window."""
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.length(text) - 1, F.lit(0)).cast("bigint"), F.lit(stride).cast("bigint"))
    return df.select(key, F.col(text), F.explode(starts).alias("start")).select(key, "start", F.substr(F.col(text), (F.col("start") + 1).cast("int"), F.lit(size)).alias("chunk"))
