"""Windowed aggregates for batches and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, ts: str, size: str, by: list[str], aggs: dict[str, Column], late: str | None = None) -> DataFrame:
    """Aggregates per window and group; on a stream ``late`` sets how long rows are waited for, later ones are dropped."""
    if late:
        df = df.withWatermark(ts, late)
    g = df.groupBy(F.window(ts, size).alias("w"), *by).agg(*[c.alias(n) for n, c in aggs.items()])
    return g.select(*by, F.col("w.start").alias("start"), *aggs)


def sessions(df: DataFrame, ts: str, by: str, gap: str, late: str | None = None) -> DataFrame:
    """(by, start, n): rows of one key less than ``gap`` apart are one session."""
    if late:
        df = df.withWatermark(ts, late)
    return df.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start"), "n")
