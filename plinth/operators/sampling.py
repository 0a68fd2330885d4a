"""Caps, seeded and proportional samples, budgets and batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.operators.ranking import range_rank
from plinth.runtime import Stage


def seeded(seed: int, key: str) -> Column:
    """Order of a seeded sample: MD5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows of each group. Spark prunes each task's rows to k before the shuffle, so a hot group moves little."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_rn") <= k).drop("_rn")


def sample_per_group(df: DataFrame, by: list[str], key: str, k: int, seed: int = 42) -> DataFrame:
    return top_per_group(df, by, [seeded(seed, key), F.col(key)], k)


def proportional(df: DataFrame, by: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """min(n_g, max(1, n * n_g div N)) rows of each group, by seeded order; null groups form one."""
    sizes = df.groupBy(F.col(by).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    total = df.count()
    quota = sizes.withColumn("_q", F.least(F.col("_n"), F.greatest(F.lit(1), F.floor(F.lit(n) * F.col("_n") / F.lit(max(1, total))))))
    most = n  # no group gets more than the whole sample
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(seeded(seed, key), F.col(key)))).filter(F.col("_rn") <= most)
    return ranked.join(F.broadcast(quota) if total < 10_000_000 else quota, F.col(by).eqNullSafe(F.col("_g"))).filter("_rn <= _q").drop("_rn", "_g", "_n", "_q")


def ordered_rank(stage: Stage, df: DataFrame, order: list[str], name: str = "row_no") -> DataFrame:
    """Adds the global rank (from 1) by ``order``: ranges are ranked apart and shifted by the counts before them."""
    ranged = stage.keep(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), f"ranked-{name}")
    part, inside = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ranged.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    before = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return ranged.withColumn("_p", part).join(F.broadcast(before), "_p").withColumn(name, inside + F.col("_b") + 1).drop("_p", "_b", "_id")


def budget_prefix(stage: Stage, df: DataFrame, by: list[str], order: list[Column], names: list[str], size: Column, budget: int) -> DataFrame:
    """Rows of each group in order, as long as their running size stays within the budget: stops at the first overflow."""
    return range_rank(stage, df, by, order, names, size, "budget").withColumn("running", F.col("size_before") + size).filter(F.col("running") <= budget).drop("rank_no", "size_before")


def size_batches(df: DataFrame, by: str, order: str, size: str, most: int) -> DataFrame:
    """(by, order, batch): a batch ends before the row that would take it beyond ``most``; a larger row is a batch alone.

    The resetting sum runs over each group's sorted rows as they stream by; a group is never held.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, batch, total = object(), 0, 0
        for f in frames:
            out = []
            for g, n in zip(f[by].tolist(), f[size].tolist(), strict=True):
                if g != group:
                    group, batch, total = g, 0, 0
                elif total + n > most:
                    batch, total = batch + 1, 0
                total += n
                out.append(batch)
            yield f[[by, order]].assign(batch=out)

    kinds = dict(df.dtypes)
    return df.select(by, order, size).repartition(by).sortWithinPartitions(by, order).mapInPandas(run, f"{by} {kinds[by]}, {order} {kinds[order]}, batch bigint")
