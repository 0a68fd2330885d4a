"""Ranks and running sums over groups of any size, without one task per group.

Rows of a group are spread over buckets of a uniform 64-bit key. Counts (or sums) per bucket are
small; their running sums give each bucket its offset, and only rows of one bucket are ever sorted
together. A group that holds a third of all rows is so cut into ``buckets`` pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.runtime import Stage


def hash_key(seed: int, *cols: str) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in cols])


def bucketed_rank(df: DataFrame, group: list[str], key: str, tie: list[str], size: Column | None = None, buckets: int = 4096) -> DataFrame:
    """Adds ``rank_no`` (from 1, by ``key`` then ``tie`` within ``group``) and, with ``size``, ``size_before``.

    ``key`` is a BIGINT hash. Null groups form a group. The offsets table has at most
    groups x ``buckets`` rows. Ties in ``key`` are ordered by ``tie``; rows equal in both get an arbitrary order.
    """
    size = F.lit(0).cast("bigint") if size is None else size
    df = df.withColumn("_b", F.pmod(F.col(key), F.lit(buckets).cast("bigint"))).withColumn("_size", size)
    by = [*group, "_b"]
    part = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_s"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(*[F.col(c).alias(f"_o_{c}") for c in by], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"))
    on = None
    for c in by:
        same = F.col(c).eqNullSafe(F.col(f"_o_{c}"))
        on = same if on is None else on & same
    inside = Window.partitionBy(*by).orderBy(key, *tie)
    run = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_r", F.row_number().over(inside)).withColumn("_w", F.coalesce(F.sum("_size").over(run), F.lit(0)))
    out = out.join(part, on).withColumn("rank_no", F.col("_n0") + F.col("_r")).withColumn("size_before", F.col("_s0") + F.col("_w"))
    return out.drop("_b", "_size", "_r", "_w", "_n0", "_s0", *[f"_o_{c}" for c in by])


def range_rank(stage: Stage, df: DataFrame, group: list[str], order: list[Column], names: list[str], size: Column | None = None, label: str = "ranged") -> DataFrame:
    """Adds ``rank_no`` and, with ``size``, ``size_before`` by ``order`` within ``group``, whatever the size of a group.

    Rows are range-partitioned by group and order, so a hot group spans many ranges; each range is ranked apart, and the counts of
    a group's earlier ranges are its offset. ``names`` make the order total; null groups form one group.
    """
    keys = [F.col(c) for c in group]
    full = [*keys, *order, *[F.col(c) for c in names]]
    rows = df.withColumn("_size", F.lit(0).cast("bigint") if size is None else size.cast("bigint"))
    rows = stage.keep(rows.repartitionByRange(*full).withColumn("_p", F.spark_partition_id()), label)
    by = ["_p", *group]
    part = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_s"))
    before = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per range of a group
    part = part.select(*[F.col(c).alias(f"_o_{c}") for c in by], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"))
    on = None
    for c in by:
        same = F.col(c).eqNullSafe(F.col(f"_o_{c}"))
        on = same if on is None else on & same
    inside = Window.partitionBy(*by).orderBy(*order, *names)
    out = rows.withColumn("_r", F.row_number().over(inside)).withColumn("_w", F.coalesce(F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = out.join(part, on).withColumn("rank_no", F.col("_n0") + F.col("_r")).withColumn("size_before", F.col("_s0") + F.col("_w"))
    return out.drop("_p", "_size", "_r", "_w", "_n0", "_s0", *[f"_o_{c}" for c in by])
