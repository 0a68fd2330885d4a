"""Splits by group, and checks that nothing spans them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.operators.ranking import bucketed_rank, hash_key


def by_group(df: DataFrame, group: Column, share: float, names: tuple[str, str], seed: int = 42) -> DataFrame:
    """Adds ``split``: the first max(1, share * groups) groups by seeded hash get ``names[0]``. Null groups must be filled before.

    Only the distinct groups are ranked, in buckets, so a hot group is one row.
    """
    rows = df.withColumn("_g", group)
    groups = rows.select("_g").distinct()
    n = groups.count()
    first = max(1, int(share * n)) if n else 0
    ranked = bucketed_rank(groups.withColumn("_h", hash_key(seed, "_g")), [], "_h", ["_g"])
    where = ranked.select("_g", F.when(F.col("rank_no") <= first, names[0]).otherwise(names[1]).alias("split"))
    return rows.drop("split").join(where, "_g").drop("_g")


def spans(df: DataFrame, split: str, value: Column) -> DataFrame:
    """(value, splits): values that occur in two or more splits; null values and splits take no part."""
    return df.select(F.col(split).alias("s"), value.alias("value")).filter("s is not null and value is not null").groupBy("value").agg(F.countDistinct("s").alias("splits")).filter("splits > 1")
