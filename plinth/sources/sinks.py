"""Tables into files: JSON lines, splits, routes, reports, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.operators.sampling import ordered_rank
from plinth.runtime import Stage


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """One JSON object a row; the commit protocol makes the files appear whole or not at all."""
    df.write.mode("append" if append else "overwrite").json(path)


def write_splits(df: DataFrame, split: str, path: str) -> None:
    """A folder per split, in one pass."""
    df.write.mode("overwrite").partitionBy(split).json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small table as one CSV file with a header, all values quoted."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def route(df: DataFrame, routes: dict[str, Column], path: str) -> None:
    """Each row to the folder of the first route that holds, in one pass; rows without one go to ``rest``."""
    to = F.lit(None).cast("string")
    for name, holds in reversed(routes.items()):
        to = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(to)
    df.withColumn("route", F.coalesce(to, F.lit("rest"))).write.mode("overwrite").partitionBy("route").json(path)


def versioned(stage: Stage, df: DataFrame, key: str, order: list[str], prefix: str) -> tuple[DataFrame, DataFrame]:
    """(rows with new ids, mapping old to new): ids count on from 0 in the given order."""
    ranked = ordered_rank(stage, df, order, "_n").withColumn("new_id", F.format_string(prefix + "_%04d", F.col("_n") - 1)).drop("_n")
    return ranked.drop(key).withColumnRenamed("new_id", key), ranked.select(F.col(key).alias("old_id"), "new_id")
