"""Paired tests and intervals as aggregates."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.operators.sampling import ordered_rank
from plinth.runtime import Stage


def mcnemar(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Per group: discordant counts, statistic with continuity correction, and p as exp(-statistic / 2), as published; 0 and 1 without discordant pairs."""
    g = pairs.groupBy(*by).agg(F.count_if(F.col(a) & ~F.col(b)).alias("b"), F.count_if(~F.col(a) & F.col(b)).alias("c"))
    stat = F.when(F.col("b") + F.col("c") == 0, 0.0).otherwise(F.try_divide(F.pow(F.abs(F.col("b") - F.col("c")) - 1, F.lit(2.0)), F.col("b") + F.col("c")))
    return g.withColumn("statistic", stat).withColumn("p_value", F.when(F.col("statistic") > 0, F.exp(-F.col("statistic") / 2)).otherwise(1.0))


@F.pandas_udf(T.DoubleType())
def chi2_tail(x: pd.Series) -> pd.Series:
    """1 - CDF of chi-squared with one degree of freedom."""
    return x.map(lambda v: math.erfc(math.sqrt(max(v, 0.0) / 2)))


def wilcoxon(stage: Stage, pairs: DataFrame, order: str, a: str, b: str) -> DataFrame:
    """(n_pairs, n_nonzero, w_plus, w_minus, statistic): ranks of absolute differences by value then ``order``, ties not averaged."""
    d = pairs.select(order, (F.col(a) - F.col(b)).alias("d"))
    n = d.filter("d is not null").count()
    ranked = ordered_rank(stage, d.filter("d <> 0").withColumn("size", F.abs("d")), ["size", order], "rank_no")
    out = ranked.agg(F.count(F.lit(1)).alias("n_nonzero"), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("rank_no"))), F.lit(0)).alias("w_plus"), F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("rank_no"))), F.lit(0)).alias("w_minus"))
    return out.select(F.lit(n).cast("bigint").alias("n_pairs"), "*", F.least("w_plus", "w_minus").alias("statistic"))


def bootstrap(df: DataFrame, by: list[str], key: str, value: Column, rounds: int = 200, seed: int = 42) -> DataFrame:
    """(by, mean, low, high): Poisson bootstrap; each row's weight in each round follows from a hash, so all partial sums are combined map-side."""
    rows = df.select(*by, value.cast("double").alias("v"), F.col(key).alias("_id")).filter("v is not null")
    u = lambda r: F.pmod(F.xxhash64(F.lit(seed), F.col("_id"), r), F.lit(1 << 30)) / float(1 << 30)
    cdf = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(7)]
    weight = lambda x: sum((F.when(x > c, 1).otherwise(0) for c in cdf), F.lit(0))
    drawn = rows.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("w", weight(u(F.col("r"))))
    means = drawn.groupBy(*by, "r").agg(F.try_divide(F.sum(F.col("v") * F.col("w")), F.sum("w")).alias("m"))
    low, high = int(0.025 * rounds), int(0.975 * rounds)
    s = F.sort_array(F.collect_list("m"))  # ``rounds`` values a group
    return means.groupBy(*by).agg(F.element_at(s, low + 1).alias("low"), F.element_at(s, high + 1).alias("high")).join(rows.groupBy(*by).agg(F.avg("v").alias("mean")), by)
