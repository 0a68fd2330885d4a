"""Exact duplicates, first and last wins, resolutions."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.operators import components, similarity
from plinth.runtime import Stage


def exact_groups(df: DataFrame, key: str, h: Column) -> DataFrame:
    """(h, keeper, n): groups of two or more rows with one hash; null hashes form no group."""
    return df.select(F.col(key).alias("k"), h.alias("h")).filter("h is not null").groupBy("h").agg(F.min("k").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1")


def resolution(df: DataFrame, key: str, h: Column) -> DataFrame:
    """(key, h, n, keeper, action): least key of a hash is kept. Sums per hash are joined back, so no group is ever held by one task's window.

    Null hashes are kept, each for itself.
    """
    rows = df.select(F.col(key), h.alias("h"))
    by = rows.filter("h is not null").groupBy("h").agg(F.min(key).alias("keeper"), F.count(F.lit(1)).alias("n"))
    out = rows.join(by, "h", "left")
    return out.select(key, "h", F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("keeper", F.col(key)).alias("keeper"), F.when(F.col("keeper").isNull() | (F.col("keeper") == F.col(key)), "keep").otherwise("remove").alias("action"))


def first_wins(df: DataFrame, by: list[str], order: str, last: bool = False) -> DataFrame:
    """The row with the least (or greatest) ``order`` of each key, by a map-side combined aggregate, all columns kept.

    Null keys form one group. Ties in ``order`` give one of the rows.
    """
    pick = (F.max_by if last else F.min_by)(F.struct(*[F.col(c) for c in df.columns]), F.col(order))
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    return df.groupBy(*keys).agg(pick.alias("_row")).select("_row.*")


def duplicate_pairs(df: DataFrame, key: str, by: Column) -> DataFrame:
    """(first, key): each later row with the first that has the same value; null values pair with none."""
    rows = df.select(F.col(key).alias("k"), by.alias("v")).filter("v is not null")
    first = rows.groupBy("v").agg(F.min("k").alias("first"))
    return rows.join(first, "v").filter("k > first").select("first", F.col("k").alias(key))


def surplus_ids(df: DataFrame, key: str) -> DataFrame:
    """(rows, ids, surplus)."""
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.countDistinct(key).alias("ids")).withColumn("surplus", F.col("row_count") - F.col("ids"))


def leaders(stage: Stage, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(leader, member): greedy leader clustering: in order of key, each row that no one has claimed claims its later similar rows.

    ``pairs``: each similar pair once, a < b. The order's result is reached in rounds, over all rows at once: a row none of whose earlier
    neighbours is still open leads, later neighbours of leaders are claimed. Each round settles the first open row at least, so the rounds end. Rows in no pair are not listed.
    """
    edges = stage.keep(pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct(), "pairs")
    node = edges.select(F.col("a").alias("k")).union(edges.select(F.col("b").alias("k"))).distinct()
    state = stage.keep(node.select("k", F.lit(0).alias("s")), "state0")  # 0 open, 1 leads, 2 claimed
    for n in itertools.count(1):
        open_ = state.filter("s = 0").select("k")
        left = edges.join(open_.withColumnRenamed("k", "a"), "a", "left_semi").join(open_.withColumnRenamed("k", "b"), "b", "left_semi")
        lead = open_.join(left.select(F.col("b").alias("k")).distinct(), "k", "left_anti")
        claimed = left.join(lead.withColumnRenamed("k", "a"), "a", "left_semi").select(F.col("b").alias("k")).distinct()
        done = lead.select("k", F.lit(1).alias("t")).unionByName(claimed.select("k", F.lit(2).alias("t")))
        state = stage.keep(state.join(done, "k", "left").select("k", F.coalesce("t", "s").alias("s")), f"state{n}")
        stage.drop(f"state{n - 1}")
        if not state.filter("s = 0").limit(1).count():
            leads = state.filter("s = 1").select(F.col("k").alias("a"))
            members = state.filter("s = 2").select(F.col("k").alias("b"))
            return edges.join(leads, "a", "left_semi").join(members, "b", "left_semi").groupBy("b").agg(F.min("a").alias("leader")).select("leader", F.col("b").alias("member"))


def code_groups(stage: Stage, df: DataFrame, key: str, code: str, most: int) -> DataFrame:
    """(key, label): least key that is linked with each row by equal codes or by chains of codes with at most ``most`` differing bits; rows without a code are alone.

    Rows of equal code are one class, whose least key stands for it.
    """
    reps = stage.keep(df.filter(F.col(code).isNotNull()).groupBy(code).agg(F.min(key).alias("rep")), "codes")
    labels = components.connected(stage, similarity.hamming_pairs(reps, "rep", code, most), "a", "b").withColumnRenamed("node", "rep")
    return df.select(key, code).join(reps.join(labels, "rep", "left"), code, "left").select(key, F.coalesce("label", "rep", key).alias("label"))


def code_leaders(stage: Stage, df: DataFrame, key: str, code: str, most: int) -> DataFrame:
    """(leader, member) of ``leaders`` by codes with at most ``most`` differing bits, equal codes included.

    The least key of a code leads its copies, or goes with them to the same earlier leader, so only these keys are compared.
    """
    reps = stage.keep(df.filter(F.col(code).isNotNull()).groupBy(code).agg(F.min(key).alias("rep")), "codes")
    led = leaders(stage, similarity.hamming_pairs(reps, "rep", code, most), "a", "b").withColumnRenamed("member", "rep")
    home = reps.join(led, "rep", "left").select(code, F.coalesce("leader", "rep").alias("leader"))
    return df.select(F.col(key).alias("member"), code).join(home, code).filter("leader <> member").select("leader", "member").distinct()


def window_rank(by: list[str], order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))
