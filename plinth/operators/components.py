"""Connected components by minimum labels; nodes of one label become one node for the next round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.runtime import Stage


def connected(stage: Stage, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): least node that is linked with each node of ``pairs``. Null ends and loops link nothing.

    In each round every node takes the least label of itself and its neighbours, least by a hash, so that a chain in the order of its ids is none in that of the
    labels; nodes with one label become one, and edges between them vanish. What is left shrinks geometrically, also where a hub has a third
    of all links, and the rounds end when no edge is left. Minima are combined before each shuffle; a hub's rows in a join are split by adaptive execution.
    """
    ends = lambda e: e.filter("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    edges = stage.keep(ends(pairs.select(F.col(a).alias("x"), F.col(b).alias("y"))), "edges0")
    maps: list[DataFrame] = []
    while edges.limit(1).count():
        k = len(maps)
        both = edges.select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("e")).select("e.x", "e.y")
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
        near = both.groupBy("x").agg(F.min(rank("y")).alias("best"))
        maps.append(stage.keep(near.select(F.col("x").alias("node"), F.least(rank("x"), "best")["n"].alias("up")), f"map{k}"))
        x, y = (maps[k].withColumnsRenamed({"node": c, "up": f"u{c}"}) for c in "xy")
        edges = stage.keep(ends(edges.join(x, "x").join(y, "y").select(F.col("ux").alias("x"), F.col("uy").alias("y"))), f"edges{k + 1}")
        stage.drop(f"edges{k}")
    if not maps:
        return edges.select(F.col("x").alias("node"), F.col("y").alias("label"))
    label = maps[-1]
    for one in reversed(maps[:-1]):
        label = one.join(label.select(F.col("node").alias("up"), F.col("up").alias("top")), "up", "left").select("node", F.coalesce("top", "up").alias("up"))
    label = stage.keep(label, "tops")
    least = label.groupBy("up").agg(F.min("node").alias("label"))
    return label.join(least, "up").select("node", "label")
