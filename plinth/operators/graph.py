"""Property graphs: neighbours, scores, greedy selection under a token budget, levels of a DAG."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.runtime import Stage, ship

# Weights of the edge score and tokens by type of node.
WEIGHTS = {"relevance": 1.0, "dependency": 0.5, "recency": 0.3, "trust": 0.4, "redundancy": -0.6, "cost": -0.2}
NODE_TOKENS = {"agent": 200, "task": 300, "artifact": 500, "memory": 400, "tool": 150, "constraint": 200}


def edge_weight(**scores: Column) -> Column:
    """Sigmoid of the weighted scores; scores that are not given count as 0."""
    logit = sum((F.coalesce(scores[k], F.lit(0.0)) * w for k, w in WEIGHTS.items() if k in scores), F.lit(0.0))
    return 1 / (1 + F.exp(-logit))


def node_tokens(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in NODE_TOKENS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, kind), F.lit(300))


def recency(age: Column, half_life: float = 3600.0) -> Column:
    return F.exp(-F.lit(0.6931471805599453) * age / half_life)


def undirected(edges: DataFrame, a: str = "source_id", b: str = "target_id") -> DataFrame:
    """(x, y) in both directions, without loops and repeats."""
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    return e.union(e.select("y", "x")).distinct()


def reach(near: DataFrame, start: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(start, node) one hop from each start node, (start, same) and (same, node) two hops and not one from the starts of class ``same``.

    Start nodes with the same neighbours are one class, named by its least start, as they have the same second hop but for themselves: each
    start's own row is still among its class's nodes. Sets are compared by 128 bits of hash and their size.
    """
    one = start.select("start").distinct().join(near.withColumnsRenamed({"x": "start", "y": "node"}), "start").select("start", "node")
    sets = one.groupBy("start").agg(*[F.bit_xor(F.xxhash64(F.lit(seed), "node")).alias(f"h{seed}") for seed in (0, 1)], F.count(F.lit(1)).alias("n"))
    named = sets.groupBy("h0", "h1", "n").agg(F.min("start").alias("same"))
    same = sets.join(named, ["h0", "h1", "n"]).select("start", "same")
    first = one.join(named.select(F.col("same").alias("start")), "start", "left_semi").select(F.col("start").alias("same"), "node")
    second = first.join(near.withColumnsRenamed({"x": "node", "y": "far"}), "node").select("same", F.col("far").alias("node")).distinct()
    return one, same, second.join(first, ["same", "node"], "left_anti")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spread(same: DataFrame, rows: DataFrame, size: int = 1000) -> DataFrame:
    """``start`` and the columns of ``rows`` (same, node, ...) for all starts of each class (start, same) but a node itself.

    Starts and rows of a class are cut into blocks of about ``size``, and each pair of blocks is a unit of its own, so only blocks are shuffled and a class of any size
    is shared by all tasks.
    """

    def blocks(df: DataFrame, key: str, name: str, number: str) -> DataFrame:
        n = df.groupBy("same").agg(F.ceil(F.count(F.lit(1)) / size).alias("_n"))
        cut = df.join(n, "same").withColumn(number, F.pmod(F.xxhash64(key), "_n"))
        return cut.groupBy("same", number).agg(F.collect_list(F.struct(*[c for c in df.columns if c != "same"])).alias(name))

    # a stated number of partitions, as adaptive execution would put the units into a few tasks of unlike size
    units = blocks(same, "start", "_starts", "_i").join(blocks(rows, "node", "_rows", "_j"), "same").repartition(partitions(rows), "same", "_i", "_j")
    # one loop over a unit's pairs would hold a copy of each of its rows at once; with the lambda Spark generates one for each start
    each = units.select(F.explode(F.transform("_starts", lambda x: x["start"])).alias("start"), "_rows")
    return each.select("start", F.inline("_rows")).filter("start <> node")


def within_two_hops(near: DataFrame, start: DataFrame) -> DataFrame:
    """(start, node, hops) of the distinct nodes one or two hops from each start node, least hops."""
    one, same, second = reach(near, start)
    hops = lambda k: F.lit(k).cast("bigint").alias("hops")
    return one.select("start", "node", hops(1)).unionByName(spread(same, second).select("start", "node", hops(2)))


def remove_nodes(edges: DataFrame, gone: DataFrame, key: str = "node_id") -> DataFrame:
    """Edges that touch none of the removed nodes."""
    for c in ("source_id", "target_id"):
        edges = edges.join(gone.select(F.col(key).alias(c)), c, "left_anti")
    return edges


def node_score(quality: Column, edge: Column | None = None, beta: float = 0.3, gamma: float = 0.4) -> Column:
    """relevance + beta * dependency + gamma * trust of an edge (struct).

    Stored scores of 0 count as missing, and nodes without an edge have relevance 0.5, dependency and trust 0; trust is at least
    the node's quality.
    """
    given = lambda c, d: F.lit(d) if edge is None else F.coalesce(F.nullif(edge[c], F.lit(0.0)), F.lit(d))
    return given("relevance", 0.5) + beta * given("dependency", 0.0) + gamma * F.greatest(given("trust", 0.0), F.coalesce(quality, F.lit(0.0)))


def candidate_scores(candidates: DataFrame, edges: DataFrame, beta: float = 0.3, gamma: float = 0.4) -> DataFrame:
    """Adds ``score`` to (start, node, quality): that of the edge with the least id by ``node_score``."""
    both = edges.select(F.col("source_id").alias("start"), F.col("target_id").alias("node"), "edge_id", "relevance", "dependency", "trust")
    both = both.unionByName(both.select(F.col("node").alias("start"), F.col("start").alias("node"), "edge_id", "relevance", "dependency", "trust"))
    best = both.groupBy("start", "node").agg(F.min_by(F.struct("relevance", "dependency", "trust"), "edge_id").alias("e"))
    out = candidates.join(best, ["start", "node"], "left")
    return out.withColumn("score", node_score(F.col("quality"), F.col("e"), beta, gamma)).drop("e")


class Candidates:
    """Candidates (node, name, kind, score, tokens) by falling score, ties by node; those without score or tokens are never chosen."""

    BLOCK = 512

    def __init__(self, rows: list[tuple], tokens: np.ndarray):
        """``rows``, by falling score: (-score, node, name, kind, tokens)."""
        self.rows, self.tokens = rows, tokens
        self.least = np.minimum.reduceat(tokens, np.arange(0, len(rows), self.BLOCK)) if rows else tokens

    @classmethod
    def by_start(cls, f: pd.DataFrame) -> Iterator[tuple[object, Candidates]]:
        """Each start of a frame and its candidates; the frame is ordered once, not per start."""
        code, starts = pd.factorize(f["start"])
        rows, tokens, code = cls._ordered(f, code)
        bounds = np.searchsorted(code, np.arange(len(starts) + 1)).tolist()
        for k, start in enumerate(starts):
            part = slice(bounds[k], bounds[k + 1])
            yield start, cls(rows[part], tokens[part])

    @classmethod
    def of(cls, f: pd.DataFrame) -> Candidates:
        return cls(*cls._ordered(f, np.zeros(len(f), np.int64))[:2])

    @staticmethod
    def _ordered(f: pd.DataFrame, code: np.ndarray) -> tuple[list[tuple], np.ndarray, np.ndarray]:
        f = f.assign(_code=code).dropna(subset=["score", "tokens"]).sort_values(["_code", "score", "node"], ascending=[True, False, True])
        rows = list(zip((-f["score"]).tolist(), f["node"].tolist(), f["name"].tolist(), f["kind"].tolist(), f["tokens"].tolist()))
        return rows, f["tokens"].to_numpy(), f["_code"].to_numpy()

    def fitting(self, i: int, left: float) -> int:
        """First place from ``i`` on whose tokens are at most ``left``, or the number of rows; blocks without one are passed over."""
        if i < len(self.rows) and self.rows[i][4] <= left:
            return i
        while i < len(self.rows):
            block = i // self.BLOCK
            hit = np.flatnonzero(self.tokens[i : (block + 1) * self.BLOCK] <= left)
            if len(hit):
                return i + int(hit[0])
            later = np.flatnonzero(self.least[block + 1 :] <= left)
            if not len(later):
                break
            i = (block + 1 + int(later[0])) * self.BLOCK
        return len(self.rows)


def greedy(lists: list[Candidates], start: object, budget: int, lam: float, mu: float, most: int, default_budget: int) -> list[tuple]:
    """(start, node, place, gain) of the nodes chosen from the lists as if these were one; ``start`` itself is no candidate."""
    chosen: list[tuple] = []
    names: set[str] = set()
    spent = 0
    at = [0] * len(lists)
    while True:
        best = None
        for k, c in enumerate(lists):
            at[k] = c.fitting(at[k], budget - spent)
            if at[k] < len(c.rows) and (best is None or c.rows[at[k]][:2] < lists[best].rows[at[best]][:2]):
                best = k
        if best is None:
            break
        score, node, name, kind, tokens = lists[best].rows[at[best]]
        at[best] += 1
        if node == start:
            continue
        words = set(name.split())
        many = max(len(name.split()), 1)
        red = max([1.0 if n == name else len(w & words) / many for n, k, w in (c[4:] for c in chosen) if n == name or k == kind], default=0.0)
        gain = -score - lam * min(red, 1.0) - mu * tokens / default_budget
        if gain > 0 and name not in names:
            chosen.append((start, node, len(chosen) + 1, gain, name, kind, words))
            names.add(name)
            spent += tokens
        if len(chosen) >= most:
            break
    return [c[:4] for c in chosen]


CHOSEN = ["start", "node", "place", "gain"]


def greedy_select(scored: DataFrame, budget: int, lam: float = 0.6, mu: float = 0.2, most: int = 50, default_budget: int = 8000) -> DataFrame:
    """Per start, one pass by falling score (ties by node): skip what overflows the budget; gain = score - lam * redundancy - mu * cost.

    Redundancy is 1 for an equal name, else the share of the name's words in a selected name of the same kind. Input:
    start, node, name, kind, score, tokens. A start's candidates are its two-hop neighbourhood.
    """
    ship(scored.sparkSession)

    def pick(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(greedy([Candidates.of(f)], f["start"].iloc[0], budget, lam, mu, most, default_budget), columns=CHOSEN)

    kinds = dict(scored.dtypes)
    return scored.select("start", "node", "name", "kind", "score", "tokens").groupBy("start").applyInPandas(pick, f"start {kinds['start']}, node {kinds['node']}, place bigint, gain double")


def greedy_select_shared(own: DataFrame, same: DataFrame, shared: DataFrame, budget: int, lam: float = 0.6, mu: float = 0.2, most: int = 50, default_budget: int = 8000, size: int = 1000) -> DataFrame:
    """``greedy_select`` where starts of a class (start, same) have the candidates ``shared`` (same, node, ...) but themselves besides their ``own`` (start, node, ...).

    A class's candidates are ordered once for about ``size`` starts, not for each. Every start has some of its own.
    """
    ship(own.sparkSession)
    n = same.groupBy("same").agg(F.ceil(F.count(F.lit(1)) / size).alias("_n"))
    block = same.join(n, "same").select("start", "same", F.pmod(F.xxhash64("start"), "_n").alias("_i"))
    columns = ["node", "name", "kind", "score", "tokens"]
    left = own.select("start", *columns).join(block, "start")
    right = shared.select(F.col("same").alias("_same"), *columns).join(block.select(F.col("same").alias("_same"), F.col("_i").alias("_j")).distinct(), "_same")

    def pick(mine: pd.DataFrame, all_: pd.DataFrame) -> pd.DataFrame:
        common = Candidates.of(all_)
        return pd.DataFrame([c for s, own in Candidates.by_start(mine) for c in greedy([own, common], s, budget, lam, mu, most, default_budget)], columns=CHOSEN)

    kinds = dict(left.dtypes)
    # a stated number of partitions, as adaptive execution would put the blocks into a few tasks of unlike size
    left, right = left.repartition(partitions(own), "same", "_i"), right.repartition(partitions(own), "_same", "_j")
    return left.groupBy("same", "_i").cogroup(right.groupBy("_same", "_j")).applyInPandas(pick, f"start {kinds['start']}, node {kinds['node']}, place bigint, gain double")


def levels(stage: Stage, steps: DataFrame, needs: DataFrame) -> DataFrame:
    """(step, level): level 0 has no unmet needs, others one more than their deepest need; steps of a cycle have null.

    ``steps``: step; ``needs``: (step, need). Needs that are no steps are unmet for ever.
    """
    done = stage.keep(steps.join(needs.select("step").distinct(), "step", "left_anti").select("step", F.lit(0).cast("bigint").alias("level")), "level0")
    for k in itertools.count(1):
        open_ = steps.join(done, "step", "left_anti")
        blocked = needs.join(done.select(F.col("step").alias("need")), "need", "left_anti").select("step").distinct()
        ready = open_.join(blocked, "step", "left_anti").select("step", F.lit(k).cast("bigint").alias("level"))
        new = stage.keep(done.unionByName(ready), f"level{k}")
        if new.count() == done.count():
            return steps.join(new, "step", "left")
        done = new
