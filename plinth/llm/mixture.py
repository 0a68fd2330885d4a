"""Problem 9: mixing sources to target weights.

The budget, half of all tokens, is cut into equal blocks. Sainte-Laguë's method gives each block to the source with the
highest quotient weight / (2 * blocks so far + 1) among those that still have tokens within their
repeats; consecutive runs of blocks form the shards, so each shard has integer quotas near the target shares. A source
lays its documents in the order of a seeded hash, round after round, over its blocks: each copy belongs to the block, and so to the shard, in
which it begins. A source is short if the tokens that its repeats grant it are fewer than its share; the blocks it is denied go to others.
"""

from __future__ import annotations

import heapq
from collections import Counter
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.registry import query
from plinth.operators.ranking import bucketed_rank, hash_key
from plinth.runtime import Stage, spelling, table

BLOCKS, SHARDS = 10_000, 16


def sainte_lague(weights: dict[str, int], caps: dict[str, int], seats: int) -> list[str]:
    """The sources of the seats in the order they are given; equal quotients go by name, sources at their cap get no more."""
    heap = [(-Fraction(w), s, 0) for s, w in weights.items() if w > 0 and caps[s] > 0]
    heapq.heapify(heap)
    out = []
    while heap and len(out) < seats:
        _, s, n = heapq.heappop(heap)
        out.append(s)
        if n + 1 < caps[s]:
            heapq.heappush(heap, (-Fraction(weights[s], 2 * n + 3), s, n + 1))
    return out


def plan(spark, d: str) -> tuple[list[dict], list[str], int, DataFrame]:
    """(report rows, seats, block size, documents with spelt source and size). mix_target, a table that does not grow, bounds what is collected."""
    docs = table(spark, d, "documents").select("doc_id", spelling(F.col("source")).alias("key"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("size"))
    docs = Stage(spark, "p9").keep(docs, "sizes")
    targets = table(spark, d, "mix_target").select("source_name", F.coalesce("target_pct", F.lit(0)).alias("target_pct"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"), spelling(F.col("source_name")).alias("key")).filter("source_name is not null").dropDuplicates(["source_name"])
    sums = docs.filter("key is not null").groupBy("key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("documents"))
    rows = [r.asDict() for r in targets.join(sums, "key", "left").fillna(0, ["size", "documents"]).orderBy("source_name").collect()]
    total = docs.agg(F.sum("size")).first()[0] or 0
    budget = total // 2
    block = max(1, -(-budget // BLOCKS))
    # the last, broken block of a source that is used up counts as one
    caps = {r["source_name"]: -(-r["size"] * r["max_repeats"] // block) for r in rows}
    weights, number = {r["source_name"]: r["target_pct"] for r in rows}, -(-budget // block) if budget else 0
    entitled = Counter(sainte_lague(weights, dict.fromkeys(weights, number), number))
    seats = sainte_lague(weights, caps, number)
    got = Counter(seats)
    for r in rows:
        s, most = r["source_name"], r["size"] * r["max_repeats"]
        # hundredths of tokens: what the target asks for, and what of it the source can give
        wanted, granted = r["target_pct"] * budget, min(r["target_pct"] * budget, 100 * most)
        r |= {"blocks": got[s], "denied": max(0, entitled[s] - caps[s]), "quota": min(most, got[s] * block), "short": granted < wanted, "budget": budget}
    return rows, seats, block, docs


@query(
    "p9_found",
    """WITH s AS (SELECT replace(lower(trim(source)), '-', '_') AS k, sum(strlen(text)) AS n FROM documents GROUP BY 1), t AS (SELECT sum(strlen(text)) AS n FROM documents)
SELECT source_name FROM mix_target LEFT JOIN s ON s.k = replace(lower(trim(source_name)), '-', '_') WHERE 100 * coalesce(s.n, 0) * max_repeats < target_pct * ((SELECT n FROM t) // 2)""",
)
def p9_found(spark, d):
    rows = plan(spark, d)[0]
    return spark.createDataFrame([(r["source_name"],) for r in rows if r["short"]], "source_name string")


def mix(spark, rows: list[dict], seats: list[str], block: int, docs: DataFrame, seed: int = 42) -> DataFrame:
    """(source_name, doc_id, copy_no, size, shard), one row per copy of each chosen document."""
    per = max(1, -(-len(seats) // SHARDS))
    nth: Counter = Counter()
    where = []
    for i, s in enumerate(seats):
        where.append((s, nth[s], i // per))
        nth[s] += 1
    quota = spark.createDataFrame([(r["source_name"], r["key"], r["quota"], r["size"]) for r in rows if r["quota"] > 0], "source_name string, key string, quota bigint, whole bigint")
    ranked = bucketed_rank(docs.join(F.broadcast(quota.select("key").distinct()), "key", "left_semi").withColumn("h", hash_key(seed, "doc_id")), ["key"], "h", ["doc_id"], F.col("size"))
    # where each copy begins: whole rounds before it, then the documents before it; at most max_repeats copies
    begins = F.col("copy_no") * F.col("whole") + F.col("size_before")
    copies = ranked.join(F.broadcast(quota), "key").withColumn("copy_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(quota - 1) div whole"))))
    copies = copies.withColumn("begins", begins).filter("begins < quota").withColumn("seat", F.expr(f"begins div {block}"))
    seat = spark.createDataFrame(where, "source_name string, seat bigint, shard bigint")  # at most BLOCKS rows
    return copies.join(F.broadcast(seat), ["source_name", "seat"]).select("source_name", "doc_id", F.col("copy_no") + 1, "size", "shard").toDF("source_name", "doc_id", "copy_no", "size", "shard")


@query("p9_mix")
def p9_mix(spark, d):
    """Each copy of each chosen document with its shard."""
    return mix(spark, *plan(spark, d))


@query("p9_shares")
def p9_shares(spark, d):
    """Each source's planned and denied blocks, quota, and the share that its chosen copies have in the mix."""
    made = plan(spark, d)
    kinds = "source_name string, target_pct int, max_repeats int, documents bigint, size bigint, blocks bigint, denied bigint, quota bigint, short boolean, budget bigint"
    head = spark.createDataFrame([tuple(r[c.split()[0]] for c in kinds.split(", ")) for r in made[0]], kinds)
    got = mix(spark, *made).groupBy("source_name").agg(F.sum("size").alias("mixed"))
    out = head.join(got, "source_name", "left").fillna(0, ["mixed"])
    whole = out.agg(F.sum("mixed").alias("whole"))
    return out.crossJoin(F.broadcast(whole)).select("*", F.expr("try_divide(100 * mixed, whole)").alias("actual_pct")).drop("whole")  # whole is one row
