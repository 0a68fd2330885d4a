"""Problem 1: splits that keep related records together.

Records and entities (leakage groups and sources) form a bipartite graph. Minimum labels spread over
it: an entity takes the least label of its records, a record the least of its entities, with the
label's own label taken as a short cut, so that a chain of n links settles in about log n rounds. A record's
entities all stand in its row, so the record's half step needs no shuffle: what is kept between
rounds is one row for each distinct pair (entity, least entity of one of its records).

Groups then get a split by largest shortage, in strata, see ``assign``: groups of like size and strata form one class, whose members are dealt out together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.registry import query
from plinth.operators.components import connected
from plinth.operators.ranking import bucketed_rank, hash_key
from plinth.runtime import Stage, table

#: Values that link nothing, after trimming and lower-casing.
PLACEHOLDERS = ("", "unknown", "none", "n/a")
BLANKS = r"(?U)^[\s\u0000]+|[\s\u0000]+$"


def plain(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, BLANKS, ""))


def source_name(c: Column) -> Column:
    """A source's one name: file name without folder and page mark, lower case, trimmed."""
    c = F.regexp_replace(plain(c), r"\\", "/")
    c = F.regexp_replace(c, r"#.*$", "")
    return plain(F.regexp_replace(c, r"^.*/", ""))


def split_name(c: Column) -> Column:
    """``train``, ``validation`` (also for ``val``), ``test``; other values and null are null."""
    c = plain(c)
    return F.when(c == "val", "validation").when(c.isin("train", "validation", "test"), c)


def entities(group: Column, refs: Column) -> Column:
    """Distinct 64-bit ids of a record's linking entities; placeholders, blanks and nulls link nothing."""
    g = plain(group)
    names = F.transform(F.coalesce(refs, F.array().cast("array<string>")), lambda r: F.when(~plain(r).isin(*PLACEHOLDERS), source_name(r)))
    keys = F.concat(F.array(F.when(~g.isin(*PLACEHOLDERS), F.concat(F.lit("g:"), g))), F.transform(names, lambda r: F.when(~r.isin(*PLACEHOLDERS), F.concat(F.lit("s:"), r))))
    return F.array_distinct(F.transform(F.array_compact(keys), lambda k: F.xxhash64(k)))


def components(stage: Stage, links: DataFrame) -> DataFrame:
    """(ent, label): the least entity that is linked with ``ent``; links: (ent, top)."""
    return connected(stage, links, "ent", "top").withColumnRenamed("node", "ent")


def linked_records(records: DataFrame, key: str, group: str, refs: str, stage: Stage, carry: dict[str, Column]) -> DataFrame:
    """(key, ``set_id``, *carry): each distinct record with the linked set it is in.

    Redelivered rows (same key) are one record and link all entities of all their rows. Records
    without any entity are sets of their own, with ``set_id`` null.
    """
    rows = records.filter(F.col(key).isNotNull()).select(F.col(key).alias("rec"), entities(F.col(group), F.col(refs)).alias("ents"), *[c.alias(n) for n, c in carry.items()])
    rows = stage.keep(rows.select("rec", "ents", F.array_min("ents").alias("top"), *carry), "rows")
    links = rows.filter(F.size("ents") > 1).select(F.explode("ents").alias("ent"), "top").filter("ent <> top")
    # deliveries of one record that name different entities link these, too
    again = rows.filter(F.col("top").isNotNull()).groupBy("rec").agg(F.min("top").alias("ent"), F.max("top").alias("top")).filter("ent <> top").select("ent", "top")
    labels = components(stage, links.unionByName(again).distinct())
    placed = rows.join(labels.select(F.col("ent").alias("top"), "label"), "top", "left")
    return placed.select("rec", F.coalesce("label", "top").alias("set_id"), *carry)


def broken_sets(spark, d: str) -> DataFrame:
    """Records of linked sets whose records have two or more different splits."""
    stage = Stage(spark, "p1")
    sft = table(spark, d, "sft_sample").select("sample_id", "leakage_group_id", "source_refs", "split")
    placed = stage.keep(linked_records(sft, "sample_id", "leakage_group_id", "source_refs", stage, {"split": split_name(F.col("split"))}), "placed")
    bad = placed.filter("set_id is not null and split is not null").groupBy("set_id").agg(F.min("split").alias("a"), F.max("split").alias("b")).filter("a <> b").select("set_id")
    # a record whose deliveries disagree breaks its set, too
    lone = placed.filter("set_id is null and split is not null").groupBy("rec").agg(F.min("split").alias("a"), F.max("split").alias("b")).filter("a <> b").select("rec")
    return placed.join(bad, "set_id", "left_semi").select(F.col("rec").alias("sample_id")).unionByName(lone.select(F.col("rec").alias("sample_id"))).distinct()


def deal(counts: tuple[int, ...], many: int, totals: tuple[int, ...], shares: list[float], have: list[list[float]], pieces: int) -> list[int]:
    """How many of ``many`` equal groups each split gets, dealt in shrinking steps, ``pieces`` for each split and size, to where the squared deviation of sizes and strata from their targets rises least."""
    out = [0] * len(shares)
    left, pieces = many, pieces * len(shares)
    while left:
        n = max(1, left // pieces) if left > pieces else 1

        def worse(i: int, n: int = n) -> float:
            return sum(((h + n * c - t * shares[i]) ** 2 - (h - t * shares[i]) ** 2) / max(t, 1) / max(shares[i], 1e-9) for h, c, t in zip(have[i], counts, totals, strict=True))

        i = min(range(len(shares)), key=lambda j: (worse(j), j))
        have[i] = [h + n * c for h, c in zip(have[i], counts, strict=True)]
        out[i] += n
        left -= n
    return out


def assign(stage: Stage, groups: DataFrame, targets: list[tuple[str, int]], strata: list[str], seed: int = 42, digits: int = 2, pieces: int = 32) -> DataFrame:
    """(set_id, new_split) of groups (set_id, n, *strata counts) so that shares and strata come near the targets.

    Groups whose counts agree in their leading ``digits`` binary places form a class; there are no more classes than (places x 2^digits) for each count, however many
    groups. Classes are placed on the driver, those of the largest groups first: their members are dealt to the splits where they
    least raise the squared deviation of split sizes and stratum counts from their targets. Which members go where is the rank of a
    seeded hash within the class. All groups go this one way, whatever their number and sizes.
    """
    places = lambda c: F.when(F.col(c) > 0, F.floor(F.log2(F.col(c).cast("double")) * (1 << (digits - 1)))).otherwise(-1).cast("int")
    kind = F.array(*[places(c) for c in ("n", *strata)])
    rows = stage.keep(groups.withColumn("kind", kind).withColumn("key", hash_key(seed, "set_id")), "kinds")
    sums = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in strata]).collect()
    names, shares = [t[0] for t in targets], [t[1] / max(1, sum(t[1] for t in targets)) for t in targets]
    totals = tuple(sum(r[c] or 0 for r in sums) for c in ("n", *strata))
    have = [[0.0] * len(totals) for _ in names]
    where = []
    for r in sorted(sums, key=lambda r: (-r["n"] / r["many"], list(r["kind"]))):
        mean = tuple((r[c] or 0) / r["many"] for c in ("n", *strata))
        upto = 0
        for name, n in zip(names, deal(mean, r["many"], totals, shares, have, pieces), strict=True):
            if n:
                where.append((list(r["kind"]), upto, upto + n, name))
                upto += n
    spark = groups.sparkSession
    spans = spark.createDataFrame(where, "kind array<int>, above bigint, upto bigint, new_split string")
    ranked = bucketed_rank(rows.select("set_id", "kind", "key"), ["kind"], "key", ["set_id"])
    return ranked.join(F.broadcast(spans), "kind").filter("rank_no > above and rank_no <= upto").select("set_id", "new_split")


@query("p1_found")
def p1_found(spark, d):
    return broken_sets(spark, d)


@query("p1_splits")
def p1_splits(spark, d):
    """(sample_id, set_id, present, new_split) of every record; linked records share ``new_split``."""
    stage = Stage(spark, "p1s")
    sft = table(spark, d, "sft_sample").select("sample_id", "leakage_group_id", "source_refs", "split", "difficulty")
    level = plain(F.col("difficulty"))
    placed = linked_records(sft, "sample_id", "leakage_group_id", "source_refs", stage, {"split": split_name(F.col("split")), "level": level})
    # records in no set are sets of their own
    placed = placed.groupBy("rec").agg(F.min("set_id").alias("set_id"), F.min("split").alias("present"), F.min("level").alias("level"))
    placed = stage.keep(placed.withColumn("set_id", F.coalesce("set_id", F.xxhash64(F.lit("r:"), "rec"))), "records")
    levels = ["easy", "medium", "hard", "expert"]
    groups = stage.keep(placed.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("level") == v).alias(v) for v in levels]), "groups")
    # split_target bounds what is collected: a split is a name and a share
    targets = [(r["split_name"], r["target_pct"]) for r in table(spark, d, "split_target").filter("split_name is not null and target_pct > 0").orderBy(F.desc("target_pct"), "split_name").collect()]
    where = assign(stage, groups, targets, levels)
    return placed.join(where, "set_id").select(F.col("rec").alias("sample_id"), "set_id", "present", "new_split")


@query("p1_shares")
def p1_shares(spark, d):
    """Share of each new split against its target, in all and by difficulty."""
    out = p1_splits(spark, d).groupBy("new_split").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("set_id").alias("sets"))
    target = table(spark, d, "split_target").select(F.col("split_name").alias("new_split"), "target_pct")
    return target.join(out, "new_split", "left").select("new_split", "target_pct", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("sets", F.lit(0)).alias("sets"), (100 * F.col("records") / F.sum("records").over(Window.partitionBy())).alias("actual_pct"))
