"""Problem 5: a sample whose categories have target shares.

The target of a category is the larger of its minimum and its share of the sample. Quotas go down a
tree (field, family, category): what a category cannot fill is offered first to its siblings of one family,
then to cousins of the other families, each in proportion to its own target and as far as it has records.
Records are drawn by the rank of a seeded hash within their category.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.registry import query
from plinth.operators.ranking import bucketed_rank, hash_key
from plinth.runtime import Stage, spelling, table

FIELDS = ("source_type", "task_type", "difficulty")
#: Families of the categories of these tables, the default of a parameter; a category that is not named is a family of its own.
FAMILIES = {
    "source_type": {"written": ["text", "knowledge_unit"], "tested": ["exam", "benchmark_candidate"], "agents": ["agent_task", "dtcg_trace", "error_repair"]},
    "task_type": {"answers": ["qa", "explanation", "comparison"], "reasoning": ["process_reasoning", "error_diagnosis", "constraint_satisfaction"], "exams": ["exam_single_choice", "exam_true_false", "exam_short_answer"], "transforms": ["information_extraction", "translation"]},
    "difficulty": {"usual": ["easy", "medium"], "demanding": ["hard", "expert"]},
}


def pour(amount: int, rooms: list[tuple[str, int, int]]) -> dict[str, int]:
    """Divides ``amount`` over (name, weight, room) by weight within room: largest remainders, ties by name."""
    got = {name: 0 for name, _, _ in rooms}
    while amount > 0:
        open_ = [(n, w, r - got[n]) for n, w, r in rooms if r > got[n] and w > 0]
        total = sum(w for _, w, _ in open_)
        if not open_:
            break
        part = {n: min(r, amount * w // total) for n, w, r in open_}
        if not any(part.values()):
            for n, w, _ in sorted(open_, key=lambda x: (-(amount * x[1] % total), x[0]))[:amount]:
                part[n] = 1
        for n, k in part.items():
            got[n] += k
        amount -= sum(part.values())
    return got


def allocate(size: int, targets: list[dict], families: dict[str, list[str]]) -> list[dict]:
    """One row per target of one field: wanted, what the category grants of it itself (own), its quota, and what of that came from others.

    ``targets``: category, target_pct, min_records, available. Minima and shares may add up to more
    than ``size``; the sample is then as much larger.
    """
    family = {c: f for f, cs in families.items() for c in cs}
    rows = [t | {"family": family.get(t["category"], t["category"]), "wanted": max(t["min_records"], t["target_pct"] * size // 100)} for t in targets]
    for r in rows:
        r["own"] = r["quota"] = min(r["wanted"], r["available"])
    names = sorted({r["family"] for r in rows})
    for level in ("siblings", "cousins"):
        for f in names if level == "siblings" else [None]:
            own = [r for r in rows if f is None or r["family"] == f]
            short = sum(r["wanted"] for r in own) - sum(r["quota"] for r in own)
            more = pour(max(0, short), [(r["category"], max(1, r["wanted"]), r["available"] - r["quota"]) for r in own])
            for r in own:
                r["quota"] += more[r["category"]]
                r[f"from_{level}"] = more[r["category"]]
    return rows


def report(spark, d: str, families: dict = FAMILIES) -> tuple[DataFrame, DataFrame]:
    """(allocation, members): quota of every target, and each record's (field, category, id). sample_target, a table that does not grow, bounds what is collected."""
    sft = table(spark, d, "sft_sample").filter("sample_id is not null").select("sample_id", *[spelling(F.col(c)).alias(c) for c in FIELDS])
    # a record that comes again counts once
    members = Stage(spark, "p5").keep(sft.groupBy("sample_id").agg(*[F.min(c).alias(c) for c in FIELDS]), "records")
    long = members.select("sample_id", F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in FIELDS]), F.array(*FIELDS))).alias("field_name", "category"))
    counts = long.groupBy("field_name", "category").agg(F.count(F.lit(1)).alias("available"))
    targets = table(spark, d, "sample_target").select("field_name", "category", "target_pct", "min_records").dropDuplicates(["field_name", "category"])
    known = targets.withColumn("key", spelling(F.col("category"))).join(counts.withColumnRenamed("category", "key"), ["field_name", "key"], "left").fillna(0, ["available", "target_pct", "min_records"]).collect()
    size = members.count() // 5
    rows = []
    for field in sorted({r["field_name"] for r in known if r["field_name"] is not None}):
        part = [r.asDict() for r in known if r["field_name"] == field and r["category"] is not None]
        rows += [r for r in allocate(size, part, families.get(field, {}))]
    schema = "field_name string, category string, key string, family string, target_pct int, min_records int, available bigint, wanted bigint, own bigint, quota bigint, from_siblings bigint, from_cousins bigint"
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema), long


SHORT_SQL = """WITH r AS (SELECT sample_id, min(replace(lower(trim(source_type)), '-', '_')) AS source_type, min(replace(lower(trim(task_type)), '-', '_')) AS task_type,
min(replace(lower(trim(difficulty)), '-', '_')) AS difficulty FROM sft_sample WHERE sample_id IS NOT NULL GROUP BY sample_id),
l AS (SELECT 'source_type' AS field_name, source_type AS k FROM r UNION ALL SELECT 'task_type', task_type FROM r UNION ALL SELECT 'difficulty', difficulty FROM r),
c AS (SELECT field_name, k, count(*) AS n FROM l GROUP BY ALL)
SELECT t.field_name, t.category FROM sample_target t LEFT JOIN c ON c.field_name = t.field_name AND c.k = replace(lower(trim(t.category)), '-', '_')
WHERE coalesce(c.n, 0) < greatest(t.min_records, t.target_pct * ((SELECT count(*) FROM r) // 5) // 100)"""


@query("p5_found", SHORT_SQL)
def p5_found(spark, d):
    return report(spark, d)[0].filter("own < wanted").select("field_name", "category")


@query("p5_report")
def p5_report(spark, d):
    return report(spark, d)[0].drop("key").withColumn("met", F.expr("quota >= wanted"))


@query("p5_sample")
def p5_sample(spark, d, seed: int = 42):
    """(field_name, category, sample_id): the drawn records, category as spelt in the target."""
    quota, long = report(spark, d)
    ranked = bucketed_rank(long.filter("category is not null").withColumn("key", hash_key(seed, "field_name", "sample_id")), ["field_name", "category"], "key", ["sample_id"])
    q = F.broadcast(quota.select("field_name", F.col("category").alias("as_named"), F.col("key").alias("category"), "quota"))
    return ranked.join(q, ["field_name", "category"]).filter("rank_no <= quota").select("field_name", F.col("as_named").alias("category"), "sample_id")
