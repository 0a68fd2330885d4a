"""Scores of several leniencies, gates, primaries, searches, and further audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F


from plinth.functions import scoring as S
from plinth.functions import text as T
from plinth.operators import dedup, exams, sampling, similarity
from plinth.operators.ranking import range_rank
from plinth.plans.registry import CHUNK, EVAL, SFT, query
from plinth.plans.texts import chunks, results, samples
from plinth.runtime import Stage, table


def items(spark, d):
    return table(spark, d, "benchmark_item")


def answered(spark, d):
    return results(spark, d, "model_name", "benchmark_id", "raw_response", "gold_answer").select("model_name", "benchmark_id", "raw_response", "gold_answer").join(items(spark, d).select("benchmark_id", "options"), "benchmark_id")


@query("strict_scores")
def strict_scores(spark, d):
    """Letter, normalised and keyword scores of every answer."""
    form = F.when(F.size("options") >= 2, "multiple_choice_letter").otherwise("open_ended")
    return answered(spark, d).select("model_name", "benchmark_id", S.strict_score(F.col("raw_response"), F.col("gold_answer"), form, F.col("options")).alias("s")).select("model_name", "benchmark_id", "s.*")


@query("letter_scores", f"""SELECT r.model_name, count(*) AS n, count(*) FILTER (regexp_extract(upper(r.raw_response), '([A-H])', 1) = regexp_extract(upper(r.gold_answer), '([A-H])', 1) AND regexp_matches(upper(r.raw_response), '[A-H]') AND r.gold_answer <> '') AS letters
FROM {EVAL} r JOIN benchmark_item b USING (benchmark_id) WHERE len(b.options) >= 2 GROUP BY r.model_name""")
def letter_scores(spark, d):
    multi = items(spark, d).filter(F.size("options") >= 2).select("benchmark_id")
    return strict_scores(spark, d).join(multi, "benchmark_id", "left_semi").groupBy("model_name").agg(F.count(F.lit(1)).alias("n"), F.count_if("letter_correct").alias("letters"))


@query("score_agreement")
def score_agreement(spark, d):
    """Per model, answers that count under the strict and under the lenient score."""
    a = answered(spark, d)
    form = F.when(F.size("options") >= 2, "multiple_choice_letter").otherwise("open_ended")
    s = a.select("model_name", S.strict_score(F.col("raw_response"), F.col("gold_answer"), form, F.col("options"))["strict_correct"].alias("strict"), S.lenient_score(F.col("raw_response"), F.col("gold_answer"), F.size("options") >= 2).alias("lenient"))
    return s.groupBy("model_name").agg(F.count_if("strict").alias("strict"), F.count_if("lenient").alias("lenient"), F.count_if(F.col("strict") & ~F.col("lenient")).alias("only_strict"))


@query("keyword_overlap_checks", f"SELECT model_name, benchmark_id, contains(raw_response, gold_answer) AS inside FROM {EVAL} WHERE raw_response IS NOT NULL AND gold_answer <> ''")
def keyword_overlap_checks(spark, d):
    return results(spark, d, "model_name", "benchmark_id", "raw_response", "gold_answer").filter("raw_response is not null and gold_answer <> ''").select("model_name", "benchmark_id", F.col("raw_response").contains(F.col("gold_answer")).alias("inside"))


_FULL = "trim(coalesce(array_to_string(evidence[1:5], ' '), '') || chr(10) || coalesce(explanation, '') || chr(10) || coalesce(array_to_string(required_knowledge, ', '), ''), ' ' || chr(10) || chr(9) || chr(13))"


@query("context_costs", f"""WITH f AS (SELECT benchmark_id, length({_FULL}) // 4 AS n FROM benchmark_item) SELECT benchmark_id, s.system AS system, s.tokens AS context_tokens FROM (SELECT benchmark_id, unnest([{{'system': 'direct', 'tokens': CAST(0 AS BIGINT)}}, {{'system': 'react', 'tokens': CAST(n AS BIGINT)}}, {{'system': 'plan_execute', 'tokens': CAST(n // 2 AS BIGINT)}}, {{'system': 'broadcast', 'tokens': CAST(n * 5 AS BIGINT)}}, {{'system': 'static', 'tokens': CAST(n // 3 AS BIGINT)}}, {{'system': 'selected', 'tokens': CAST(floor(CAST(n AS DOUBLE) * CAST(0.37 AS DOUBLE)) AS BIGINT)}}]) AS s FROM f)""")
def context_costs(spark, d):
    part = lambda c, sep, n=1_000_000: F.coalesce(F.array_join(F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, n), sep), F.lit(""))
    full = F.regexp_replace(F.concat(part("evidence", " ", 5), F.lit("\n"), F.coalesce("explanation", F.lit("")), F.lit("\n"), part("required_knowledge", ", ")), r"^[ \n\t\r]+|[ \n\t\r]+$", "")
    return items(spark, d).select("benchmark_id", F.explode(S.context_costs(full)).alias("s")).select("benchmark_id", "s.system", "s.context_tokens")


@query("expected_forms", "SELECT benchmark_id, CASE WHEN len(options) >= 2 THEN 'multiple_choice_letter' WHEN task_type LIKE 'exam%' THEN 'short_answer' ELSE 'open_ended' END AS form, row_number() OVER (PARTITION BY task_type ORDER BY ordinal) AS place FROM benchmark_item")
def expected_forms(spark, d):
    f = F.when(F.size("options") >= 2, "multiple_choice_letter").when(F.col("task_type").startswith("exam"), "short_answer").otherwise("open_ended")
    rows = items(spark, d).select("benchmark_id", "task_type", "ordinal", f.alias("form"))
    return range_rank(Stage(spark, "forms"), rows, ["task_type"], [F.col("ordinal")], ["benchmark_id"]).select("benchmark_id", "form", F.col("rank_no").alias("place"))


@query("exam_survivors")
def exam_survivors(spark, d):
    """One question per normalised text: the first, unless a later one's options differ too much from the best so far."""
    b = items(spark, d).filter("question is not null").select("benchmark_id", "ordinal", T.exam_text(F.col("question")).alias("text"), T.exam_options(F.col("options")).alias("opts"))
    return exams.survivors(b, "benchmark_id", "ordinal", "text", "opts")


@query("duplicate_primaries")
def duplicate_primaries(spark, d):
    """Groups of vectors with near-equal sign codes, and the row that stands for each: largest norm, then least id."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding", similarity.sign_code(F.col("embedding")).alias("code"))
    labels = dedup.code_groups(Stage(spark, "primaries"), v, "vec_id", "code", 16).distinct()
    rows = v.join(labels, "vec_id").select("vec_id", F.col("label").alias("group_id"), similarity.dot(F.col("embedding"), F.col("embedding")).alias("norm"))
    best = rows.groupBy("group_id").agg(F.max_by("vec_id", F.struct("norm", F.expr("-vec_id"))).alias("primary_id"), F.count(F.lit(1)).alias("size"))
    return rows.join(best, "group_id").select("vec_id", "group_id", "primary_id", "size", F.when(F.col("vec_id") == F.col("primary_id"), "unique").otherwise("duplicate").alias("status"))


@query("keyword_search", "SELECT doc_id, k / 3 AS score FROM (SELECT doc_id, len(list_intersect(list_distinct(string_split(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' ')), ['the', 'resin', 'fracture'])) AS k FROM documents WHERE text IS NOT NULL) WHERE k > 0 ORDER BY k DESC, doc_id LIMIT 20")
def keyword_search(spark, d):
    """Twenty documents with most words of a query."""
    words = F.split(F.regexp_replace(F.lower("text"), r"\s+", " "), " ")
    hits = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in ("the", "resin", "fracture")])))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", (hits / 3).alias("score")).filter("score > 0").orderBy(F.desc("score"), "doc_id").limit(20)


@query("prefix_subsets", f"SELECT size, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY sample_id) AS k FROM {SFT}), (SELECT unnest([100, 500, 1000]) AS size) WHERE k <= size GROUP BY size")
def prefix_subsets(spark, d):
    """Nested prefixes of 100, 500 and 1000 rows: each row is exploded to the sizes that hold it."""
    r = sampling.ordered_rank(Stage(spark, "prefix"), samples(spark, d, "sample_id").select("sample_id"), ["sample_id"], "k").filter("k <= 1000")
    return r.select("sample_id", F.explode(F.filter(F.array(F.lit(100), F.lit(500), F.lit(1000)), lambda s: F.col("k") <= s)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n"))


@query("quality_gates", f"SELECT count(*) AS n, count(*) FILTER (quality_score.verdict = 'passed') / count(*) AS pass_rate, count(*) FILTER (quality_score.verdict = 'passed') / count(*) >= 0.8 AS gate FROM {CHUNK} WHERE quality_score IS NOT NULL")
def quality_gates(spark, d):
    c = chunks(spark, d, "quality_score").filter("quality_score is not null")
    rate = F.count_if(F.col("quality_score.verdict") == "passed") / F.count(F.lit(1))
    return c.agg(F.count(F.lit(1)).alias("n"), rate.alias("pass_rate"), (rate >= 0.8).alias("gate"))


@query("repair_candidates", f"SELECT chunk_id, CASE WHEN quality_score IS NULL THEN 'keep' WHEN quality_score.verdict = 'failed' THEN 'drop' WHEN quality_score.clarity < 0.5 OR quality_score.completeness < 0.5 THEN 'repair' ELSE 'keep' END AS fate FROM {CHUNK}")
def repair_candidates(spark, d):
    q = lambda c: F.col(f"quality_score.{c}")
    fate = F.when(F.col("quality_score").isNull(), "keep").when(q("verdict") == "failed", "drop").when((q("clarity") < 0.5) | (q("completeness") < 0.5), "repair").otherwise("keep")
    return chunks(spark, d, "chunk_id", "quality_score").select("chunk_id", fate.alias("fate"))


@query("repair_counts", f"SELECT o.original, count(*) AS n FROM (SELECT unnest(ocr_repairs) AS m, 1 AS one FROM {CHUNK}) x, (SELECT 1 AS one) y, LATERAL (SELECT element_at(x.m, 'original')[1] AS original) o WHERE o.original IS NOT NULL GROUP BY 1")
def repair_counts(spark, d):
    return chunks(spark, d, "ocr_repairs").select(F.explode("ocr_repairs").alias("m")).select(F.try_element_at("m", F.lit("original")).alias("original")).filter("original is not null").groupBy("original").agg(F.count(F.lit(1)).alias("n"))


@query("noise_type_counts", f"SELECT kind, count(*) AS n FROM (SELECT unnest(removed_noise_types) AS kind FROM {CHUNK}) GROUP BY kind")
def noise_type_counts(spark, d):
    return chunks(spark, d, "removed_noise_types").select(F.explode("removed_noise_types").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("distractors")
def distractors(spark, d):
    """Three items of the same task type to go with each item: the next three in a seeded order of the type, in a ring."""
    b = items(spark, d).filter("task_type is not null").select("benchmark_id", "task_type", F.xxhash64(F.lit(42), "benchmark_id").alias("h"))
    from plinth.operators.ranking import bucketed_rank

    r = bucketed_rank(b, ["task_type"], "h", ["benchmark_id"], buckets=64).select("benchmark_id", "task_type", "rank_no")
    size = r.groupBy("task_type").agg(F.max("rank_no").alias("m"))
    want = r.join(size, "task_type").select("benchmark_id", "task_type", F.explode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: (F.col("rank_no") - 1 + k) % F.col("m") + 1)).alias("rank_no"))
    return want.join(r.withColumnRenamed("benchmark_id", "distractor_id"), ["task_type", "rank_no"]).filter("benchmark_id <> distractor_id").select("benchmark_id", "distractor_id").distinct()


@query("parsed_actions", "SELECT event_id, event_type AS tool, 'user ' || user_id AS argument FROM events")
def parsed_actions(spark, d):
    """Tool and argument of action lines written from events."""
    line = F.concat(F.lit("Thought: next\nAction: ["), "event_type", F.lit("] [user "), "user_id", F.lit("]"))
    return table(spark, d, "events").select("event_id", S.action(line).alias("a")).select("event_id", "a.*")


@query("tfidf_matches")
def tfidf_matches(spark, d):
    """Best match by TF-IDF of character 4-grams, 0.85 or more, of every title whose id is divisible by 100, among all."""
    docs = table(spark, d, "documents").filter("title is not null").select("doc_id", T.normalize_text(F.col("title")).alias("title"))
    return similarity.tfidf_best(docs, docs.filter("doc_id % 100 = 0"), "doc_id", "title", 0.85)


@query("flattened_evidence", f"SELECT sample_id, coalesce(array_to_string(evidence, chr(10)), '') AS evidence FROM {SFT} WHERE evidence IS NOT NULL")
def flattened_evidence(spark, d):
    return samples(spark, d, "sample_id", "evidence").filter("evidence is not null").select("sample_id", S.flat_evidence(F.to_json("evidence")).alias("evidence"))


@query("throughput", "SELECT user_id, event_id, CASE WHEN date_diff('microsecond', lag(ts, 9) OVER w, ts) > 0 THEN round(9 / (date_diff('microsecond', lag(ts, 9) OVER w, ts) / 1000000), 9) END AS per_second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def throughput(spark, d):
    """Events a second over each user's last ten events; null for fewer."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp")), 9).over(w)
    return table(spark, d, "events").select("user_id", "event_id", F.when(us > 0, F.round(9 / (us / 1000000), 9)).alias("per_second"))


@query("answer_lengths_by_verdict", f"SELECT CASE WHEN is_correct THEN 'right' WHEN NOT is_correct THEN 'wrong' ELSE 'none' END AS verdict, count(*) AS n, CAST(sum(length(raw_response)) AS BIGINT) AS chars FROM {EVAL} GROUP BY 1")
def answer_lengths_by_verdict(spark, d):
    return results(spark, d, "raw_response", "is_correct").groupBy(F.when(F.col("is_correct"), "right").when(~F.col("is_correct"), "wrong").otherwise("none").alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("raw_response").cast("bigint")).alias("chars"))


