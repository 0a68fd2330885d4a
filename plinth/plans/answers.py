"""Answers and their scores: parsing, metrics, summaries, paired tests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plinth.functions import answers as A

from plinth.operators import statistics
from plinth.plans.registry import EVAL, SFT, WS, query, strip
from plinth.plans.texts import results, samples
from plinth.runtime import Stage, table


def items(spark, d):
    return table(spark, d, "benchmark_item")


_LETTER = f"""CASE WHEN regexp_full_match({strip('%s')}, '[A-Ha-h]') THEN upper({strip('%s')}) WHEN regexp_matches({strip('%s')}, '答案[是为：:]\\s*[A-H]') THEN regexp_extract({strip('%s')}, '答案[是为：:]\\s*([A-H])', 1)
WHEN regexp_matches({strip('%s')}, '^[A-H][.、．){WS[1:-1]}]') THEN substr({strip('%s')}, 1, 1) WHEN regexp_matches({strip('%s')}, '[A-Ha-h]') THEN upper(regexp_extract({strip('%s')}, '([A-Ha-h])', 1)) ELSE {strip('%s')} END"""


def letter(c: str) -> str:
    return _LETTER.replace("%s", c)


@query("choice_letters", f"SELECT model_name, benchmark_id, {letter('raw_response')} AS letter FROM {EVAL} WHERE raw_response IS NOT NULL AND task_type = 'exam_single_choice'")
def choice_letters(spark, d):
    return results(spark, d, "model_name", "benchmark_id", "task_type", "raw_response").filter("raw_response is not null and task_type = 'exam_single_choice'").select("model_name", "benchmark_id", A.choice_letter(F.col("raw_response")).alias("letter"))


_TF = """CASE WHEN s IN ('true', 'correct', '对', '正确', '是', '√', '✓') THEN '正确' WHEN s IN ('false', 'incorrect', '错', '错误', '否', '×', '✗') THEN '错误' WHEN contains(s, '正确') THEN '正确' WHEN contains(s, '错误') THEN '错误' ELSE s END"""


@query("truth_values", f"SELECT sample_id, {_TF} AS verdict FROM (SELECT sample_id, lower({strip('output')}) AS s FROM {SFT} WHERE output IS NOT NULL AND task_type = 'exam_true_false')")
def truth_values(spark, d):
    return samples(spark, d, "sample_id", "task_type", "output").filter("output is not null and task_type = 'exam_true_false'").select("sample_id", A.true_or_false(F.col("output")).alias("verdict"))


def number(c: str) -> str:
    s = strip(c)
    return f"""coalesce(CASE WHEN regexp_matches({s}, '^[-+]?(\\d+\\.?\\d*|\\.\\d+)([eE][-+]?\\d+)?$') THEN try_cast({s} AS DOUBLE) END, try_cast(nullif(regexp_extract({s}, '([-+]?\\d*\\.?\\d+[eE][-+]?\\d+)', 1), '') AS DOUBLE),
try_cast(nullif(regexp_extract({s}, '([-+]?\\d*\\.?\\d+)\\s*[a-zA-Z%°]', 1), '') AS DOUBLE), try_cast(nullif(regexp_extract({s}, '([-+]?\\d+\\.?\\d*)', 1), '') AS DOUBLE))"""


@query("stated_numbers", f"SELECT sample_id, {number('output')} AS number FROM {SFT} WHERE output IS NOT NULL AND task_type = 'exam_short_answer'")
def stated_numbers(spark, d):
    return samples(spark, d, "sample_id", "task_type", "output").filter("output is not null and task_type = 'exam_short_answer'").select("sample_id", A.number_in(F.col("output")).alias("number"))


_W = f"list_distinct(list_filter(string_split(lower(coalesce({strip(f'''regexp_replace(%s, '{WS}+', ' ', 'g')''')}, '')), ' '), lambda w: w <> ''))"


def f1(p: str, g: str) -> str:
    a, b = _W.replace("%s", p), _W.replace("%s", g)
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 0.0 ELSE CAST(2 * len(list_intersect({a}, {b})) AS DOUBLE) / (len({a}) + len({b})) END"


@query("token_f1_scores", f"SELECT model_name, benchmark_id, round({f1('raw_response', 'gold_answer')}, 9) AS f1 FROM {EVAL}")
def token_f1_scores(spark, d):
    return results(spark, d, "model_name", "benchmark_id", "raw_response", "gold_answer", "f1").select("model_name", "benchmark_id", F.round(A.token_f1(F.col("raw_response"), F.col("gold_answer")), 9).alias("f1"))


@query("answer_metrics")
def answer_metrics(spark, d):
    """is_correct, exact_match, f1 and numeric_score of every answer, by the branch of its item."""
    r = results(spark, d, "model_name", "benchmark_id", "task_type", "raw_response", "gold_answer", "is_correct", "exact_match", "f1", "numeric_score").select("model_name", "benchmark_id", "raw_response", "gold_answer").join(items(spark, d).select("benchmark_id", "task_type", "question", "options"), "benchmark_id")
    return r.select("model_name", "benchmark_id", A.metrics(F.col("task_type"), F.col("question"), F.col("options"), F.col("raw_response"), F.col("gold_answer")).alias("m")).select("model_name", "benchmark_id", "m.*")


@query("choice_accuracy", f"""SELECT model_name, count(*) AS n, count(*) FILTER ({letter("coalesce(raw_response, '')")} = {letter("coalesce(gold_answer, '')")}) AS correct FROM {EVAL} WHERE benchmark_id IN (SELECT benchmark_id FROM benchmark_item WHERE len(options) >= 2) GROUP BY model_name""")
def choice_accuracy(spark, d):
    m = answer_metrics(spark, d).join(items(spark, d).filter(F.size("options") >= 2).select("benchmark_id"), "benchmark_id", "left_semi")
    return m.groupBy("model_name").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_correct").alias("correct"))


_ERR = f"""CASE WHEN contains(lower(error), 'multimodal') OR contains(lower(error), 'image') THEN 'multimodal_input_failure' WHEN contains(lower(error), 'format') OR contains(lower(error), 'parse') THEN 'format_error' WHEN contains(lower(error), 'timeout') OR contains(lower(error), 'rate') THEN 'refusal_or_empty_answer'
WHEN coalesce(length({strip('raw_response')}), 0) < 2 THEN 'refusal_or_empty_answer' WHEN task_type = 'exam_calculation' THEN 'calculation_error' WHEN task_type IN ('visual_qa', 'defect_diagnosis', 'diagram_reasoning') THEN 'visual_perception_error' WHEN task_type = 'chart_reading' THEN 'chart_reading_error'
WHEN task_type = 'ocr_reasoning' THEN 'ocr_reasoning_error' WHEN task_type = 'agent_task' THEN 'agent_planning_failure' WHEN task_type IN ('exam_single_choice', 'exam_multiple_choice') THEN 'option_parsing_error' ELSE 'reasoning_error' END"""


@query("error_categories", f"SELECT model_name, {_ERR} AS kind, count(*) AS n FROM {EVAL} WHERE is_correct = false GROUP BY ALL")
def error_categories(spark, d):
    r = results(spark, d, "model_name", "task_type", "raw_response", "is_correct", "error").filter("is_correct = false")
    return r.groupBy("model_name", A.error_kind(F.col("task_type"), F.col("error"), F.col("raw_response")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("top_error_categories", f"SELECT kind, n FROM (SELECT {_ERR} AS kind, count(*) AS n FROM {EVAL} WHERE is_correct = false GROUP BY 1) ORDER BY n DESC, kind LIMIT 5")
def top_error_categories(spark, d):
    return error_categories(spark, d).groupBy("kind").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "kind").limit(5)


@query("json_answers", f"""SELECT sample_id, json_extract_string(j, '$.material') AS material, json_extract_string(j, '$.value') AS value FROM (SELECT sample_id, regexp_extract(output, '(\\{{[\\s\\S]*\\}})', 1) AS j FROM {SFT} WHERE regexp_matches(output, '\\{{[\\s\\S]*\\}}')) WHERE json_valid(j)""")
def json_answers(spark, d):
    s = samples(spark, d, "sample_id", "output").filter(A.json_part(F.col("output")).isNotNull()).select("sample_id", A.parsed(F.col("output"), "material string, value string, _corrupt_record string").alias("j"))
    return s.filter("j is not null and j._corrupt_record is null").select("sample_id", "j.material", "j.value")


@query("answer_forms", "SELECT CASE WHEN len(options) > 0 THEN 'multiple_choice' WHEN lower(answer) IN ('true', 'false', '对', '错', '正确', '错误') THEN 'true_false' WHEN trim(coalesce(answer, '')) <> '' THEN 'text_answer' ELSE 'no_answer' END AS form, count(*) AS n FROM benchmark_item GROUP BY 1")
def answer_forms(spark, d):
    return items(spark, d).groupBy(A.answer_form(F.col("options"), F.col("answer")).alias("form")).agg(F.count(F.lit(1)).alias("n"))


@query("judge_needed", f"SELECT model_name, benchmark_id, (r.task_type IN ('process_reasoning', 'error_diagnosis', 'domain_knowledge_qa') AND r.task_type IS NOT NULL) OR (coalesce(exact_match, true) = false AND coalesce(len(b.options), 0) = 0) AS needed FROM {EVAL} r JOIN (SELECT benchmark_id, options FROM benchmark_item) b USING (benchmark_id)")
def judge_needed(spark, d):
    r = results(spark, d, "model_name", "benchmark_id", "task_type", "exact_match").select("model_name", "benchmark_id", "task_type", "exact_match").join(items(spark, d).select("benchmark_id", "options"), "benchmark_id")
    return r.select("model_name", "benchmark_id", A.needs_judge(F.col("task_type"), F.col("exact_match"), F.col("options"), ["process_reasoning", "error_diagnosis", "domain_knowledge_qa"]).alias("needed"))


@query("model_summary", f"""SELECT model_name, count(*) AS total, count(*) FILTER (error IS NOT NULL) AS errors, count(*) FILTER (error IS NULL AND is_correct IS NULL) AS skipped, count(*) FILTER (error IS NULL AND is_correct) AS correct,
count(*) FILTER (error IS NULL AND is_correct) / nullif(count(*) FILTER (error IS NULL AND is_correct IS NOT NULL), 0) AS accuracy, round(sum(latency_seconds), 3) AS latency FROM {EVAL} GROUP BY model_name""")
def model_summary(spark, d):
    r = results(spark, d, "model_name", "is_correct", "latency_seconds", "error")
    ok = F.col("error").isNull()
    return r.groupBy("model_name").agg(F.count(F.lit(1)).alias("total"), F.count_if(~ok).alias("errors"), F.count_if(ok & F.col("is_correct").isNull()).alias("skipped"), F.count_if(ok & F.col("is_correct")).alias("correct"), F.try_divide(F.count_if(ok & F.col("is_correct")), F.count_if(ok & F.col("is_correct").isNotNull())).alias("accuracy"), F.round(F.sum("latency_seconds"), 3).alias("latency"))


@query("accuracy_breakdowns", f"""SELECT model_name, subset, task_type, CAST(grouping_id(model_name, subset, task_type) AS BIGINT) AS level, count(*) AS n, count(*) FILTER (is_correct) AS correct FROM {EVAL} GROUP BY GROUPING SETS ((), (model_name), (model_name, subset), (model_name, task_type))""")
def accuracy_breakdowns(spark, d):
    results(spark, d, "model_name", "subset", "task_type", "is_correct").createOrReplaceTempView("plinth_results")
    return spark.sql("SELECT model_name, subset, task_type, CAST(grouping_id(model_name, subset, task_type) AS BIGINT) AS level, count(*) AS n, count_if(is_correct) AS correct FROM plinth_results GROUP BY GROUPING SETS ((), (model_name), (model_name, subset), (model_name, task_type))")


_TASKS = ["exam_single_choice", "exam_short_answer", "process_reasoning", "error_diagnosis", "domain_knowledge_qa"]


@query("task_pivot", f"SELECT model_name, {', '.join(f'''count(*) FILTER (task_type = '{t}' AND is_correct) AS {t}''' for t in _TASKS)} FROM {EVAL} GROUP BY model_name")
def task_pivot(spark, d):
    p = results(spark, d, "model_name", "task_type", "is_correct").groupBy("model_name").pivot("task_type", _TASKS).agg(F.count_if("is_correct"))
    return p.fillna(0, _TASKS)


@query("score_buckets", f"SELECT model_name, CASE WHEN f1 IS NULL THEN 'none' WHEN f1 < 0.2 THEN '0.0-0.2' WHEN f1 < 0.4 THEN '0.2-0.4' WHEN f1 < 0.6 THEN '0.4-0.6' WHEN f1 < 0.8 THEN '0.6-0.8' ELSE '0.8-1.0' END AS bucket, count(*) AS n FROM {EVAL} GROUP BY ALL")
def score_buckets(spark, d):
    c = F.col("f1")
    bucket = F.when(c.isNull() | F.isnan(c), "none")
    for hi, name in ((0.2, "0.0-0.2"), (0.4, "0.2-0.4"), (0.6, "0.4-0.6"), (0.8, "0.6-0.8")):
        bucket = bucket.when(c < hi, name)
    return results(spark, d, "model_name", "f1").groupBy("model_name", bucket.otherwise("0.8-1.0").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("score_means", f"SELECT model_name, field, count(v) AS n, round(sum(v), 4) AS total FROM (UNPIVOT (SELECT model_name, f1, numeric_score, llm_judge_score, latency_seconds FROM {EVAL}) ON f1, numeric_score, llm_judge_score, latency_seconds INTO NAME field VALUE v) GROUP BY ALL")
def score_means(spark, d):
    fields = ["f1", "numeric_score", "llm_judge_score", "latency_seconds"]
    return results(spark, d, "model_name", "f1", "numeric_score", "llm_judge_score", "latency_seconds").unpivot(["model_name"], fields, "field", "v").filter("v is not null").groupBy("model_name", "field").agg(F.count("v").alias("n"), F.round(F.sum("v"), 4).alias("total"))


@query("latency_medians", f"SELECT model_name, min(latency_seconds) AS low, max(latency_seconds) AS high, list_sort(list(latency_seconds))[count(latency_seconds) // 2 + 1] AS upper_median FROM {EVAL} GROUP BY model_name")
def latency_medians(spark, d):
    """Upper median sorted[n // 2]: the exact percentile of a frequency histogram, not of a collected list."""
    r = results(spark, d, "model_name", "latency_seconds").filter("latency_seconds is not null").groupBy("model_name", "latency_seconds").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("model_name")
    run = F.sum("n").over(w.orderBy("latency_seconds").rowsBetween(Window.unboundedPreceding, 0))
    c = r.withColumn("run", run).withColumn("total", F.sum("n").over(w))
    return c.groupBy("model_name").agg(F.min("latency_seconds").alias("low"), F.max("latency_seconds").alias("high"), F.min(F.when(F.col("run") > F.expr("total div 2"), F.col("latency_seconds"))).alias("upper_median"))


@query("model_deltas", f"WITH a AS (SELECT model_name, count(*) FILTER (is_correct) / count(*) AS accuracy FROM {EVAL} GROUP BY model_name), b AS (SELECT accuracy FROM a ORDER BY model_name LIMIT 1) SELECT model_name, a.accuracy, a.accuracy - b.accuracy AS delta FROM a, b")
def model_deltas(spark, d):
    a = results(spark, d, "model_name", "is_correct").groupBy("model_name").agg((F.count_if("is_correct") / F.count(F.lit(1))).alias("accuracy"))
    base = a.agg(F.min_by("accuracy", "model_name").alias("base"))  # one row
    return a.crossJoin(F.broadcast(base)).select("model_name", "accuracy", (F.col("accuracy") - F.col("base")).alias("delta"))


@query("category_shares", f"SELECT task_type, count(*) AS n, 100 * count(*) / sum(count(*)) OVER () AS pct FROM {EVAL} GROUP BY task_type")
def category_shares(spark, d):
    g = results(spark, d, "task_type").groupBy("task_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select("task_type", "n", (100 * F.col("n") / F.sum("n").over(Window.partitionBy())).alias("pct"))


def paired(spark, d):
    """Every model against the first by name: (other, benchmark_id, a, b) of correctness."""
    r = results(spark, d, "model_name", "benchmark_id", "is_correct", "f1").filter("is_correct is not null").select("model_name", "benchmark_id", "is_correct", "f1")
    first = r.agg(F.min("model_name").alias("model_name"))
    base = r.join(F.broadcast(first), "model_name").select("benchmark_id", F.col("is_correct").alias("a"), F.col("f1").alias("fa"))
    rest = r.join(F.broadcast(first), "model_name", "left_anti")
    return rest.select(F.col("model_name").alias("other"), "benchmark_id", F.col("is_correct").alias("b"), F.col("f1").alias("fb")).join(base, "benchmark_id")


_PAIRED = f"(SELECT o.model_name AS other, o.benchmark_id, x.is_correct AS a, o.is_correct AS b FROM {EVAL} o JOIN {EVAL} x ON x.benchmark_id = o.benchmark_id AND x.model_name = (SELECT min(model_name) FROM evaluation_result WHERE is_correct IS NOT NULL) AND o.model_name <> x.model_name WHERE o.is_correct IS NOT NULL AND x.is_correct IS NOT NULL)"


@query("mcnemar", f"""SELECT other, b, c, CASE WHEN b + c = 0 THEN 0.0 ELSE pow(abs(b - c) - 1, 2) / (b + c) END AS statistic FROM (SELECT other, count(*) FILTER (a AND NOT b) AS b, count(*) FILTER (NOT a AND b) AS c FROM {_PAIRED} GROUP BY other)""")
def mcnemar(spark, d):
    return statistics.mcnemar(paired(spark, d), ["other"], "a", "b").drop("p_value")


@query("mcnemar_tails")
def mcnemar_tails(spark, d):
    """The published approximate p beside that of the chi-squared distribution."""
    return statistics.mcnemar(paired(spark, d), ["other"], "a", "b").withColumn("p_exact", statistics.chi2_tail(F.col("statistic")))


@query("wilcoxon", """WITH d AS (SELECT doc_id, n_chars - 10 * page_count AS d FROM documents), r AS (SELECT d, row_number() OVER (ORDER BY abs(d), doc_id) AS k FROM d WHERE d <> 0)
SELECT (SELECT count(*) FROM d WHERE d IS NOT NULL) AS n_pairs, count(*) AS n_nonzero, CAST(coalesce(sum(k) FILTER (d > 0), 0) AS BIGINT) AS w_plus, CAST(coalesce(sum(k) FILTER (d < 0), 0) AS BIGINT) AS w_minus, CAST(least(coalesce(sum(k) FILTER (d > 0), 0), coalesce(sum(k) FILTER (d < 0), 0)) AS BIGINT) AS statistic FROM r""")
def wilcoxon(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars", (10 * F.col("page_count")).cast("bigint").alias("ten"))
    return statistics.wilcoxon(Stage(spark, "wilcoxon"), docs, "doc_id", "n_chars", "ten")


@query("bootstrap_intervals")
def bootstrap_intervals(spark, d):
    """95 % interval of each model's accuracy by 200 rounds of the Poisson bootstrap."""
    return statistics.bootstrap(results(spark, d, "model_name", "benchmark_id", "is_correct").filter("is_correct is not null"), ["model_name"], "benchmark_id", F.col("is_correct").cast("double"))


@query("resume_work", f"SELECT m.model_name, b.benchmark_id FROM (SELECT DISTINCT model_name FROM evaluation_result) m CROSS JOIN benchmark_item b ANTI JOIN (SELECT model_name, benchmark_id FROM {EVAL} WHERE error IS NULL) e ON e.model_name = m.model_name AND e.benchmark_id = b.benchmark_id")
def resume_work(spark, d):
    """Pairs of model and item that have no answer yet: every item is exploded to the few models, then anti-joined."""
    models = [r[0] for r in results(spark, d, "model_name", "benchmark_id", "error").select("model_name").distinct().orderBy("model_name").limit(1000).collect()]
    todo = items(spark, d).select("benchmark_id", F.explode(F.array(*[F.lit(m) for m in models])).alias("model_name"))
    return todo.join(results(spark, d, "model_name", "benchmark_id", "error").filter("error is null").select("model_name", "benchmark_id"), ["model_name", "benchmark_id"], "left_anti").select("model_name", "benchmark_id")


@query("case_pivot", f"""SELECT benchmark_id, count(*) FILTER (is_correct) AS right_, count(*) FILTER (NOT is_correct) AS wrong, CASE WHEN count(*) FILTER (is_correct) = 0 THEN 'all_wrong' WHEN count(*) FILTER (NOT is_correct) = 0 THEN 'all_right' ELSE 'split' END AS kind FROM {EVAL} WHERE is_correct IS NOT NULL GROUP BY benchmark_id""")
def case_pivot(spark, d):
    g = results(spark, d, "benchmark_id", "is_correct").filter("is_correct is not null").groupBy("benchmark_id").agg(F.count_if("is_correct").alias("right_"), F.count_if(~F.col("is_correct")).alias("wrong"))
    return g.withColumn("kind", F.when(F.col("right_") == 0, "all_wrong").when(F.col("wrong") == 0, "all_right").otherwise("split"))


@query("eval_prompts", "SELECT benchmark_id, CASE WHEN len(options) >= 2 THEN 'choice' WHEN task_type = 'exam_true_false' THEN 'truth' ELSE 'open' END AS template, coalesce(question, '') || CASE WHEN len(options) >= 2 THEN chr(10) || array_to_string(list_transform(options, lambda o: o.key || '. ' || o.text), chr(10)) ELSE '' END AS prompt FROM benchmark_item")
def eval_prompts(spark, d):
    many = F.coalesce(F.size("options") >= 2, F.lit(False))
    listed = F.concat(F.lit("\n"), F.array_join(F.transform("options", lambda o: F.concat(o["key"], F.lit(". "), o["text"])), "\n"))
    return items(spark, d).select("benchmark_id", F.when(many, "choice").when(F.col("task_type") == "exam_true_false", "truth").otherwise("open").alias("template"), F.concat(F.coalesce("question", F.lit("")), F.when(many, listed).otherwise("")).alias("prompt"))


@query("token_totals", f"SELECT model_name, CAST(sum(element_at(token_usage, 'prompt_tokens')[1]) AS BIGINT) AS prompt_tokens, CAST(sum(element_at(token_usage, 'completion_tokens')[1]) AS BIGINT) AS completion_tokens FROM {EVAL} GROUP BY model_name")
def token_totals(spark, d):
    get = lambda k: F.sum(F.try_element_at("token_usage", F.lit(k)).cast("bigint"))
    return results(spark, d, "model_name", "token_usage").groupBy("model_name").agg(get("prompt_tokens").alias("prompt_tokens"), get("completion_tokens").alias("completion_tokens"))


