"""Building and auditing datasets: filters, joins, leakage, sampling, splits, set operations, formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.functions import answers as A
from plinth.functions import text as T
from plinth.operators import assemble, dedup, quality, sampling, splitting
from plinth.operators.ranking import range_rank
from plinth.plans.registry import CHUNK, SFT, WS, norm, query, strip
from plinth.plans.texts import chunks, samples
from plinth.runtime import Stage, table


def items(spark, d):
    return table(spark, d, "benchmark_item")


# --- filters ---------------------------------------------------------------------------------------------------------


def ready(spark, d, least: float):
    """Items that passed validation with the four scores at ``least`` or more; missing scores count as 0."""
    ok = F.col("validation_status") == "passed"
    for c in ("clarity", "completeness", "answerability", "domain_relevance"):
        ok = ok & (F.coalesce(F.col(f"quality_scores.{c}"), F.lit(0.0)) >= least)
    return items(spark, d).filter(ok).select("benchmark_id")


_READY = "SELECT benchmark_id FROM benchmark_item WHERE validation_status = 'passed' AND " + " AND ".join(f"coalesce(quality_scores.{c}, 0) >= %s" for c in ("clarity", "completeness", "answerability", "domain_relevance"))


@query("items_ready", _READY.replace("%s", "0.3"))
def items_ready(spark, d):
    return ready(spark, d, 0.3)


@query("items_publishable", _READY.replace("%s", "0.7"))
def items_publishable(spark, d):
    """With the published threshold of the scores."""
    return ready(spark, d, 0.7)


_MARK = " + ".join(f"CASE WHEN contains(o, '{m.replace(chr(39), chr(39) * 2)}') THEN 1 ELSE 0 END" for m in A.NO_ANSWER)


@query("sample_gate", f"""SELECT sample_id, (length({strip('i')}) < 5)::INT + (length({strip('o')}) < 2)::INT + (length(o) > 5000)::INT + {_MARK} AS hard_issues FROM (SELECT sample_id, coalesce(instruction, '') AS i, coalesce(output, '') AS o FROM {SFT})""")
def sample_gate(spark, d):
    names, _ = quality.issues(F.col("instruction"), F.col("output"), F.lit(None).cast("array<string>"))
    hard = F.filter(names, lambda n: n.isin("empty_or_short_instruction", "empty_output", "output_too_long") | n.startswith("no_answer"))
    return samples(spark, d, "sample_id", "instruction", "output").select("sample_id", F.size(hard).alias("hard_issues"))


_WORD = "[\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}]+"
_ISSUES = f"""SELECT sample_id, i, o, evidence, list_distinct(regexp_extract_all(substr(o, 1, 200), '{_WORD}')) AS w, list_distinct(regexp_extract_all(substr(array_to_string(coalesce(evidence, [])[1:3], ' '), 1, 500), '{_WORD}')) AS e FROM (SELECT *, coalesce(instruction, '') AS i, coalesce(output, '') AS o FROM {SFT})"""
_RULES = [
    (f"length({strip('i')}) < 5", "empty_or_short_instruction", 0.5), (f"length({strip('o')}) < 2", "empty_output", 0.5), ("length(o) > 5000", "output_too_long", 0.2), *[(f"contains(o, '{m.replace(chr(39), chr(39) * 2)}')", f"no_answer: {m.replace(chr(39), chr(39) * 2)}", 0.3) for m in A.NO_ANSWER],
    (f"o <> '' AND length(regexp_replace(o, '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}{WS[1:-1]}]', '', 'g')) < length(o) * 0.3", "output_mostly_noise", 0.4),
    (f"NOT ({' OR '.join(f'contains(i || o, {chr(39)}{t}{chr(39)})' for t in T.DOMAIN_TERMS)})", "no_domain_relevance", 0.3), ("coalesce(len(evidence), 0) > 0 AND len(list_intersect(w, e)) < 2 AND len(w) > 5", "low_evidence_support", 0.2), ("length(i) > 2000", "instruction_too_long", 0.1),
]
_NAMES = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n, _ in _RULES) + "], lambda x: x IS NOT NULL)"
_SCORE = "greatest(0.0, 1 - (" + " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0.0 END" for c, _, p in _RULES) + "))"


@query("sample_issues", f"SELECT sample_id, array_to_string(n, ';') AS issues, round(CAST(s AS DOUBLE), 3) AS score, len(n) = 0 AND s >= 0.5 AS passed FROM (SELECT sample_id, {_NAMES} AS n, {_SCORE} AS s FROM ({_ISSUES}))")
def sample_issues(spark, d):
    """Issues of every sample, its score and whether it passes (no issue at all and 0.5 or more)."""
    names, score = quality.issues(F.col("instruction"), F.col("output"), F.col("evidence"), [(F.length("instruction") > 2000, "instruction_too_long", 0.1)])
    return samples(spark, d, "sample_id", "instruction", "output", "evidence").select("sample_id", F.array_join(names, ";").alias("issues"), F.round(score, 3).alias("score")).withColumn("passed", (F.col("issues") == "") & (F.col("score") >= 0.5))


@query("support_tiers", f"""WITH w AS (SELECT sample_id, list_distinct(regexp_extract_all(substr(coalesce(output, ''), 1, 100000), '{_WORD}')) AS o, list_distinct(regexp_extract_all(substr(array_to_string(coalesce(evidence, []), ' '), 1, 100000), '{_WORD}')) AS e FROM {SFT}), s AS (SELECT sample_id, CASE WHEN len(o) = 0 THEN 0.0 ELSE CAST(len(list_intersect(o, e)) AS DOUBLE) / len(o) END AS support FROM w)
SELECT sample_id, CAST(support AS DOUBLE) AS support, CASE WHEN support >= 0.25 THEN 'gold' WHEN support >= 0.15 THEN 'silver' ELSE 'rejected' END AS tier FROM s""")
def support_tiers(spark, d):
    """gold, silver or rejected by the share of an answer's words that its evidence has."""
    words = lambda c: quality.overlap_words(c, 100_000)
    o, e = words(F.coalesce("output", F.lit(""))), words(F.array_join(F.coalesce("evidence", F.array().cast("array<string>")), " "))
    s = samples(spark, d, "sample_id", "output", "evidence").select("sample_id", F.coalesce(F.try_divide(F.size(F.array_intersect(o, e)).cast("double"), F.size(o)), F.lit(0.0)).alias("support"))
    return s.withColumn("tier", F.when(F.col("support") >= 0.25, "gold").when(F.col("support") >= 0.15, "silver").otherwise("rejected"))


@query("reject_reasons", f"SELECT chunk_id, CASE WHEN length(coalesce(cleaned_text, '')) < 200 THEN 'too_short' WHEN NOT ({' OR '.join(f'''contains(cleaned_text, '{t}')''' for t in T.DOMAIN_TERMS)}) THEN 'no_domain_term' WHEN keep_for_corpus = false THEN 'not_kept' END AS reason FROM {CHUNK}")
def reject_reasons(spark, d):
    t = F.coalesce("cleaned_text", F.lit(""))
    return chunks(spark, d, "chunk_id", "cleaned_text", "keep_for_corpus").select("chunk_id", quality.first_reason((F.length(t) < 200, "too_short"), (~T.contains_any(t, T.DOMAIN_TERMS), "no_domain_term"), (~F.col("keep_for_corpus"), "not_kept")).alias("reason"))


@query("corpus_rows", f"SELECT chunk_id, source_file, length(cleaned_text) AS chars FROM {CHUNK} WHERE keep_for_corpus AND coalesce(chunk_type, '') <> 'empty' AND {strip('cleaned_text')} <> ''")
def corpus_rows(spark, d):
    c = chunks(spark, d, "chunk_id", "source_file", "cleaned_text", "chunk_type", "keep_for_corpus").filter(F.col("keep_for_corpus") & (F.coalesce("chunk_type", F.lit("")) != "empty") & (T.strip(F.col("cleaned_text")) != ""))
    return c.select("chunk_id", "source_file", F.length("cleaned_text").cast("bigint").alias("chars"))


@query("named_subsets", "SELECT subset, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN modality = 'text' THEN 'text' END, CASE WHEN source_type = 'exam' THEN 'exam' END, CASE WHEN difficulty IN ('hard', 'expert') THEN 'hard' END, 'full'], lambda x: x IS NOT NULL)) AS subset FROM benchmark_item) GROUP BY subset")
def named_subsets(spark, d):
    names = F.array_compact(F.array(F.when(F.col("modality") == "text", "text"), F.when(F.col("source_type") == "exam", "exam"), F.when(F.col("difficulty").isin("hard", "expert"), "hard"), F.lit("full")))
    return items(spark, d).select(F.explode(names).alias("subset")).groupBy("subset").agg(F.count(F.lit(1)).alias("n"))


@query("missing_fields", f"SELECT field, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN coalesce(instruction, '') = '' THEN 'instruction' END, CASE WHEN coalesce(output, '') = '' THEN 'output' END, CASE WHEN coalesce(source_type, '') = '' THEN 'source_type' END, CASE WHEN coalesce(len(source_refs), 0) = 0 THEN 'source_refs' END], lambda x: x IS NOT NULL)) AS field FROM {SFT}) GROUP BY field")
def missing_fields(spark, d):
    blank = [F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in ("instruction", "output", "source_type")]
    blank.append(F.when(F.coalesce(F.size("source_refs"), F.lit(0)) <= 0, F.lit("source_refs")))
    return samples(spark, d, "source_type", "instruction", "output", "source_refs").select(F.explode(F.array_compact(F.array(*blank))).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


@query("secret_scan", "SELECT doc_id, text LIKE '%@%' AS has_at, regexp_matches(text, '[0-9]{11,}') AS long_number FROM documents WHERE text IS NOT NULL AND (text LIKE '%@%' OR regexp_matches(text, '[0-9]{11,}'))")
def secret_scan(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").filter(t.contains("@") | t.rlike("[0-9]{11,}")).select("doc_id", t.contains("@").alias("has_at"), t.rlike("[0-9]{11,}").alias("long_number"))


@query("masked_lengths")
def masked_lengths(spark, d):
    """Documents that masking of keys, mail addresses and long numbers changes."""
    m = table(spark, d, "documents").select("doc_id", "text", T.mask_secrets(F.col("text")).alias("masked"))
    return m.filter("text <> masked").select("doc_id", F.length("text").alias("before"), F.length("masked").alias("after"))


_PHRASES = ["作为语言模型", "language model", "抱歉", "sorry"]


@query("phrase_scan", f"SELECT phrase, count(*) AS n FROM {SFT}, (SELECT unnest({_PHRASES}) AS phrase) WHERE contains(lower(output), phrase) GROUP BY phrase")
def phrase_scan(spark, d):
    hit = F.array_compact(F.array(*[F.when(F.lower("output").contains(p), F.lit(p)) for p in _PHRASES]))
    return samples(spark, d, "output").select(F.explode(hit).alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))


# --- joins, leakage ----------------------------------------------------------------------------------------------------


@query("labelled_documents", "SELECT d.doc_id, d.source, coalesce(l.text_kind, 'no_label') AS kind FROM documents d LEFT JOIN (SELECT doc_id, max_by(text_kind, annotator) AS text_kind FROM doc_label GROUP BY doc_id) l ON l.doc_id = d.doc_id")
def labelled_documents(spark, d):
    """Left join against the last label of each document, with a default."""
    last = dedup.first_wins(table(spark, d, "doc_label"), ["doc_id"], "annotator", last=True).select("doc_id", "text_kind")
    return table(spark, d, "documents").join(last, "doc_id", "left").select("doc_id", "source", F.coalesce("text_kind", F.lit("no_label")).alias("kind"))


@query("exact_question_leaks", f"SELECT s.sample_id, b.benchmark_id FROM {SFT} s JOIN (SELECT {norm('question')} AS q, min(benchmark_id) AS benchmark_id FROM benchmark_item GROUP BY 1) b ON b.q = {norm('s.instruction')}")
def exact_question_leaks(spark, d):
    b = items(spark, d).select(T.normalize_text(F.col("question")).alias("q"), "benchmark_id").groupBy("q").agg(F.min("benchmark_id").alias("benchmark_id"))
    return samples(spark, d, "sample_id", "instruction").select("sample_id", T.normalize_text(F.col("instruction")).alias("q")).join(b, "q").select("sample_id", "benchmark_id")


@query("leakage_flags", f"""WITH q AS (SELECT DISTINCT md5({norm('question')}) AS h FROM benchmark_item), a AS (SELECT DISTINCT md5({norm('answer')}) AS h FROM benchmark_item), g AS (SELECT DISTINCT leakage_group_id AS h FROM benchmark_item WHERE leakage_group_id <> ''), r AS (SELECT DISTINCT unnest(source_refs) AS h FROM benchmark_item)
SELECT sample_id, md5({norm('instruction')}) IN (SELECT h FROM q WHERE h IS NOT NULL) AS question, length(output) > 20 AND md5({norm('substr(output, 1, 200)')}) IN (SELECT h FROM a WHERE h IS NOT NULL) AS answer, coalesce(leakage_group_id IN (SELECT h FROM g), false) AS grp, list_has_any(coalesce(source_refs, []), (SELECT list(h) FROM r WHERE h IS NOT NULL)) AS ref
FROM {SFT} WHERE instruction IS NOT NULL AND output IS NOT NULL""")
def leakage_flags(spark, d):
    """Which keys of the benchmark a sample shares: question, answer prefix, group, a source reference; one join per distinct key set."""
    b = items(spark, d)
    s = samples(spark, d, "sample_id", "instruction", "output", "source_refs", "leakage_group_id").filter("instruction is not null and output is not null").select("sample_id", "output", "leakage_group_id", "source_refs", T.text_hash(F.col("instruction")).alias("qh"), T.text_hash(F.substring("output", 1, 200)).alias("ah"))
    keys = lambda c, n: b.select(c.alias(n)).filter(F.col(n).isNotNull() & (F.col(n) != "")).distinct().withColumn(f"has_{n}", F.lit(True))
    s = s.join(keys(T.text_hash(F.col("question")), "qh"), "qh", "left").join(keys(T.text_hash(F.col("answer")), "ah"), "ah", "left").join(keys(F.col("leakage_group_id"), "leakage_group_id"), "leakage_group_id", "left")
    refs = s.select("sample_id", F.explode("source_refs").alias("r")).join(keys(F.explode("source_refs"), "r"), "r", "left_semi").select("sample_id").distinct().withColumn("has_ref", F.lit(True))
    out = s.join(refs, "sample_id", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return out.select("sample_id", flag("has_qh").alias("question"), (flag("has_ah") & (F.length("output") > 20)).alias("answer"), flag("has_leakage_group_id").alias("grp"), flag("has_ref").alias("ref"))


@query("id_consistency", f"SELECT count(*) FILTER (a IS NOT NULL AND b IS NULL) AS only_items, count(*) FILTER (a IS NULL AND b IS NOT NULL) AS only_results, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS both_ FROM (SELECT DISTINCT benchmark_id AS a FROM benchmark_item) FULL JOIN (SELECT DISTINCT benchmark_id AS b FROM evaluation_result) ON a = b")
def id_consistency(spark, d):
    a, b = items(spark, d).select(F.col("benchmark_id").alias("a")).distinct(), table(spark, d, "evaluation_result").select(F.col("benchmark_id").alias("b")).distinct()
    j = a.join(b, F.col("a") == F.col("b"), "full")
    return j.agg(F.count_if(F.col("b").isNull()).alias("only_items"), F.count_if(F.col("a").isNull()).alias("only_results"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both_"))


@query("refs_to_chunks", f"SELECT count(*) AS refs, count(*) FILTER (r IN (SELECT chunk_id FROM cleaned_chunk)) AS found FROM (SELECT DISTINCT unnest(source_refs) AS r FROM {SFT}) WHERE r LIKE 'chunk_%'")
def refs_to_chunks(spark, d):
    r = samples(spark, d, "source_refs").select(F.explode("source_refs").alias("r")).filter("r like 'chunk_%'").distinct()
    ids = table(spark, d, "cleaned_chunk").select(F.col("chunk_id").alias("r")).distinct().withColumn("there", F.lit(1))
    return r.join(ids, "r", "left").agg(F.count(F.lit(1)).alias("refs"), F.count("there").alias("found"))


@query("positional_pairs", f"SELECT x.k, x.doc_id AS a, y.doc_id AS b FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM documents WHERE lang = 'zh') x JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM documents WHERE lang = 'en') y ON x.k = y.k")
def positional_pairs(spark, d):
    docs, stage = table(spark, d, "documents").select("doc_id", "lang"), Stage(spark, "zip")
    a = sampling.ordered_rank(stage, docs.filter("lang = 'zh'").select(F.col("doc_id").alias("a")), ["a"], "k")
    b = sampling.ordered_rank(stage, docs.filter("lang = 'en'").select(F.col("doc_id").alias("b")), ["b"], "k2")
    return a.join(b, F.col("k") == F.col("k2")).select("k", "a", "b")


# --- sampling, ranking --------------------------------------------------------------------------------------------------


@query("top_sources", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, min(doc_id) LIMIT 20")
def top_sources(spark, d):
    g = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    return g.orderBy(F.desc("n"), "first").limit(20).select("source", "n")


@query("capped_per_task", f"SELECT sample_id, task_type FROM {SFT} QUALIFY row_number() OVER (PARTITION BY task_type ORDER BY ordinal) <= 30")
def capped_per_task(spark, d):
    return sampling.top_per_group(samples(spark, d, "ordinal", "sample_id", "task_type").select("sample_id", "task_type", "ordinal"), ["task_type"], [F.col("ordinal")], 30).select("sample_id", "task_type")


@query("seeded_per_task", f"SELECT sample_id, task_type FROM {SFT} QUALIFY row_number() OVER (PARTITION BY task_type ORDER BY md5('42:' || sample_id), sample_id) <= 25")
def seeded_per_task(spark, d):
    return sampling.sample_per_group(samples(spark, d, "sample_id", "task_type").select("sample_id", "task_type"), ["task_type"], "sample_id", 25)


@query("proportional_sample", """WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY source), q AS (SELECT source, least(n, greatest(1, CAST(floor(100 * n / (SELECT count(*) FROM documents)) AS BIGINT))) AS q FROM g)
SELECT doc_id, d.source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS rn FROM documents) d JOIN q ON q.source IS NOT DISTINCT FROM d.source WHERE rn <= q""")
def proportional_sample(spark, d):
    return sampling.proportional(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 100)


@query("recent_messages", "SELECT event_id, user_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def recent_messages(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    return sampling.top_per_group(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], 3)


@query("contiguous_ids", f"SELECT sample_id, printf('item_%06d', row_number() OVER (ORDER BY sample_id) - 1) AS new_id FROM {SFT}")
def contiguous_ids(spark, d):
    r = sampling.ordered_rank(Stage(spark, "ids"), samples(spark, d, "sample_id").select("sample_id"), ["sample_id"], "n")
    return r.select("sample_id", F.format_string("item_%06d", F.col("n") - 1).alias("new_id"))


@query("budget_prefix", "SELECT doc_id, source, CAST(running AS BIGINT) AS running FROM (SELECT doc_id, source, sum(n_chars // 4) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING) AS running FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL) WHERE running <= 8000")
def budget_prefix(spark, d):
    docs = table(spark, d, "documents").filter("source is not null and n_chars is not null").select("doc_id", "source", "n_chars")
    return sampling.budget_prefix(Stage(spark, "budget"), docs, ["source"], [F.desc("n_chars")], ["doc_id"], F.expr("cast(n_chars as bigint) div 4"), 8000).select("doc_id", "source", "running")


@query("size_batches")
def size_batches(spark, d):
    """Batches of at most 6000 characters per source, in order of id."""
    docs = table(spark, d, "documents").filter("source is not null and text is not null").select("source", "doc_id", F.length("text").alias("n"))
    return sampling.size_batches(docs, "source", "doc_id", "n", 6000)


@query("low_half_summary", "SELECT task_type, count(*) AS n, min(quality_score) AS low FROM (SELECT task_type, quality_score, row_number() OVER (PARTITION BY task_type ORDER BY quality_score, sample_id) AS rn, count(*) OVER (PARTITION BY task_type) AS c FROM " + SFT + " WHERE quality_score IS NOT NULL AND NOT isnan(quality_score)) WHERE rn <= c // 2 GROUP BY task_type")
def low_half_summary(spark, d):
    s = samples(spark, d, "sample_id", "task_type", "quality_score").filter("quality_score is not null and not isnan(quality_score)")
    size = s.groupBy(F.col("task_type").alias("t")).agg(F.count(F.lit(1)).alias("c"))
    ranked = range_rank(Stage(spark, "low"), s, ["task_type"], [F.col("quality_score")], ["sample_id"])
    r = ranked.join(size, F.col("task_type").eqNullSafe(F.col("t"))).filter("rank_no <= c div 2")
    return r.groupBy("task_type").agg(F.count(F.lit(1)).alias("n"), F.min("quality_score").alias("low"))


# --- splits, assembly ---------------------------------------------------------------------------------------------------


@query("group_split")
def group_split(spark, d):
    """dev and test by leakage group; items without a group are groups of their own."""
    b = items(spark, d).select("benchmark_id", "leakage_group_id", "task_type")
    return splitting.by_group(b, F.coalesce("leakage_group_id", "benchmark_id"), 0.2, ("dev", "test"))


@query("group_split_spans")
def group_split_spans(spark, d):
    """Leakage groups that span both splits: none."""
    s = group_split(spark, d)
    return splitting.spans(s, "split", F.coalesce("leakage_group_id", "benchmark_id"))


@query("split_spans", f"SELECT leakage_group_id AS value, count(DISTINCT lower(trim(split))) AS splits FROM {SFT} WHERE leakage_group_id IS NOT NULL AND split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT lower(trim(split))) > 1")
def split_spans(spark, d):
    s = samples(spark, d, "leakage_group_id", "split").select("leakage_group_id", F.lower(F.trim("split")).alias("split"))
    return splitting.spans(s, "split", F.col("leakage_group_id"))


@query("split_statistics", f"SELECT lower(trim(split)) AS split, count(*) AS n, count(DISTINCT task_type) AS tasks, round(avg(length(instruction)), 6) AS prompt_chars, round(avg(length(output)), 6) AS answer_chars FROM {SFT} WHERE split IS NOT NULL GROUP BY 1")
def split_statistics(spark, d):
    s = samples(spark, d, "task_type", "instruction", "output", "split").filter("split is not null")
    return s.groupBy(F.lower(F.trim("split")).alias("split")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("task_type").alias("tasks"), F.round(F.avg(F.length("instruction")), 6).alias("prompt_chars"), F.round(F.avg(F.length("output")), 6).alias("answer_chars"))


@query("item_dimensions", "SELECT 'difficulty' AS dimension, difficulty AS value, count(*) AS n FROM benchmark_item GROUP BY difficulty UNION ALL SELECT 'modality', modality, count(*) FROM benchmark_item GROUP BY modality UNION ALL SELECT 'source_type', source_type, count(*) FROM benchmark_item GROUP BY source_type UNION ALL SELECT 'task_type', task_type, count(*) FROM benchmark_item GROUP BY task_type")
def item_dimensions(spark, d):
    """Counts along every dimension in one pass over the rows."""
    names = ["difficulty", "modality", "source_type", "task_type"]
    return items(spark, d).unpivot([], names, "dimension", "value").groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


@query("item_audit", "SELECT count(*) AS item_count, count(DISTINCT benchmark_id) AS ids, count(*) FILTER (coalesce(explanation, '') <> '') AS explained, count(*) FILTER (len(options) > 0) AS with_options, count(*) FILTER (quality_scores IS NULL) AS unscored, (SELECT count(DISTINCT r) FROM (SELECT unnest(source_refs) AS r FROM benchmark_item) WHERE r <> '') AS sources FROM benchmark_item")
def item_audit(spark, d):
    b = items(spark, d)
    refs = b.select(F.explode("source_refs").alias("r")).filter("r <> ''").agg(F.countDistinct("r").alias("sources"))
    a = b.agg(F.count(F.lit(1)).alias("item_count"), F.countDistinct("benchmark_id").alias("ids"), F.count_if(F.coalesce("explanation", F.lit("")) != "").alias("explained"), F.count_if(F.size("options") > 0).alias("with_options"), F.count_if(F.col("quality_scores").isNull()).alias("unscored"))
    return a.crossJoin(refs)  # one row each


@query("union_pools", f"SELECT pool, count(*) AS n FROM (SELECT 'sft' AS pool, sample_id AS id, instruction AS prompt FROM {SFT} UNION ALL SELECT 'benchmark', benchmark_id, question FROM benchmark_item UNION ALL SELECT 'chunk', chunk_id, cleaned_text FROM {CHUNK}) WHERE prompt IS NOT NULL GROUP BY pool")
def union_pools(spark, d):
    pools = assemble.union_all([samples(spark, d, "sample_id", "instruction").select(F.lit("sft").alias("pool"), F.col("sample_id").alias("id"), F.col("instruction").alias("prompt")), items(spark, d).select(F.lit("benchmark").alias("pool"), F.col("benchmark_id").alias("id"), F.col("question").alias("prompt")), chunks(spark, d, "chunk_id", "cleaned_text").select(F.lit("chunk").alias("pool"), F.col("chunk_id").alias("id"), F.col("cleaned_text").alias("prompt"))])
    return pools.filter("prompt is not null").groupBy("pool").agg(F.count(F.lit(1)).alias("n"))


@query("set_operations", f"WITH a AS (SELECT DISTINCT unnest(source_refs) AS r FROM {SFT} WHERE lower(trim(split)) = 'train'), b AS (SELECT DISTINCT unnest(source_refs) AS r FROM {SFT} WHERE lower(trim(split)) = 'test') SELECT 'both' AS part, r FROM (SELECT r FROM a INTERSECT SELECT r FROM b) UNION ALL SELECT 'test_only', r FROM (SELECT r FROM b EXCEPT SELECT r FROM a)")
def set_operations(spark, d):
    s = samples(spark, d, "source_refs", "split")
    part = lambda n: s.filter(F.lower(F.trim("split")) == n).select(F.explode("source_refs").alias("r")).distinct()
    a, b = part("train"), part("test")
    return a.intersect(b).select(F.lit("both").alias("part"), "r").unionByName(b.subtract(a).select(F.lit("test_only").alias("part"), "r"))


_CHAT = "list_filter([CASE WHEN coalesce(system_prompt, '') <> '' THEN {'role': 'system', 'content': system_prompt} END, {'role': 'user', 'content': coalesce(instruction, '') || CASE WHEN coalesce(input, '') <> '' THEN chr(10) || chr(10) || input ELSE '' END}, {'role': 'assistant', 'content': coalesce(output, '')}], lambda m: m IS NOT NULL)"


@query("chat_messages", f"SELECT sample_id, n - 1 AS place, m.role AS role, m.content AS content FROM (SELECT sample_id, unnest({_CHAT}) AS m, unnest(range(1, len({_CHAT}) + 1)) AS n FROM {SFT})")
def chat_messages(spark, d):
    return samples(spark, d, "sample_id", "instruction", "input", "output", "system_prompt").select("sample_id", F.posexplode(assemble.chat(F.col("system_prompt"), F.col("instruction"), F.col("input"), F.col("output"))).alias("place", "m")).select("sample_id", F.col("place").cast("bigint").alias("place"), "m.role", "m.content")


@query("instruction_records")
def instruction_records(spark, d):
    """The three training formats of every sample as JSON lines."""
    c = [F.col(x) for x in ("system_prompt", "instruction", "input", "output")]
    return samples(spark, d, "sample_id", "instruction", "input", "output", "system_prompt").select("sample_id", F.to_json(assemble.instruction(*c[1:])).alias("instruction_json"), F.to_json(F.struct(assemble.chat(*c).alias("messages"))).alias("chat_json"), F.to_json(F.struct(assemble.turns(*c).alias("conversations"))).alias("turns_json"))


@query("evidence_sizes", f"SELECT sample_id, CAST(coalesce(list_sum(list_transform(evidence, lambda e: length(e))), 0) AS BIGINT) AS chars, CASE WHEN coalesce(list_sum(list_transform(evidence, lambda e: length(e))), 0) > 100 THEN 'long' WHEN coalesce(list_sum(list_transform(evidence, lambda e: length(e))), 0) > 30 THEN 'medium' ELSE 'short' END AS bucket FROM {SFT}")
def evidence_sizes(spark, d):
    n = F.coalesce(F.aggregate("evidence", F.lit(0).cast("bigint"), lambda s, e: s + F.coalesce(F.length(e), F.lit(0))), F.lit(0).cast("bigint"))
    return samples(spark, d, "sample_id", "evidence").select("sample_id", n.alias("chars")).withColumn("bucket", F.when(F.col("chars") > 100, "long").when(F.col("chars") > 30, "medium").otherwise("short"))


@query("route_rows", "SELECT CASE WHEN lang IN ('zh', 'ZH') THEN 'zh' WHEN lang IS NULL OR trim(lang) = '' THEN 'unknown' ELSE 'other' END AS route, count(*) AS n FROM documents GROUP BY 1")
def route_rows(spark, d):
    r = F.when(F.col("lang").isin("zh", "ZH"), "zh").when(F.col("lang").isNull() | (F.trim("lang") == ""), "unknown").otherwise("other")
    return table(spark, d, "documents").groupBy(r.alias("route")).agg(F.count(F.lit(1)).alias("n"))


@query("mapped_knowledge")
def mapped_knowledge(spark, d):
    """Claims that the offline client extracts from cleaned chunks, with a fallback row where its reply can't be read."""
    from plinth.operators import mapping

    c = chunks(spark, d, "chunk_id", "cleaned_text").filter("cleaned_text is not null and cleaned_text <> ''").select("chunk_id", F.col("cleaned_text").alias("prompt"))
    return mapping.extract_many(c, "chunk_id", mapping.OfflineClient, "claim string, kind string")


