"""Text functions, exact and near duplicates, chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.functions import text as T
from plinth.operators import chunking, dedup, similarity
from plinth.plans.registry import CHUNK, CJK, SFT, WS, count, norm, query, strip
from plinth.runtime import Stage, table

_H = f"(SELECT doc_id, md5({norm('text')}) AS h FROM documents)"


@query("exact_dedup_resolution", f"""SELECT doc_id, h, CASE WHEN h IS NULL THEN 1 ELSE count(*) OVER w END AS n, CASE WHEN h IS NULL THEN doc_id ELSE min(doc_id) OVER w END AS keeper,
CASE WHEN h IS NULL OR doc_id = min(doc_id) OVER w THEN 'keep' ELSE 'remove' END AS action FROM {_H} WINDOW w AS (PARTITION BY h)""")
def exact_dedup_resolution(spark, d):
    return dedup.resolution(table(spark, d, "documents"), "doc_id", T.text_hash(F.col("text")))


@query("exact_dup_groups", f"SELECT h, min(doc_id) AS keeper, count(*) AS n FROM {_H} WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1")
def exact_dup_groups(spark, d):
    return dedup.exact_groups(table(spark, d, "documents"), "doc_id", T.text_hash(F.col("text")))


@query("prefix_dedup", f"SELECT sample_id FROM (SELECT sample_id, row_number() OVER (PARTITION BY substr(coalesce(instruction, ''), 1, 100), substr(coalesce(output, ''), 1, 100) ORDER BY ordinal) AS rn FROM {SFT}) WHERE rn = 1")
def prefix_dedup(spark, d):
    sft = samples(spark, d, "ordinal", "sample_id", "instruction", "output").select("sample_id", "ordinal", F.substring(F.coalesce("instruction", F.lit("")), 1, 100).alias("a"), F.substring(F.coalesce("output", F.lit("")), 1, 100).alias("b"))
    return dedup.first_wins(sft, ["a", "b"], "ordinal").select("sample_id")


@query("duplicate_pair_report", "SELECT first, doc_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents WHERE text IS NOT NULL) WHERE doc_id > first")
def duplicate_pair_report(spark, d):
    return dedup.duplicate_pairs(table(spark, d, "documents"), "doc_id", F.col("text"))


@query("surplus_deliveries", "SELECT count(*) AS row_count, count(DISTINCT sample_id) AS ids, count(*) - count(DISTINCT sample_id) AS surplus FROM sft_sample")
def surplus_deliveries(spark, d):
    return dedup.surplus_ids(table(spark, d, "sft_sample"), "sample_id")


@query("last_delivery", "SELECT sample_id, ordinal, split FROM sft_sample QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY ordinal DESC) = 1")
def last_delivery(spark, d):
    return dedup.first_wins(table(spark, d, "sft_sample").select("sample_id", "ordinal", "split"), ["sample_id"], "ordinal", last=True)


def first_delivery(df, key: list[str], columns: tuple[str, ...]):
    want = list(dict.fromkeys([*key, "ordinal", *columns])) if columns else df.columns
    out = dedup.first_wins(df.select(*want), key, "ordinal")
    return out.select(*columns) if columns else out


def samples(spark, d, *columns: str):
    """First deliveries, only the given columns (all if none is given), so that the scan reads no others."""
    return first_delivery(table(spark, d, "sft_sample"), ["sample_id"], columns)


def chunks(spark, d, *columns: str):
    """First deliveries, only the given columns (all if none is given), so that the scan reads no others."""
    return first_delivery(table(spark, d, "cleaned_chunk"), ["chunk_id"], columns)


def results(spark, d, *columns: str):
    """First deliveries, only the given columns (all if none is given), so that the scan reads no others."""
    return first_delivery(table(spark, d, "evaluation_result"), ["model_name", "benchmark_id"], columns)


_LANG = f"CASE WHEN {count(CJK, 'text')} > {count('[a-zA-Z]', 'text')} * 0.3 THEN 'zh' WHEN {count('[a-zA-Z]', 'text')} > {count(CJK, 'text')} * 3 THEN 'en' ELSE 'unknown' END"


@query("language_counts", f"SELECT {_LANG} AS detected, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents WHERE text IS NOT NULL GROUP BY 1")
def language_counts(spark, d):
    docs = table(spark, d, "documents").filter("text is not null")
    return docs.groupBy(T.detect_language(F.col("text")).alias("detected")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text").cast("bigint")).alias("chars"))


@query("language_by_document", f"SELECT doc_id, {_LANG} AS detected, {count(CJK, 'text')} > length(text) * 0.3 AS chinese FROM documents WHERE text IS NOT NULL")
def language_by_document(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", T.detect_language(F.col("text")).alias("detected"), T.is_chinese(F.col("text")).alias("chinese"))


_REPEATED = "list_bool_or(list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 1) NOT IN (chr(10), chr(13)) AND substr(t, i, 5) = repeat(substr(t, i, 1), 5)))"
_GARBLED = "[^\\p{L}\\p{N}_\\s\\x{4e00}-\\x{9fff}\\x{3000}-\\x{303f}\\x{ff00}-\\x{ffef}.,;:!?()\\[\\]{}\"''/@#$%&*-+=<>~°μΩαβγδεηθλπσφψω℃±×÷≈≠≤≥∝∞∫∑∂√∇≡⊥∠∥∏]"


@query("noise_flags", f"""WITH c AS (SELECT chunk_id, original_text AS t FROM {CHUNK} WHERE original_text IS NOT NULL), long AS (SELECT * FROM c WHERE length({strip('t')}) >= 15)
SELECT chunk_id, 'empty_page' AS issue FROM c WHERE length({strip('t')}) < 15
UNION ALL SELECT chunk_id, 'box_drawing' FROM long WHERE regexp_matches(t, '[{T.BOX}]')
UNION ALL SELECT chunk_id, 'irregular_spacing' FROM long WHERE regexp_matches(t, '\\S\\s{{3,}}\\S')
UNION ALL SELECT chunk_id, 'char_repetition' FROM long WHERE coalesce({_REPEATED}, false)
UNION ALL SELECT chunk_id, 'page_number_header' FROM long WHERE regexp_matches(t, '^第\\d+页|^\\s*Page\\s*\\d+\\s*$')
UNION ALL SELECT chunk_id, 'repeated_header' FROM long WHERE regexp_matches(t, '^(碳纤维|Carbon Fiber|CFRP|第\\d+章|Chapter\\s+\\d+)\\s*$')
UNION ALL SELECT chunk_id, 'garbled_unicode' FROM long WHERE regexp_matches(t, '{_GARBLED}')
UNION ALL SELECT chunk_id, 'broken_line_hyphen' FROM long WHERE regexp_matches(t, '-\\s*\\n\\s*')""")
def noise_flags(spark, d):
    """One row per chunk and noise pattern of its page text."""
    return chunks(spark, d, "chunk_id", "original_text").select("chunk_id", F.explode(T.noise_issues(F.col("original_text"))).alias("issue"))


_BOXY = "original_text ~ '[\\s\\S]*[─━│┃┏┓┗┛├┤┬┴┼┄┅┆┇┈┉┊┋][\\s\\S]*'"


@query("noise_report", f"""SELECT source_file, count(*) AS chunks, count(*) FILTER (length({strip('original_text')}) < 15) AS empty_pages,
count(*) FILTER (length({strip('original_text')}) >= 15 AND regexp_matches(original_text, '-\\s*\\n\\s*')) AS broken, count(*) FILTER (length({strip('original_text')}) >= 15 AND regexp_matches(original_text, '\\S\\s{{3,}}\\S')) AS spaced,
CAST(sum(length(original_text)) AS BIGINT) AS chars FROM {CHUNK} WHERE original_text IS NOT NULL GROUP BY source_file""")
def noise_report(spark, d):
    c = chunks(spark, d, "source_file", "original_text").filter("original_text is not null").withColumn("issues", T.noise_issues(F.col("original_text")))
    has = lambda n: F.count_if(F.array_contains("issues", n))
    return c.groupBy("source_file").agg(F.count(F.lit(1)).alias("chunks"), has("empty_page").alias("empty_pages"), has("broken_line_hyphen").alias("broken"), has("irregular_spacing").alias("spaced"), F.sum(F.length("original_text").cast("bigint")).alias("chars"))


_LINES = f"(SELECT chunk_id, unnest(string_split(original_text, chr(10))) AS line, generate_subscripts(string_split(original_text, chr(10)), 1) AS line_no FROM {CHUNK} WHERE original_text IS NOT NULL)"
_HEAD = "(?i)^(?:第\\d+页|Page\\s*\\d+|\\d+$|第\\d+章\\s*.*$|Chapter\\s+\\d+|目\\s*录$|Contents$|碳纤维.*丛书$|Carbon Fiber.*Series$)"


@query("header_footer_lines", f"SELECT chunk_id, line_no FROM {_LINES} WHERE length({strip('line')}) BETWEEN 3 AND 120 AND regexp_matches({strip('line')}, '{_HEAD}')")
def header_footer_lines(spark, d):
    lines = chunks(spark, d, "chunk_id", "original_text").filter("original_text is not null").select("chunk_id", F.posexplode(F.split("original_text", "\n")).alias("i", "line"))
    return lines.filter(T.is_header_footer(F.col("line"))).select("chunk_id", (F.col("i") + 1).cast("bigint").alias("line_no"))


@query("chunk_types")
def chunk_types(spark, d):
    return chunks(spark, d, "original_text", "chunk_type").filter("original_text is not null").groupBy(T.chunk_type(F.col("original_text")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("content_hash_check", f"SELECT chunk_id, substr(sha256(original_text), 1, 16) AS hash, coalesce(substr(sha256(original_text), 1, 16) = original_content_hash, false) AS same FROM {CHUNK} WHERE original_text IS NOT NULL")
def content_hash_check(spark, d):
    h = T.content_hash(F.col("original_text"))
    return chunks(spark, d, "chunk_id", "original_text", "original_content_hash").filter("original_text is not null").select("chunk_id", h.alias("hash"), F.coalesce(h == F.col("original_content_hash"), F.lit(False)).alias("same"))


_EXAM = f"trim(lower(translate(regexp_replace(trim(regexp_replace(%s, '{WS}+', ' ', 'g')), '^[0-9]+[.、．){WS[1:-1]}]+', ''), '，。；（）', ',.;()')))"


@query("exam_normalised", f"""SELECT benchmark_id, md5({_EXAM % 'question'}) AS text_hash, coalesce((SELECT string_agg(upper(coalesce(o.key, '')) || ':' || {_EXAM % "coalesce(o.text, '')"}, '|' ORDER BY o.key, o.text) FROM unnest(options) AS u(o)), '') AS option_text FROM benchmark_item WHERE question IS NOT NULL""")
def exam_normalised(spark, d):
    b = table(spark, d, "benchmark_item").filter("question is not null")
    return b.select("benchmark_id", F.md5(T.exam_text(F.col("question")).cast("binary")).alias("text_hash"), T.exam_options(F.col("options")).alias("option_text"))


@query("token_estimates", f"SELECT sample_id, CAST(floor(coalesce(length(instruction), 0) / 4) AS BIGINT) AS prompt_tokens, CAST(floor(coalesce(length(output), 0) / 4) AS BIGINT) AS answer_tokens FROM {SFT}")
def token_estimates(spark, d):
    return samples(spark, d, "sample_id", "instruction", "output").select("sample_id", T.estimate_tokens(F.col("instruction")).cast("bigint").alias("prompt_tokens"), T.estimate_tokens(F.col("output")).cast("bigint").alias("answer_tokens"))


_TERMS = " OR ".join(f"contains(lower(text), '{t.lower()}')" for t in T.DOMAIN_KEYWORDS)


@query("domain_relevance", f"SELECT doc_id, ({_TERMS}) AS relevant FROM documents WHERE text IS NOT NULL")
def domain_relevance(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", T.contains_any(F.col("text"), T.DOMAIN_KEYWORDS, True).alias("relevant"))


def _labels_sql(c: str) -> str:
    parts = ", ".join("CASE WHEN " + " OR ".join(f"contains(lower({c}), '{t}')" for t in ts) + f" THEN '{n}' END" for n, ts in T.LABELS.items())
    return f"list_filter(['domain:carbon_fiber', {parts}, CASE WHEN regexp_matches({c}, '[一-鿿]') THEN 'lang:zh' ELSE 'lang:en' END], lambda x: x IS NOT NULL)"


@query("title_labels", f"SELECT doc_id, unnest({_labels_sql('title')}) AS label FROM documents WHERE title IS NOT NULL")
def title_labels(spark, d):
    return table(spark, d, "documents").filter("title is not null").select("doc_id", F.explode(T.keyword_labels(F.col("title"))).alias("label"))


@query("title_slugs", "SELECT doc_id, CASE WHEN s = '' THEN 'kw' ELSE s END AS slug FROM (SELECT doc_id, substr(regexp_replace(replace(lower(trim(title)), ' ', '_'), '[^a-z0-9_一-龥]', '', 'g'), 1, 40) AS s FROM documents WHERE title IS NOT NULL)")
def title_slugs(spark, d):
    return table(spark, d, "documents").filter("title is not null").select("doc_id", T.slug(F.col("title")).alias("slug"))


@query("quality_averages", f"SELECT chunk_id, (quality_score.clarity + quality_score.completeness + quality_score.consistency + quality_score.feasibility + quality_score.complexity + quality_score.domain_relevance) / 6 AS average FROM {CHUNK}")
def quality_averages(spark, d):
    q = [F.col(f"quality_score.{c}") for c in ("clarity", "completeness", "consistency", "feasibility", "complexity", "domain_relevance")]
    return chunks(spark, d, "chunk_id", "quality_score").select("chunk_id", (sum(q[1:], q[0]) / 6).alias("average"))


@query("source_refs_resolvable", f"SELECT sample_id, coalesce(len(list_filter(source_refs, lambda r: regexp_matches(r, '^(data/|text_raw_data/|chunk_|exam_|img_)'))), 0) > 0 AS resolvable FROM {SFT}")
def source_refs_resolvable(spark, d):
    return samples(spark, d, "sample_id", "source_refs").select("sample_id", T.resolvable(F.col("source_refs")).alias("resolvable"))


@query("text_blocks", f"""SELECT doc_id, block_no, 'blk_' || substr(md5(concat_ws(':', CAST(doc_id AS VARCHAR), CAST(block_no AS VARCHAR), body)), 1, 12) AS block_id, length(body) AS chars FROM
(SELECT doc_id, i - 1 AS block_no, {strip('b')} AS body FROM (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS b, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)) WHERE body <> ''""")
def text_blocks(spark, d):
    b = table(spark, d, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("i", "b")).select("doc_id", F.col("i").cast("bigint").alias("block_no"), T.strip(F.col("b")).alias("body")).filter("body <> ''")
    return b.select("doc_id", "block_no", T.stable_id("blk_", F.col("doc_id").cast("string"), F.col("block_no").cast("string"), F.col("body")).alias("block_id"), F.length("body").cast("bigint").alias("chars"))


@query("overlap_chunks")
def overlap_chunks(spark, d, ):
    """Overlapping chunks of at most 600 characters, cut at sentence ends where one is near."""
    return chunking.split_overlapping(table(spark, d, "documents"), "doc_id", "text", 600, 60)


@query("stride_chunks", "SELECT doc_id, start, substr(text, CAST(start + 1 AS BIGINT), 500) AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 400)) AS start FROM documents WHERE text IS NOT NULL)")
def stride_chunks(spark, d, ):
    return chunking.fixed_stride(table(spark, d, "documents").filter("text is not null"), "doc_id", "text", 500, 400)


_WORDS = f"list_distinct(list_filter(string_split({norm('%s')}, ' '), lambda w: length(w) >= 3))"


@query("question_pairs_jaccard", f"""WITH w AS (SELECT benchmark_id AS id, unnest({_WORDS % 'question'}) AS t FROM benchmark_item WHERE question IS NOT NULL), n AS (SELECT id, count(*) AS n FROM w GROUP BY id),
p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM w a JOIN w b ON a.t = b.t AND a.id < b.id GROUP BY ALL)
SELECT id_a, id_b, k / (x.n + y.n - k) AS similarity FROM p JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE k / (x.n + y.n - k) >= 0.6""")
def question_pairs_jaccard(spark, d):
    return dedup_words(table(spark, d, "benchmark_item").filter("question is not null").select(F.col("benchmark_id").alias("id"), T.word_set(F.col("question")).alias("words")), 0.6)


def dedup_words(sets, least: float):
    """(id_a, id_b, similarity) of all pairs of word sets with Jaccard ``least`` or more, by a prefix filter over falling rarity.

    Two such sets share one of their first |x| - ceil(least * |x|) + 1 words in a common order, so only these are joined; the counts that
    give the order are an aggregate, and equal prefixes' pairs are verified once by the whole sets.
    """
    words = sets.select("id", F.explode("words").alias("w"))
    rare = words.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    ordered = words.join(rare, "w").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "w"))).alias("s"))  # one row's own words
    cut = ordered.withColumn("n", F.size("s")).select("id", "n", F.slice("s", 1, F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1).alias("p"), F.transform("s", lambda x: x["w"]).alias("words"))
    keys = cut.filter("n > 0").select("id", "n", F.explode(F.transform("p", lambda x: x["w"])).alias("w"))
    near = keys.alias("x").join(keys.alias("y"), "w").filter("x.id < y.id").filter(f"least(x.n, y.n) >= {least} * greatest(x.n, y.n) - 1e-9").select(F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b")).distinct()
    whole = cut.select("id", "words")
    both = near.join(whole.withColumnsRenamed({"id": "id_a", "words": "wa"}), "id_a").join(whole.withColumnsRenamed({"id": "id_b", "words": "wb"}), "id_b")
    return both.select("id_a", "id_b", T.jaccard(F.col("wa"), F.col("wb")).alias("similarity")).filter(F.col("similarity") >= least)


@query("sign_code_pairs", """WITH c AS (SELECT vec_id, list_transform(embedding[1:64], lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings)
SELECT a, b, distance FROM (SELECT x.vec_id AS a, y.vec_id AS b, list_sum(list_transform(list_zip(x.b, y.b), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END))::BIGINT AS distance FROM c x JOIN c y ON x.vec_id < y.vec_id) WHERE distance <= 18""")
def sign_code_pairs(spark, d):
    codes = table(spark, d, "embeddings").select("vec_id", similarity.sign_code(F.col("embedding")).alias("code"))
    return similarity.hamming_pairs(codes, "vec_id", "code", 18)


@query("nearest_vectors")
def nearest_vectors(spark, d):
    """Five nearest by cosine of every vector whose id is divisible by 100, among all."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    return similarity.stated_queries_topk(v, v.filter("vec_id % 100 = 0"), "vec_id", "embedding", 5)


@query("fuzzy_band_pairs")
def fuzzy_band_pairs(spark, d):
    """Benchmark questions whose neighbours within 50 places are alike by string ratio above 0.9."""
    b = table(spark, d, "benchmark_item").filter("question is not null").select("ordinal", "benchmark_id", T.normalize_text(F.col("question")).alias("q"))
    bucket = b.withColumn("cell", F.expr("ordinal div 50"))
    right = bucket.withColumn("near", F.explode(F.array(F.col("cell"), F.col("cell") - 1)))
    pairs = bucket.alias("x").join(right.alias("y"), F.col("x.cell") == F.col("y.near")).filter("y.ordinal > x.ordinal and y.ordinal < x.ordinal + 50").filter(similarity.ratio_bound(F.col("x.q"), F.col("y.q")) > 0.9)
    return pairs.select(F.col("x.benchmark_id").alias("id_a"), F.col("y.benchmark_id").alias("id_b"), similarity.fuzzy_ratio(F.col("x.q"), F.col("y.q")).alias("ratio")).filter("ratio > 0.9")


@query("similar_groups")
def similar_groups(spark, d):
    """Leaders and members of near-equal codes: greedy in order of id."""
    codes = table(spark, d, "embeddings").select("vec_id", similarity.sign_code(F.col("embedding")).alias("code"))
    return dedup.code_leaders(Stage(spark, "groups"), codes, "vec_id", "code", 16)
