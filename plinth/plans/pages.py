"""Pages of links and files: parsing, inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.functions import text as T
from plinth.plans.registry import query
from plinth.runtime import table


@query("file_inventory", "SELECT doc_id, greatest(1, n_chars // 100) AS pages, CASE WHEN page_count IS NULL THEN 'high' WHEN page_count > 3 THEN 'medium' ELSE 'low' END AS risk, len(regexp_extract_all(title, '[一-鿿]')) > 2 AS chinese_name FROM documents WHERE n_chars IS NOT NULL AND title IS NOT NULL")
def file_inventory(spark, d):
    docs = table(spark, d, "documents").filter("n_chars is not null and title is not null")
    return docs.select("doc_id", F.greatest(F.lit(1).cast("bigint"), F.expr("cast(n_chars as bigint) div 100")).alias("pages"), F.when(F.col("page_count").isNull(), "high").when(F.col("page_count") > 3, "medium").otherwise("low").alias("risk"), (F.regexp_count("title", F.lit("[一-鿿]")) > 2).alias("chinese_name"))


@query("source_files", "SELECT DISTINCT lower(regexp_replace(source_file, '\\.clean\\.json$', '')) AS stem, source_folder FROM cleaned_chunk WHERE source_file IS NOT NULL")
def source_files(spark, d):
    return table(spark, d, "cleaned_chunk").filter("source_file is not null").select(F.lower(F.regexp_replace("source_file", r"\.clean\.json$", "")).alias("stem"), "source_folder").distinct()


@query("page_index", "SELECT chunk_id, unnest(page_numbers) AS page FROM (SELECT * FROM cleaned_chunk QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ordinal) = 1)")
def page_index(spark, d):
    from plinth.plans.texts import chunks

    return chunks(spark, d, "chunk_id", "page_numbers").select("chunk_id", F.explode("page_numbers").alias("page"))


@query("keyword_products", "SELECT DISTINCT lower(trim(r.r_name || ' ' || n.n_name || ' ' || m.seg)) AS keyword FROM region r, nation n, (SELECT DISTINCT c_mktsegment AS seg FROM customer) m")
def keyword_products(spark, d):
    """Distinct phrases of three small vocabularies (5, 25 and 5 words in these tables, checked to stay small)."""
    a = table(spark, d, "region").select("r_name")
    words = [sorted(r[0] for r in df.distinct().limit(1001).collect()) for df in (a, table(spark, d, "nation").select("n_name"), table(spark, d, "customer").select("c_mktsegment"))]
    if max(map(len, words)) > 1000:
        raise ValueError("a vocabulary has more than 1000 words")
    rows = a.select("r_name", F.explode(F.array(*[F.lit(w) for w in words[1]])).alias("n")).select("r_name", "n", F.explode(F.array(*[F.lit(w) for w in words[2]])).alias("m"))
    return rows.select(T.normalize_text(F.concat_ws(" ", "r_name", "n", "m")).alias("keyword")).distinct()
