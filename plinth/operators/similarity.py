"""Similarity joins on vectors and codes, and string similarity."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two strings; order matters, null counts as empty."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def ratio_bound(a: Column, b: Column) -> Column:
    """Upper bound of the ratio by lengths: prunes pairs before the UDF."""
    return F.try_divide(2.0 * F.least(F.length(a), F.length(b)), F.length(a) + F.length(b))


def sign_code(v: Column) -> Column:
    """64-bit code of the signs of the first 64 components."""
    bits = F.transform(F.slice(v, 1, 64), lambda x: F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b))


def hamming_pairs(df: DataFrame, key: str, code: str, most: int = 8) -> DataFrame:
    """(a, b, distance) of all pairs of distinct keys, a < b, with at most ``most`` differing bits of 64, equal codes (distance 0) included.

    The code is cut into most + 1 bands, of which one at least is equal in such a pair; pairs are reported by their first equal
    band. Codes are compared once, whatever the number of their rows; ``code_classes`` has them with their members, where copies need not be expanded into pairs.
    """
    bands = most + 1
    edges = [i * 64 // bands for i in range(bands + 1)]
    cut = [F.struct(F.lit(i).alias("i"), F.shiftrightunsigned(F.col("code"), lo).bitwiseAND(F.lit((1 << min(hi - lo, 63)) - 1)).alias("v")) for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))]
    codes = df.select(F.col(code).alias("code")).filter("code is not null").distinct()
    long = codes.select("code", F.array(*cut).alias("bands")).select("code", "bands", F.posexplode("bands").alias("band", "key"))
    x = long.select(F.col("code").alias("x"), "bands", "band", "key.v")
    y = long.select(F.col("code").alias("y"), F.col("bands").alias("other"), "band", "key.v")
    first = F.array_position(F.zip_with("bands", "other", lambda p, q: p["v"] == q["v"]), True) == F.col("band") + 1
    near = x.join(y, ["band", "v"]).filter("x < y").filter(first).withColumn("distance", F.bit_count(F.col("x").bitwiseXOR(F.col("y"))).cast("bigint")).filter(F.col("distance") <= most)
    m = df.select(F.col(key).alias("k"), F.col(code).alias("code"))
    across = near.join(m.withColumnsRenamed({"k": "a", "code": "x"}), "x").join(m.withColumnsRenamed({"k": "b", "code": "y"}), "y").select("a", "b", "distance")
    m = m.filter("code is not null")
    inside = m.withColumnRenamed("k", "a").join(m.withColumnRenamed("k", "b"), "code").filter("a < b").select("a", "b", F.lit(0).cast("bigint").alias("distance"))
    return across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance").unionByName(inside).distinct()


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def stated_queries_topk(base: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query, key, cosine, place): k nearest of a stated query set against all rows.

    The query set is collected in blocks of at most 1000 vectors, so each pass over the base is a scan without a
    shuffle of vectors; only k rows per query and partition are shuffled.
    """
    import numpy as np

    rows = queries.select(key, vector).orderBy(key).collect()
    ids, out = [r[0] for r in rows], None
    for lo in range(0, max(1, len(rows)), 1000):
        block = rows[lo : lo + 1000]
        q = np.array([r[1] for r in block], np.float64).reshape(len(block), -1)
        held = base.sparkSession.sparkContext.broadcast((ids[lo : lo + 1000], q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-30) if len(block) else q))

        def run(frames, held=held):
            names, unit = held.value
            for f in frames:
                if not len(f) or not len(names):
                    continue
                v = np.stack(f[vector].to_numpy()).astype(np.float64)
                sim = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)) @ unit.T
                keep = np.argpartition(-sim, min(k, len(v) - 1), axis=0)[: k + 1]
                for j, name in enumerate(names):
                    i = keep[:, j]
                    yield pd.DataFrame({"query": name, key: f[key].to_numpy()[i], "cosine": sim[i, j]})

        kind = dict(base.dtypes)[key]
        part = base.select(key, vector).filter(F.col(vector).isNotNull()).mapInPandas(run, f"query {kind}, {key} {kind}, cosine double")
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), key)
    return out.filter(F.col("query") != F.col(key)).withColumn("place", F.row_number().over(w).cast("bigint")).filter(F.col("place") <= k)


def tfidf_best(base: DataFrame, queries: DataFrame, key: str, text: str, least: float, n: int = 4) -> DataFrame:
    """(query, key, similarity): best row by cosine of smooth TF-IDF over character n-grams, where it reaches ``least``."""
    grams = lambda df, name: df.select(F.col(key).alias(name), F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substr(F.col(text), i, F.lit(n)))).alias("g")).groupBy(name, "g").agg(F.count(F.lit(1)).alias("tf"))
    b = grams(base.filter(F.col(text).isNotNull()), "doc")
    total = base.count()
    df_ = b.groupBy("g").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log((1 + total) / (1 + F.col("df"))) + 1)
    wb = b.join(df_, "g").select("doc", "g", (F.col("tf") * F.col("idf")).alias("w"), "df")
    wq = grams(queries.filter(F.col(text).isNotNull()), "query").join(df_, "g").select("query", "g", (F.col("tf") * F.col("idf")).alias("wq"))
    norm_b, norm_q = wb.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("nb")), wq.groupBy("query").agg(F.sqrt(F.sum(F.col("wq") ** 2)).alias("nq"))
    sims = wq.join(wb, "g").filter("query <> doc").groupBy("query", "doc").agg(F.sum(F.col("w") * F.col("wq")).alias("s")).join(norm_b, "doc").join(norm_q, "query").withColumn("similarity", F.col("s") / (F.col("nb") * F.col("nq")))
    return sims.filter(F.col("similarity") >= least).groupBy("query").agg(F.max_by(F.struct(F.col("doc").alias(key), "similarity"), F.struct("similarity", F.expr("-doc"))).alias("r")).select("query", f"r.{key}", "r.similarity")
