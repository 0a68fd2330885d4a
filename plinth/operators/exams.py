"""Exam questions: one survivor per text."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def survivors(df: DataFrame, key: str, order: str, text: str, options: str) -> DataFrame:
    """(key, status, n): one question of each text. Among equal texts the best moves on from the first to each one whose options are less than 0.8 alike, as published.

    Only texts that occur with two or more different options need the ordered fold; equal (text, options) rows are one, so what is
    folded per text is its distinct options. Null texts form one group.
    """
    rows = df.select(F.col(key).alias("k"), F.col(order).alias("o"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("h"), F.coalesce(F.col(options), F.lit("")).alias("opts"))
    per = rows.groupBy("h", "opts").agg(F.min(F.struct("o", "k")).alias("first"), F.count(F.lit(1)).alias("n"))
    texts = per.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n"))
    kind = dict(rows.dtypes)

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        best = None
        for r in f.sort_values("o").itertuples():
            if best is None or difflib.SequenceMatcher(None, best.opts, r.opts).ratio() <= 0.8:
                best = r
        return pd.DataFrame({"h": [best.h], "k": [best.k]})

    flat = per.select("h", "opts", F.col("first.o").alias("o"), F.col("first.k").alias("k"))
    plain = flat.join(texts.filter("kinds = 1").select("h"), "h", "left_semi").select("h", "k")
    mixed = flat.join(texts.filter("kinds > 1").select("h"), "h", "left_semi").groupBy("h").applyInPandas(fold, f"h string, k {kind['k']}")
    out = plain.unionByName(mixed).join(texts, "h")
    return out.select(F.col("k").alias(key), F.when(F.col("n") == 1, "unique").otherwise("unique_after_dedup").alias("status"), "n")
