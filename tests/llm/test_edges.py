"""Every query on empty tables, on rows that are null but for their keys, and on tables with more columns."""

import os

import pytest
from pyspark.sql import functions as F

from plinth.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ["sft_sample", "cleaned_chunk", "benchmark_item", "evaluation_result", "documents", "doc_label", "split_target", "sample_target", "container_spec", "mix_target", "common_word"]
CLASHES = ["key", "size", "h", "rec", "id", "label", "sig", "kind", "title", "known", "curve", "level", "n", "rn", "stage"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def variants(spark, tmp_path_factory):
    out = {}
    for name in ("empty", "nulls", "clashing"):
        at = tmp_path_factory.mktemp(name)
        for t in TABLES:
            df = spark.read.parquet(f"{SF}/{t}.parquet")
            if name == "empty":
                df = df.limit(0)
            elif name == "nulls":
                null = df.limit(6).select(*[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns])
                keyed = df.limit(6).select(*[F.col(c) if c in ("sample_id", "chunk_id", "benchmark_id", "doc_id", "model_name", "ordinal") else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns])
                df = null.unionByName(keyed).unionByName(keyed)
            else:
                df = df.withColumns({c: F.lit(f"clash {c}") for c in CLASHES if c not in df.columns})
            df.write.parquet(f"{at}/{t}.parquet")
        out[name] = str(at)
    return out


@pytest.mark.parametrize("query", sorted(QUERIES))
def test_empty(spark, variants, query):
    rows = QUERIES[query](spark, variants["empty"]).collect()
    assert not [r for r in rows if any(isinstance(v, (int, float)) and v for v in r)]


@pytest.mark.parametrize("query", sorted(q for q in QUERIES if q.endswith("_found")))
def test_nulls(spark, variants, query):
    rows = QUERIES[query](spark, variants["nulls"]).collect()
    want = {"p6_found": {"empty_answer"}, "p10_found": {"junk"}}.get(query)
    if want:
        assert {r[-1] for r in rows} == want and all(v is not None for r in rows for v in r)
    else:
        assert rows == []


@pytest.mark.parametrize("query", sorted(q for q in QUERIES if q.endswith("_found")))
def test_more_columns(spark, variants, query):
    assert sorted(QUERIES[query](spark, variants["clashing"]).collect()) == sorted(QUERIES[query](spark, SF).collect())
