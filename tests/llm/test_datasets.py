import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plinth.llm import containers, mixture, quotas, splits
from plinth.runtime import Stage


def brute_sets(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for rec, group, refs in rows:
        g = (group or "").strip().lower()
        keys = [("g", g)] if g not in splits.PLACEHOLDERS else []
        for r in refs or []:
            s = (r or "").strip().lower()
            if s not in splits.PLACEHOLDERS:
                keys.append(("s", s.replace("\\", "/").split("#")[0].split("/")[-1].strip()))
        find(("r", rec))
        for k in keys:
            parent[find(k)] = find(("r", rec))
    out = defaultdict(set)
    for rec, _, _ in rows:
        out[find(("r", rec))].add(rec)
    return {frozenset(v) for v in out.values() if len(v) > 1}


def test_linked_sets_match_union_find(spark):
    rnd = random.Random(4)
    name = lambda: rnd.choice(["books/a%d.json", "A%d.JSON ", ".\\x\\a%d.json#p3", "data/books/a%d.json#page=9"]) % rnd.randrange(150)
    rows = [(f"r{i}", rnd.choice([None, "unknown", " ", "N/A", "hot", " HOT", f"g{rnd.randrange(80)}"]), rnd.choice([None, [], [None, "n/a"], [name()], [name(), name()]])) for i in range(300)]
    df = spark.createDataFrame([(*r, "x") for r in rows] + [(*rows[0], "late")], "id string, grp string, refs array<string>, rec string")
    got = splits.linked_records(df, "id", "grp", "refs", Stage(spark, "t"), {}).distinct().toPandas()
    sets = defaultdict(set)
    for r in got.itertuples():
        if r.set_id == r.set_id:
            sets[r.set_id].add(r.rec)
    assert {frozenset(v) for v in sets.values() if len(v) > 1} == brute_sets(rows)


def test_long_chain_settles(spark):
    links = spark.range(1000).select(F.xxhash64("id").alias("ent"), F.xxhash64(F.col("id") + 1).alias("top"))
    assert splits.components(Stage(spark, "t"), links).select("label").distinct().count() == 1


def test_groups_stay_whole_and_near_targets(spark):
    groups = spark.range(3000).select(F.col("id").alias("set_id"), F.when(F.col("id") == 0, 900).otherwise(1 + F.col("id") % 3).cast("bigint").alias("n")).withColumn("easy", F.expr("n div 2"))
    got = splits.assign(Stage(spark, "t"), groups, [("train", 80), ("validation", 10), ("test", 10)], ["easy"])
    assert got.count() == 3000 and got.select("set_id").distinct().count() == 3000
    n = {r["new_split"]: r["n"] for r in got.join(groups, "set_id").groupBy("new_split").agg(F.sum("n").alias("n")).collect()}
    total = sum(n.values())
    assert abs(n["train"] / total - 0.8) < 0.01 and abs(n["test"] / total - 0.1) < 0.01


def test_split_names(spark):
    df = spark.createDataFrame([(" VAL",), ("Train ",), ("other",), (None,)], "s string")
    assert [r[0] for r in df.select(splits.split_name(F.col("s"))).collect()] == ["validation", "train", None, None]


def test_empty_sft(spark):
    df = spark.createDataFrame([], "id string, grp string, refs array<string>")
    assert splits.linked_records(df, "id", "grp", "refs", Stage(spark, "t"), {}).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 500), st.lists(st.tuples(st.integers(0, 50), st.integers(0, 60)), max_size=8))
def test_pour(amount, rooms):
    rooms = [(f"c{i}", w, r) for i, (w, r) in enumerate(rooms)]
    got = quotas.pour(amount, rooms)
    assert all(got[n] <= r for n, _, r in rooms) and sum(got.values()) == min(amount, sum(r for _, w, r in rooms if w))


def test_siblings_before_cousins():
    t = [dict(category=c, target_pct=p, min_records=0, available=a) for c, p, a in (("easy", 50, 100), ("medium", 20, 100), ("hard", 30, 10))]
    got = {r["category"]: r for r in quotas.allocate(100, t, {"usual": ["easy", "medium"], "demanding": ["hard"]})}
    assert got["hard"]["quota"] == 10 and got["easy"]["from_cousins"] + got["medium"]["from_cousins"] == 20 and sum(r["quota"] for r in got.values()) == 100


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=80), st.integers(5, 100))
def test_packing_keeps_everything(sizes, capacity):
    p = containers.Packer("c", capacity, 0)
    rows = p.pack(list(range(len(sizes))), sizes)
    per, held = Counter(), defaultdict(int)
    for _, c, k, piece, at, n in rows:
        held[c] += n
        per[k] += n
        assert n <= capacity
    assert all(v <= capacity for v in held.values()) and [per[i] for i in range(len(sizes))] == sizes
    pieces = Counter(r[2] for r in rows)
    assert all((pieces[i] > 1) == (s > capacity) for i, s in enumerate(sizes))


def test_hilbert_neighbours():
    import numpy as np

    x = np.array([(a, b) for a in range(16) for b in range(16)])
    order = x[np.argsort(containers.hilbert_key(x, 4))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all() and len(np.unique(containers.hilbert_key(x, 4))) == 256


def test_pack_documents(spark):
    docs = spark.createDataFrame([(1, "a" * 50), (2, None), (3, ""), (4, "碳" * 100), (5, "a" * 50)], "doc_id bigint, text string").withColumn("size", F.lit("clash"))
    spec = spark.createDataFrame([("small", 64), ("bad", None)], "container_name string, capacity_tokens int")
    rows = containers.pack(spark, docs, "doc_id", "text", spec).collect()
    assert Counter(r["doc_id"] for r in rows) == {1: 1, 2: 1, 3: 1, 4: 5, 5: 1} and {r["container_name"] for r in rows} == {"small"}
    assert containers.pack(spark, docs.limit(0), "doc_id", "text", spec).count() == 0


def test_long_text_is_projected_in_slices(spark, monkeypatch):
    text = "".join(random.Random(1).choice("abcdef ") for _ in range(5000))
    docs = spark.createDataFrame([(1, text), (2, "x"), (3, None)], "doc_id bigint, text string")
    import numpy as np
    import pyarrow as pa

    def keys(size):
        monkeypatch.setattr(containers, "SLICE", size)
        b = pa.array([text, "x", "", "yz"]).cast(pa.large_binary()).buffers()
        return containers.curve_keys(np.frombuffer(b[2], np.uint8), np.frombuffer(b[1], np.int64, 5), containers.projection()).tolist()

    assert keys(64) == keys(1 << 20) and docs.count() == 3


def test_sainte_lague():
    seats = mixture.sainte_lague({"a": 53, "b": 24, "c": 23}, {"a": 99, "b": 99, "c": 99}, 7)
    assert Counter(seats) == {"a": 3, "b": 2, "c": 2}
    assert Counter(mixture.sainte_lague({"a": 50, "b": 50}, {"a": 1, "b": 9}, 6)) == {"a": 1, "b": 5}
    assert mixture.sainte_lague({}, {}, 5) == []


def test_each_copy_has_the_shard_it_begins_in(spark):
    """Shard quotas are met up to one document, also for a source that is repeated."""
    docs = spark.createDataFrame([(i, "small" if i < 30 else "large", 10 + i % 7) for i in range(400)], "doc_id bigint, key string, size bigint")
    sums = {r["key"]: r["n"] for r in docs.groupBy("key").agg(F.sum("size").alias("n")).collect()}
    block, seats = 40, mixture.sainte_lague({"S": 50, "L": 50}, {"S": 24, "L": 100}, 48)
    rows = [{"source_name": n, "key": k, "size": sums[k], "quota": min(seats.count(n) * block, 3 * sums[k])} for n, k in (("S", "small"), ("L", "large"))]
    got = mixture.mix(spark, rows, seats, block, docs).collect()
    per, quota = defaultdict(int), Counter()
    for r in got:
        per[r["source_name"], r["shard"]] += r["size"]
    for i, s in enumerate(seats):
        quota[s, i // -(-len(seats) // mixture.SHARDS)] += block
    assert all(abs(per[k] - n) <= 2 * 17 for k, n in quota.items()) and set(per) <= set(quota)
    copies = Counter((r["source_name"], r["doc_id"]) for r in got)
    assert max(copies.values()) <= 3 and len({(r["source_name"], r["doc_id"], r["copy_no"]) for r in got}) == len(got)
    assert {r["copy_no"] for r in got if r["source_name"] == "S"} == {1, 2, 3}


def test_every_split_gets_its_share(spark):
    """As many splits as the target table has, more than a hundred, too."""
    groups = spark.range(20_000).select(F.col("id").alias("set_id"), (1 + F.col("id") % 3).cast("bigint").alias("n"))
    got = splits.assign(Stage(spark, "t"), groups, [(f"s{i:03d}", 1) for i in range(120)], [])
    n = [r["n"] for r in got.join(groups, "set_id").groupBy("new_split").agg(F.sum("n").alias("n")).collect()]
    assert len(n) == 120 and sum(n) == 39_999 and max(n) - min(n) <= 40


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_queries_on_the_small_tables(spark, sf):
    import os

    if not os.path.isdir(sf):
        pytest.skip("no test data")
    shares = {r["source_name"]: r for r in mixture.p9_shares(spark, sf).collect()}
    assert all(r["short"] or abs(r["mixed"] - r["quota"]) < 20_000 for r in shares.values())
    assert quotas.p5_sample(spark, sf).groupBy("field_name", "sample_id").count().filter("count > 1").count() == 0
