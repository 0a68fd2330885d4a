import random
import re

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plinth.operators import components, dedup, graph, mapping, ranking, sampling, similarity, splitting, statistics
from plinth.plans.texts import dedup_words
from plinth.runtime import Stage


def test_exact_groups_and_resolution(spark):
    df = spark.createDataFrame([(0, "Q"), (1, "q"), (2, "r"), (3, "R"), (4, None), (5, None)], "id bigint, t string")
    assert sorted((r["keeper"], r["n"]) for r in dedup.exact_groups(df, "id", F.lower("t")).collect()) == [(0, 2), (2, 2)]
    got = {r["id"]: r["action"] for r in dedup.resolution(df, "id", F.lower("t")).collect()}
    assert got == {0: "keep", 1: "remove", 2: "keep", 3: "remove", 4: "keep", 5: "keep"}


def test_first_and_last_win(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), (None, 3, "z"), (None, 4, "w")], "k string, o int, v string")
    assert sorted(dedup.first_wins(df, ["k"], "o").collect(), key=str) == sorted(dedup.first_wins(df.filter("o in (1, 3)"), ["k"], "o").collect(), key=str)
    assert {(r["k"], r["v"]) for r in dedup.first_wins(df, ["k"], "o", last=True).collect()} == {("a", None), (None, "w")}


def test_ranks_over_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), "id", (F.col("id") % 7).alias("size"), F.xxhash64("id").alias("h"))
    got = ranking.bucketed_rank(df, ["g"], "h", ["id"], F.col("size"), 16).toPandas()
    for _, f in got.groupby("g"):
        f = f.sort_values("rank_no")
        assert f["rank_no"].tolist() == list(range(1, len(f) + 1))
        assert f["size_before"].tolist() == ([0] + f["size"].cumsum().tolist())[:-1]


def test_ordered_rank(spark):
    df = spark.range(1000).select((F.lit(1000) - F.col("id")).alias("v"))
    assert sampling.ordered_rank(Stage(spark, "t"), df, ["v"], "n").filter("n <> v").count() == 0


def test_batches_and_budget(spark):
    df = spark.createDataFrame([("a", i, n) for i, n in enumerate([3, 4, 5, 20, 1])], "g string, o bigint, n bigint")
    assert [r["batch"] for r in sampling.size_batches(df, "g", "o", "n", 8).orderBy("o").collect()] == [0, 0, 1, 2, 3]
    assert [r["o"] for r in sampling.budget_prefix(Stage(spark, "t"), df, ["g"], [F.col("o")], ["n"], F.col("n"), 12).orderBy("o").collect()] == [0, 1, 2]


def test_range_ranks_over_a_hot_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("g"), F.col("id") % 20)).alias("g"), "id", (F.col("id") % 5).alias("v"), (F.col("id") % 7).alias("size"))
    got = ranking.range_rank(Stage(spark, "t"), df, ["g"], [F.desc("v")], ["id"], F.col("size")).toPandas()
    assert len(got) == 3000
    for _, f in got.groupby("g", dropna=False):
        f = f.sort_values(["v", "id"], ascending=[False, True])
        assert f["rank_no"].tolist() == list(range(1, len(f) + 1))
        assert f["size_before"].tolist() == ([0] + f["size"].cumsum().tolist())[:-1]


def test_hamming_matches_brute_force(spark):
    rnd = random.Random(1)
    base = [rnd.getrandbits(64) for _ in range(20)]
    codes = base + [b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 10))) for b in base for _ in range(5)]
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = spark.createDataFrame(list(enumerate(signed)), "id bigint, code bigint")
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if (codes[i] ^ codes[j]).bit_count() <= 8}
    got = similarity.hamming_pairs(df, "id", "code", 8).collect()
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)


def test_equal_codes_are_grouped(spark):
    """Copies of a code with no other near one, copies of a member and a row without a code."""
    far = 0x0F0F0F0F0F0F0F0F
    df = spark.createDataFrame([(1, far), (2, 0), (3, far), (4, 1), (5, 1), (6, 0), (7, -1), (8, None)], "id bigint, code bigint")
    groups = {r["id"]: r["label"] for r in dedup.code_groups(Stage(spark, "t"), df, "id", "code", 8).collect()}
    assert groups == {1: 1, 2: 2, 3: 1, 4: 2, 5: 2, 6: 2, 7: 7, 8: 8}
    assert {tuple(r) for r in dedup.code_leaders(Stage(spark, "t"), df, "id", "code", 8).collect()} == {(1, 3), (2, 4), (2, 5), (2, 6)}


def test_jaccard_matches_brute_force(spark):
    rnd = random.Random(2)
    sets = [rnd.sample(range(30), rnd.randint(1, 12)) for _ in range(80)]
    df = spark.createDataFrame([(i, [f"w{x}" for x in s]) for i, s in enumerate(sets)], "id bigint, words array<string>")
    want = {(i, j) for i in range(80) for j in range(i + 1, 80) if len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j])) >= 0.5}
    assert {(r["id_a"], r["id_b"]) for r in dedup_words(df, 0.5).collect()} == want


def test_components(spark):
    chain = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(100, 101), (7, 7)], "a bigint, b bigint"))
    got = {r["node"]: r["label"] for r in components.connected(Stage(spark, "t"), chain, "a", "b").collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and len(got) == 43


def test_leaders(spark):
    rnd = random.Random(7)
    edges = {tuple(sorted(rnd.sample(range(60), 2))) for _ in range(90)} | {(100, 101), (101, 102)}
    want, taken = set(), set()
    for i in sorted({x for e in edges for x in e}):
        if i not in taken:
            for j in sorted(y for x, y in edges if x == i):
                if j not in taken:
                    taken.add(j)
                    want.add((i, j))
    got = dedup.leaders(Stage(spark, "t"), spark.createDataFrame(sorted(edges), "a bigint, b bigint"), "a", "b")
    assert {tuple(r) for r in got.collect()} == want


def test_graph_scores_and_levels(spark):
    assert round(spark.range(1).select(graph.edge_weight(relevance=F.lit(1.0), trust=F.lit(0.5))).first()[0], 6) == round(1 / (1 + 2.718281828459045 ** -1.2), 6)
    steps = spark.createDataFrame([(i,) for i in range(7)], "step bigint")
    needs = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 2), (5, 4), (6, 3)], "step bigint, need bigint")
    assert {r["step"]: r["level"] for r in graph.levels(Stage(spark, "t"), steps, needs).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 4, 6: 4}
    cycle = needs.union(spark.createDataFrame([(0, 6)], "step bigint, need bigint"))
    assert all(r["level"] is None for r in graph.levels(Stage(spark, "t"), steps, cycle).collect())


def test_greedy_redundancy(spark):
    rows = [("s", "a", "same_name", "task", 0.9, 300), ("s", "b", "same_name", "task", 0.8, 300), ("s", "c", "other", "tool", 0.7, 150)]
    df = spark.createDataFrame(rows, "start string, node string, name string, kind string, score double, tokens bigint")
    assert [r["node"] for r in graph.greedy_select(df, 8000).orderBy("place").collect()] == ["a", "c"]
    assert [r["node"] for r in graph.greedy_select(df, 400).orderBy("place").collect()] == ["a"]

def test_two_hops_by_classes_of_starts(spark):
    rnd = random.Random(3)
    pairs = [(f"s{i}", "hub") for i in range(300)] + [(f"c{i}", "hub") for i in range(700)] + [(f"s{rnd.randrange(320)}", f"m{rnd.randrange(8)}") for _ in range(60)] + [("s1", "s1"), ("s2", "s3")]
    near = graph.undirected(spark.createDataFrame(pairs, "source_id string, target_id string"))
    start = spark.createDataFrame([(f"s{i}",) for i in [*range(320), 1, 1]], "start string")
    of: dict = {}
    for x, y in pairs:
        if x != y:
            of.setdefault(x, set()).add(y)
            of.setdefault(y, set()).add(x)
    want = {}
    for s in {f"s{i}" for i in range(320)} & of.keys():
        want |= {(s, z): 2 for y in of[s] for z in of[y]} | {(s, y): 1 for y in of[s]}
        want.pop((s, s), None)
    got = graph.within_two_hops(near, start).collect()
    assert len(got) == len(want) and {(r["start"], r["node"]): r["hops"] for r in got} == want
    # starts that have only the hub are one class, and its second hop is joined once
    one, same, second = graph.reach(near, start)
    classes = len({frozenset(of[s]) for s, _ in want})
    assert same.select("same").distinct().count() == classes and second.count() <= classes * 1008 < len(want)
    few = graph.spread(same, second, 7)
    assert sorted((r["start"], r["node"]) for r in few.collect()) == sorted(k for k, h in want.items() if h == 2)


def test_scores_of_the_second_hop_are_those_of_its_class(spark, tmp_path):
    from plinth.plans import graphs

    put = lambda name, rows, cols: spark.createDataFrame(rows, cols).write.parquet(f"{tmp_path}/{name}.parquet")
    put("customer", [(i, i % 3) for i in range(200)], "c_custkey bigint, c_nationkey int")
    put("supplier", [(i, i % 3) for i in range(90)], "s_suppkey bigint, s_nationkey int")
    put("nation", [(i, i % 2) for i in range(3)], "n_nationkey int, n_regionkey int")
    e, near = graphs.edges(spark, str(tmp_path)), graphs.two_hops(spark, str(tmp_path))
    quality = e.groupBy(F.col("source_id").alias("node")).agg(F.max(F.col("k") % 3 / 3).alias("quality"))
    want = graph.candidate_scores(near.join(quality, "node", "left"), e).select("start", "node", "hops", "score")
    got = graphs.candidate_scores(spark, str(tmp_path))
    assert got.count() == want.count() == near.count() and got.exceptAll(want).count() == 0
    # a score per class and node of the second hop, not per start
    assert graphs.scored(spark, str(tmp_path))[2].count() <= 3 * 99


def test_spread_is_dealt_evenly_and_row_by_row(spark):
    same = spark.createDataFrame([(f"s{i}", "s0") for i in range(50)], "start string, same string")
    rows = spark.createDataFrame([("s0", f"s{i}" if i < 50 else f"c{i}", i / 7) for i in range(200)], "same string, node string, score double")
    out = graph.spread(same, rows, 10)
    want = {(f"s{i}", f"s{k}" if k < 50 else f"c{k}", k / 7) for i in range(50) for k in range(200) if i != k}
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # units are not put together into a few tasks, and no generated loop holds all pairs of a unit
    assert "REPARTITION_BY_NUM" in plan
    assert re.search(r"\*\(\d+\) Generate inline", plan) and not re.search(r"\*\(\d+\) Generate explode", plan)


def test_packages_come_from_shared_candidates(spark, tmp_path):
    from plinth.plans import graphs

    put = lambda name, rows, cols: spark.createDataFrame(rows, cols).write.parquet(f"{tmp_path}/{name}.parquet")
    put("customer", [(i, i % 3) for i in range(40)], "c_custkey bigint, c_nationkey int")
    put("supplier", [(i, i % 3) for i in range(12)], "s_suppkey bigint, s_nationkey int")
    put("nation", [(i, i % 2) for i in range(3)], "n_nationkey int, n_regionkey int")
    kind = F.when(F.col("node").startswith("n"), "task").when(F.col("node").startswith("r"), "constraint").otherwise("artifact")
    whole = graphs.candidate_scores(spark, str(tmp_path)).withColumn("kind", kind).withColumn("name", F.concat_ws(" ", "kind", "node")).withColumn("tokens", graph.node_tokens(F.col("kind")).cast("bigint"))
    want: dict = {}
    for r in graph.greedy_select(whole, 4000).collect():
        k = {"n": "task", "r": "constraint"}.get(r["node"][0], "artifact")
        want.setdefault(r["start"], {}).setdefault(k, []).append(r["node"])
    packages = graphs.context_packages(spark, str(tmp_path))
    got = {r["start"]: {k: r[k].split() for k in ("artifact", "constraint", "task") if r[k]} for r in packages.collect()}
    assert len(got) == 12 and got == {s: {k: sorted(v) for k, v in kinds.items()} for s, kinds in want.items()}
    # a class's candidates meet its starts by block, not each start by itself
    assert "CoGroups" in packages._jdf.queryExecution().executedPlan().toString()


def test_shared_selection_is_that_of_each_start(spark):
    rnd = random.Random(5)
    kinds = ["task", "tool", "artifact", "constraint"]
    shared = [("s0", f"s{i}" if i < 40 else f"n{i}", f"{rnd.choice('abcde')} {rnd.choice('vwxyz')}", rnd.choice(kinds), rnd.choice([0.2, 0.5, 0.7, None]), rnd.choice([150, 400, 700])) for i in range(1500)]
    own = [(f"s{i}", f"m{k}", f"own {k}", rnd.choice(kinds), rnd.random(), 200) for i in range(40) for k in range(2)]
    names = "node string, name string, kind string, score double, tokens bigint"
    o, c = spark.createDataFrame(own, f"start string, {names}"), spark.createDataFrame(shared, f"same string, {names}")
    same = spark.createDataFrame([(f"s{i}", "s0") for i in range(40)], "start string, same string")
    whole = o.unionByName(c.join(same, "same").filter("start <> node").drop("same"))
    for budget, most in ((1000, 50), (9000, 6)):

        def slow(rows):
            out, chosen, spent = [], [], 0
            for node, name, kind, score, size in sorted(rows, key=lambda r: (-r[3], r[0])):
                if spent + size <= budget and len(chosen) < most:
                    red = max([1.0 if n == name else len(set(n.split()) & set(name.split())) / len(name.split()) for n, k in chosen if n == name or k == kind], default=0.0)
                    gain = score - 0.6 * red - 0.2 * size / 8000
                    if gain > 0 and name not in {n for n, _ in chosen}:
                        chosen.append((name, kind))
                        spent += size
                        out.append((node, len(chosen), gain))
            return out

        want = sorted((f"s{i}", *r) for i in range(40) for r in slow([r[1:] for r in own if r[0] == f"s{i}"] + [r[1:] for r in shared if r[4] is not None and r[1] != f"s{i}"]))
        assert sorted(tuple(r) for r in graph.greedy_select_shared(o, same, c, budget, most=most, size=7).collect()) == want
        assert sorted(tuple(r) for r in graph.greedy_select(whole, budget, most=most).collect()) == want


def test_own_candidates_are_ordered_once_for_all_starts(monkeypatch):
    rnd = random.Random(8)
    rows = [(f"s{i % 90}", f"n{k}", f"name {k}", "tool", rnd.choice([0.1, 0.5, None]), rnd.choice([200, 700])) for k, i in enumerate(rnd.choices(range(90), k=1500))]
    rows.append(("s90", "n0", "name 0", "tool", None, 200))
    f = pd.DataFrame(rows, columns=["start", "node", "name", "kind", "score", "tokens"])
    calls = []
    monkeypatch.setattr(pd.DataFrame, "sort_values", lambda self, *a, _of=pd.DataFrame.sort_values, **k: (calls.append(len(self)), _of(self, *a, **k))[1])
    got = {s: (c.rows, c.tokens.tolist(), c.least.tolist()) for s, c in graph.Candidates.by_start(f)}
    assert len(calls) == 1
    each = {s: graph.Candidates.of(one) for s, one in f.groupby("start")}
    assert got == {s: (c.rows, c.tokens.tolist(), c.least.tolist()) for s, c in each.items()}
    assert got["s90"][0] == [] and got["s1"][0] == sorted((-r[4], *r[1:4], r[5]) for r in rows if r[0] == "s1" and r[4] is not None)


def test_paired_tests(spark):
    rows = [(True, False)] * 8 + [(False, True)] * 2 + [(True, True)] * 5
    r = statistics.mcnemar(spark.createDataFrame(rows, "a boolean, b boolean").withColumn("g", F.lit(1)), ["g"], "a", "b").first()
    assert (r["b"], r["c"], r["statistic"]) == (8, 2, 2.5)
    w = statistics.wilcoxon(Stage(spark, "t"), spark.createDataFrame([(1, 3.0, 1.0), (2, 1.0, 4.0), (3, 2.0, 2.0)], "o bigint, a double, b double"), "o", "a", "b").first()
    assert (w["n_pairs"], w["n_nonzero"], w["w_plus"], w["w_minus"]) == (3, 2, 1, 2)


def test_group_split(spark):
    df = spark.range(100).select("id", (F.col("id") % 20).alias("g"))
    s = splitting.by_group(df, F.col("g"), 0.2, ("dev", "test"))
    assert splitting.spans(s, "split", F.col("g")).count() == 0 and s.filter("split = 'dev'").select("g").distinct().count() == 4 and s.count() == 100


def test_client_fallbacks(spark):
    class Broken:
        def reply(self, prompt):
            if prompt == "x":
                raise ValueError("no")
            return "not json" if prompt == "y" else 'ok {"a": 1}'

    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, None)], "id bigint, prompt string")
    got = {r["id"]: (r["a"], r["parsed"]) for r in mapping.extract_one(df, "id", Broken, "a int").collect()}
    assert got == {1: (None, False), 2: (None, False), 3: (1, True), 4: (None, False)}


def test_offline_client_gives_all_sentences():
    import json

    assert [x["claim"] for x in json.loads(mapping.OfflineClient().reply("One. Two. Three. Four.\n第五。第六。"))] == ["One.", "Two.", "Three.", "Four.", "第五。", "第六。"]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60), st.integers(1, 40))
def test_cuts_cover(sizes, most):
    from plinth.operators.chunking import cuts

    text = " ".join("x" * n for n in sizes)
    got = cuts(text, most, most // 4)
    assert (not text and got == []) or (got[0][0] == 0 and got[-1][1] == len(text) and all(b - a <= most for a, b in got))
