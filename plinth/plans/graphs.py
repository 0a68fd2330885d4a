"""Graphs over the star tables and the items' own links."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.operators import components, graph
from plinth.plans.registry import query
from plinth.runtime import Stage, table


def edges(spark, d):
    """Customers and suppliers with their nations, nations with their regions; scores follow from the keys."""
    t = lambda n: table(spark, d, n)
    c = t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("source_id"), F.concat(F.lit("n"), "c_nationkey").alias("target_id"), F.col("c_custkey").alias("k"))
    s = t("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("source_id"), F.concat(F.lit("n"), "s_nationkey").alias("target_id"), F.col("s_suppkey").alias("k"))
    n = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("source_id"), F.concat(F.lit("r"), "n_regionkey").alias("target_id"), F.col("n_nationkey").cast("bigint").alias("k"))
    e = c.unionByName(s).unionByName(n)
    return e.withColumn("edge_id", F.concat_ws("-", "source_id", "target_id")).withColumn("relevance", (F.col("k") % 10) / 10).withColumn("dependency", (F.col("k") % 7) / 7).withColumn("trust", (F.col("k") % 5) / 5)


_E = "(SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b, c_custkey AS k FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_suppkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey FROM nation)"
_N = f"(SELECT DISTINCT a AS x, b AS y FROM {_E} UNION SELECT DISTINCT b, a FROM {_E})"


@query("edge_weights", f"SELECT a || '-' || b AS edge_id, round(1 / (1 + exp(-((k % 10) / 10 + 0.5 * ((k % 7) / 7) + 0.4 * ((k % 5) / 5)))), 9) AS weight FROM {_E}")
def edge_weights(spark, d):
    w = graph.edge_weight(relevance=F.col("relevance"), dependency=F.col("dependency"), trust=F.col("trust"))
    return edges(spark, d).select("edge_id", F.round(w, 9).alias("weight"))


@query("degree", f"SELECT x AS node, count(*) AS degree FROM {_N} GROUP BY x")
def degree(spark, d):
    return graph.undirected(edges(spark, d)).groupBy(F.col("x").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


@query("two_hops", f"SELECT start, node, min(hops) AS hops FROM (SELECT x AS start, y AS node, 1 AS hops FROM {_N} WHERE x LIKE 's%' UNION ALL SELECT p.x, q.y, 2 FROM {_N} p JOIN {_N} q ON q.x = p.y WHERE p.x LIKE 's%') WHERE start <> node GROUP BY ALL")
def two_hops(spark, d):
    near = graph.undirected(edges(spark, d))
    start = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("start"))
    return graph.within_two_hops(near, start)


def scored(spark, d):
    """Scored nodes of one hop (start, node), classes of starts (start, same) and scored nodes two hops from these (same, node)."""
    e = edges(spark, d)
    start = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("start"))
    one, same, second = graph.reach(graph.undirected(e), start)
    quality = e.select(F.col("source_id").alias("node"), (F.col("k") % 3 / 3).alias("quality")).groupBy("node").agg(F.max("quality").alias("quality"))
    own, shared = (x.join(quality, "node", "left").withColumn("hops", F.lit(hops).cast("bigint")) for x, hops in ((one, 1), (second, 2)))
    # of one hop only edges at a start matter; an edge from the second hop to the start would make it one hop
    at_start = [e.join(start.withColumnRenamed("start", c), c, "left_semi").select(*e.columns) for c in ("source_id", "target_id")]
    return graph.candidate_scores(own, at_start[0].unionByName(at_start[1])), same, shared.withColumn("score", graph.node_score(F.col("quality")))


@query("candidate_scores")
def candidate_scores(spark, d):
    """Score of every node within two hops of a supplier."""
    own, same, shared = scored(spark, d)
    far = graph.spread(same, shared.select("same", "node", "score")).select("start", "node", F.lit(2).cast("bigint").alias("hops"), "score")
    return own.select("start", "node", "hops", "score").unionByName(far)


@query("selected_context")
def selected_context(spark, d):
    """Nodes chosen for each supplier within 4000 tokens."""
    kind = F.when(F.col("node").startswith("n"), "task").when(F.col("node").startswith("r"), "constraint").otherwise("artifact")
    own, same, shared = scored(spark, d)
    own, shared = (x.withColumn("kind", kind).withColumn("name", F.concat_ws(" ", "kind", "node")).withColumn("tokens", graph.node_tokens(F.col("kind")).cast("bigint")) for x in (own, shared))
    return graph.greedy_select_shared(own, same, shared, 4000)


@query("context_packages")
def context_packages(spark, d):
    """The chosen nodes of each supplier by kind (at most 50 in all), with their tokens."""
    c = selected_context(spark, d).withColumn("kind", F.when(F.col("node").startswith("n"), "task").when(F.col("node").startswith("r"), "constraint").otherwise("artifact"))
    return c.groupBy("start").pivot("kind", ["artifact", "constraint", "task"]).agg(F.array_join(F.sort_array(F.collect_list("node")), " "))


@query("node_tokens", "SELECT kind, tokens FROM (VALUES ('agent', 200), ('task', 300), ('artifact', 500), ('memory', 400), ('tool', 150), ('constraint', 200), ('other', 300)) AS t(kind, tokens)")
def node_tokens(spark, d):
    kinds = spark.createDataFrame([(k,) for k in [*graph.NODE_TOKENS, "other"]], "kind string")
    return kinds.select("kind", graph.node_tokens(F.col("kind")).alias("tokens"))


@query("recency", "SELECT event_id, round(exp(-0.6931471805599453 * (epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) / 1000000 / 86400), 9) AS recency FROM events")
def recency(spark, d):
    """Weight of each event, halved for every day of age."""
    e = table(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    last = e.agg(F.max("us").alias("last"))  # one row
    return e.crossJoin(F.broadcast(last)).select("event_id", F.round(graph.recency((F.col("last") - F.col("us")) / 1000000, 86400.0), 9).alias("recency"))


@query("without_a_nation", f"SELECT count(*) AS edges FROM {_E} WHERE a NOT IN ('n1', 'n2') AND b NOT IN ('n1', 'n2')")
def without_a_nation(spark, d):
    gone = spark.createDataFrame([("n1",), ("n2",)], "node_id string")
    return graph.remove_nodes(edges(spark, d), gone).agg(F.count(F.lit(1)).alias("edges"))


@query("linked_items")
def linked_items(spark, d):
    """Benchmark items linked by a source reference, also through others: the least id of each set."""
    b = table(spark, d, "benchmark_item").select("benchmark_id", F.explode("source_refs").alias("ref")).filter("ref <> ''")
    pairs = b.select(F.concat(F.lit("i:"), "benchmark_id").alias("x"), F.concat(F.lit("r:"), "ref").alias("y"))
    return components.connected(Stage(spark, "linked"), pairs, "x", "y").filter("node like 'i:%'").select(F.substring("node", 3, 100).alias("benchmark_id"), F.col("label").alias("set_id"))


@query("plan_levels")
def plan_levels(spark, d):
    """Levels of a plan whose parts need the part at half their number."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("step"))
    needs = p.filter("step > 1").select("step", F.expr("step div 2").alias("need"))
    return graph.levels(Stage(spark, "levels"), p, needs)
