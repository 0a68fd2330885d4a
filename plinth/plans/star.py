"""Joins, aggregates and rankings on the star tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plinth.operators.sampling import top_per_group
from plinth.plans.registry import query
from plinth.runtime import table


@query("pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(sum(l_discount), 2) AS discounts, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, d):
    li = table(spark, d, "lineitem").filter("l_shipdate <= timestamp'1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.sum("l_discount"), 2).alias("discounts"), F.count(F.lit(1)).alias("n"))


@query("revenue_by_nation", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")
def revenue_by_nation(spark, d):
    t = lambda n: table(spark, d, n)
    # partial sums per order before the next join
    per = t("lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"), F.count(F.lit(1)).alias("k"))
    j = per.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey")).join(t("nation").select("n_nationkey", "n_name"), F.col("n_nationkey") == F.col("c_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"), F.sum("k").alias("n"))


@query("top_orders_per_customer", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def top_orders_per_customer(spark, d):
    return top_per_group(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 2)


@query("customers_without_orders", "SELECT c_custkey FROM customer ANTI JOIN orders ON o_custkey = c_custkey")
def customers_without_orders(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("parts_in_large_lines", "SELECT p_partkey, p_brand FROM part SEMI JOIN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49) l ON l_partkey = p_partkey")
def parts_in_large_lines(spark, d):
    big = table(spark, d, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey", "p_brand").join(big, "p_partkey", "left_semi")


@query("order_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def order_cube(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("running_totals", "SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders")
def running_totals(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", F.round(F.sum("o_totalprice").over(w), 2).alias("running"))
