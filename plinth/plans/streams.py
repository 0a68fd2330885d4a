"""Windows over events, as batch queries; the same functions run on streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.plans.registry import query
from plinth.runtime import table
from plinth.streaming import control, windows


@query("window_rates", "SELECT time_bucket(INTERVAL 6 HOURS, ts) AS start, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def window_rates(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.countDistinct("user_id").alias("users")).select(F.col("w.start").alias("start"), "n", "errors", "users")


@query("event_counts", "SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_counts(spark, d):
    return windows.tumbling(table(spark, d, "events"), "ts", "1 day", ["event_type"], {"n": F.count(F.lit(1)), "total": F.round(F.sum("value"), 4)})


@query("sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def sessions(spark, d):
    return windows.sessions(table(spark, d, "events"), "ts", "user_id", "2 hours")


@query("sliding_counts", "SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 12 HOURS, ts), time_bucket(INTERVAL 12 HOURS, ts) - INTERVAL 12 HOURS]) AS s FROM events) GROUP BY s")
def sliding_counts(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "24 hours", "12 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


@query("event_keys", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def event_keys(spark, d):
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").cast("bigint").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("worker_levels")
def worker_levels(spark, d):
    """Worker count after each window: halved above 5 % errors, else one step up below 2 %."""
    return control.worker_levels(window_rates(spark, d), 20)
