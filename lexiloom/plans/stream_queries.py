"""Streams over the shared tables, drained, against the same work in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.plans.profile_queries import LINE_LIMITS, LINE_TESTS, SQL_JUDGED
from lexiloom.plans.registry import query, table
from lexiloom.streaming import verdicts as X


def event_stream(spark, folder):
    schema = table(spark, folder, "events").schema
    return X.read_stream(spark, folder, "events.parquet", schema, "ts")


@query("verdict_stream", f"SELECT l_orderkey, l_linenumber, l_partkey, qc_reasons, qc_reasons = '' AS qc_pass FROM ({SQL_JUDGED})")
def verdict_stream(spark, folder):
    schema = table(spark, folder, "lineitem").schema
    lines = X.read_stream(spark, folder, "lineitem.parquet", schema).withColumn("aligned", F.col("l_returnflag") != "R")
    judged = X.verdict_stream(lines, LINE_LIMITS, LINE_TESTS, "aligned")
    return X.drain(judged.select("l_orderkey", "l_linenumber", "l_partkey", "qc_reasons", "qc_pass"), "verdicts")


@query("windowed_pass_rate", """
SELECT strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*)::BIGINT AS total, count(*) FILTER (value >= 10) AS passed, round(count(*) FILTER (value >= 10) / count(*), 6) AS pass_rate
FROM events GROUP BY 1, 2""")
def windowed_pass_rate(spark, folder):
    rates = X.pass_rates(event_stream(spark, folder), "ts", "event_id", F.col("value") >= 10, "6 hours", "1 day", "event_type")
    out = X.latest(X.drain(rates, "pass-rates", "update"), ["window_start", "event_type"])
    return out.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "total", "passed",
        F.round("pass_rate", 6).alias("pass_rate"),
    )


@query("pause_sessions", """
WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e),
g AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL '6 hours' AS b, count(*)::BIGINT AS records, round(sum(value), 2) AS total FROM s GROUP BY user_id, k)
SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S.%f') AS session_start, strftime(b, '%Y-%m-%d %H:%M:%S.%f') AS session_end, records, total FROM g""")
def pause_sessions(spark, folder):
    updates = X.drain(X.pause_sessions(event_stream(spark, folder), "ts", "user_id", "6 hours", "1 hour", "value"), "sessions", "update")
    out = X.closed_sessions(updates, "user_id")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return out.select("user_id", stamp("session_start"), stamp("session_end"), "records", F.round("total", 2).alias("total"))
