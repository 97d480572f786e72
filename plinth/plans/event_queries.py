"""Queries over events: windows, sessions, states and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plinth.plans.catalog import query
from plinth.session import table
from plinth.streaming import events as E


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.tumbling(table(spark, sf_dir, "events"), "1 hour")


@query("""
WITH g AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events), s AS (SELECT *, sum(CASE WHEN gap >= INTERVAL '30 minutes' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS stop, count(*) AS n FROM s GROUP BY user_id, k
""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sessions(table(spark, sf_dir, "events"), "30 minutes")


@query("SELECT user_id AS commit_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS changes FROM events GROUP BY 1")
def last_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.last_status(table(spark, sf_dir, "events"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
