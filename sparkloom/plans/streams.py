"""Streams over whole tables: what has come out when all input has gone through once, each with its SQL.

The rows of a table are one batch, and a second batch without rows follows with the watermark that the first one left: what that
watermark closes comes out, and what is still open doesn't. Times are without a zone outside the streams.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.plans.registry import query
from sparkloom.sources.shared import shared_path
from sparkloom.streaming import drain, expiring_totals, matched_within, session_totals


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"
    # A pattern, as a stream takes a plain path for a folder; the table may be a file or a folder of files.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{{events.parquet}}").withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(df: DataFrame, *times: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times})


@query("""
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, CAST(count(*) AS BIGINT) AS n_events, round(sum(value), 2) AS total FROM (
SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events))
GROUP BY user_id, s HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = drain(session_totals(_events(spark, sf_dir), "1 hour", "6 hours"), shared_path(spark, "stream-sessions"))
    return _plain(made, "session_start", "session_end").withColumn("total", F.round("total", 2))


@query("""
WITH u AS (SELECT user_id, CAST(count(*) AS BIGINT) AS n_events, round(sum(value), 2) AS total, date_trunc('millisecond', min(ts)) AS first_ts, date_trunc('millisecond', max(ts)) AS last_ts FROM events GROUP BY user_id)
SELECT *, false AS closed FROM u UNION ALL SELECT *, true FROM u WHERE last_ts + INTERVAL 12 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)""")
def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all users, and the last rows of those who were idle for 12 hours: their state has gone."""
    made = drain(expiring_totals(_events(spark, sf_dir), "1 hour", timedelta(hours=12)), shared_path(spark, "stream-totals"), "update")
    return _plain(made, "first_ts", "last_ts").withColumn("total", F.round("total", 2))


@query("""
WITH l AS (SELECT * FROM events WHERE event_type = 'click'), r AS (SELECT * FROM events WHERE event_type = 'purchase'),
w AS (SELECT least((SELECT max(ts) FROM l), (SELECT max(ts) FROM r)) - INTERVAL 1 HOUR AS mark)
SELECT l.user_id, l.event_id AS left_id, l.ts AS left_ts, r.event_id AS right_id, r.ts AS right_ts
FROM l LEFT JOIN r ON l.user_id = r.user_id AND r.ts >= l.ts AND r.ts <= l.ts + INTERVAL 6 HOUR, w WHERE r.event_id IS NOT NULL OR l.ts + INTERVAL 6 HOUR < mark""")
def stream_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with the same user's purchases of the next six hours, and clicks that no purchase can follow in time any more."""
    kinds = (_events(spark, sf_dir).where(F.col("event_type") == kind) for kind in ("click", "purchase"))
    made = drain(matched_within(*kinds, "user_id", "1 hour", "1 hour", "6 hours", "left"), shared_path(spark, "stream-matches"))
    return _plain(made, "left_ts", "right_ts")
