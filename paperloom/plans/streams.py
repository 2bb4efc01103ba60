"""Queries that run a stream over all events and give what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.streaming import events as S


def stm_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Closed windows of six hours."""
    out = S.run_all(S.windowed(S.event_stream(spark, folder)))
    return out.select(F.date_format("start_at", "yyyy-MM-dd HH:mm").alias("start_at"), "event_type", "events", "total")


def stm_sittings(spark: SparkSession, folder: str) -> DataFrame:
    """Ended sittings per user: how many, events."""
    return S.run_all(S.sittings(S.event_stream(spark, folder))).groupBy("user_id").agg(F.count("*").alias("sittings"), F.sum("events").alias("events"))


def stm_first(spark: SparkSession, folder: str) -> DataFrame:
    """First deliveries per type."""
    return S.run_all(S.first_deliveries(S.event_stream(spark, folder), ["event_id"])).groupBy("event_type").agg(F.count("*").alias("events"))


def queries() -> dict:
    """The queries of this module."""
    return {"stm_windows": stm_windows, "stm_sittings": stm_sittings, "stm_first": stm_first}


def oracle_sql() -> dict[str, str]:
    """DuckDB texts: windows and sittings that the last watermark (an hour before the newest event) has closed."""
    return {
        "stm_windows": """WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS s, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL)
SELECT strftime(s, '%Y-%m-%d %H:%M') AS start_at, event_type, events, total FROM w WHERE s + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
        "stm_sittings": """WITH l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM l),
g AS (SELECT user_id, k, count(*) AS n, max(ts) + INTERVAL 6 HOUR AS ends FROM s GROUP BY ALL)
SELECT user_id, count(*) AS sittings, CAST(sum(n) AS BIGINT) AS events FROM g WHERE ends <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY user_id""",
        "stm_first": "SELECT event_type, count(*) AS events FROM (SELECT DISTINCT ON (event_id) event_type FROM events) GROUP BY 1",
    }
