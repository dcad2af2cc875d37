"""Queries over temporal edges as a stream, and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions.dialect import oracle, query
from orbweave.streaming.temporal import drained, event_stream, window_degrees

SESSIONS = (
    "WITH a AS (SELECT user_id, event_id, @epoch(ts)@ AS t, lag(@epoch(ts)@) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), "
    "b AS (SELECT user_id, t, sum(CASE WHEN p IS NULL OR t - p > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS s FROM a) "
    "SELECT user_id, cast(s AS BIGINT) AS session, min(t) AS first_second, max(t) AS last_second, count(*) AS n FROM b GROUP BY user_id, s"
)


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = window_degrees(event_stream(spark, sf_dir).where("ts IS NOT NULL")).select(F.col("w.start").cast("timestamp_ntz").alias("day"), "user_id", "n", "purchases")
    return drained(spark, out, "window-degrees", ["day", "user_id"])


QUERIES = {"st01_window_degrees": windows, "st02_sessions": query(SESSIONS)}
ORACLES = {
    "st01_window_degrees": "SELECT date_trunc('day', ts)::TIMESTAMP AS day, user_id, count(*) AS n, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)::BIGINT AS purchases FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
    "st02_sessions": oracle(SESSIONS),
}
