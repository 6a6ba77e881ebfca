"""Streaming queries, run over the available log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.plans.registry import Registry
from cairn.streaming import events

R = Registry()


_MARK = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@R.query(sql=f"""WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, event_type, value FROM events)
    SELECT epoch_us(s) AS start_us, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM w WHERE s + INTERVAL 1 HOUR <= {_MARK} GROUP BY 1, 2""")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Hourly windows that the watermark has closed when the stream is drained."""
    return events.drain(events.tumbling(events.read(spark, d)), "append", "tumbling")


@R.query(
    sql=f"""WITH w AS (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s, event_type, value FROM events)
    SELECT epoch_us(s) AS start_us, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM w WHERE s + INTERVAL 1 HOUR <= {_MARK} GROUP BY 1, 2"""
)
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Closed hourly windows every half hour."""
    return events.drain(events.sliding(events.read(spark, d)), "append", "sliding")


@R.query(
    sql=f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS fresh, event_id FROM events),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
    SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 5 MINUTE) AS end_us, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 5 MINUTE <= {_MARK}"""
)
def stream_session(spark: SparkSession, d: str) -> DataFrame:
    """User sessions with a gap of five minutes that the watermark has closed."""
    return events.drain(events.sessions(events.read(spark, d)), "append", "session")


@R.query(
    sql="""WITH l AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events)
    SELECT user_id, max(CASE WHEN rn = 1 THEN CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'click' THEN 'completed' WHEN 'purchase' THEN 'retryable' ELSE 'failed' END END) AS status,
    CAST(count_if(event_type = 'view') AS INTEGER) AS attempts, max(event_id) AS last_id FROM l GROUP BY 1"""
)
def stream_job_state(spark: SparkSession, d: str) -> DataFrame:
    """The last state of every job after a drained stream."""
    out = events.drain(events.job_states(events.read(spark, d)), "update", "jobs")
    return out.groupBy("user_id").agg(F.max_by(F.struct("status", "attempts", "last_id"), "last_id").alias("s")).select("user_id", "s.*")
