"""Queries on change events."""

from pyspark.sql import functions as F

from terrane.streaming import windows
from terrane.tables import table


def events_tumbling(spark, d):
    return windows.tumbling(table(spark, d, "events")).withColumn("total", F.round("total", 4))


def events_sliding(spark, d):
    return windows.sliding(table(spark, d, "events"))


def events_session_debounce(spark, d):
    return windows.debounced(table(spark, d, "events"))


def events_last_state(spark, d):
    return windows.last_state(table(spark, d, "events"))


def events_retry_drop(spark, d):
    attempts = table(spark, d, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("ok"))
    return windows.with_retries(attempts)


QUERIES = {f.__name__: f for f in (events_tumbling, events_sliding, events_session_debounce, events_last_state, events_retry_drop)}
SQL = {
    "events_tumbling": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "events_sliding": """SELECT time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS start, event_type, count(*) AS n
        FROM events, (SELECT unnest(range(0, 4)) AS k) GROUP BY ALL""",
    "events_session_debounce": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g)
        SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, burst""",
    "events_last_state": "SELECT user_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "events_retry_drop": """WITH t AS (SELECT user_id AS path, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
        a AS (SELECT path, count(*) AS c, min(CASE WHEN ok THEN n END) AS done FROM t WHERE n <= 3 GROUP BY path)
        SELECT path, coalesce(done, c) AS attempts, CASE WHEN done IS NOT NULL THEN 'done' WHEN c >= 3 THEN 'dropped' ELSE 'pending' END AS outcome FROM a""",
}
