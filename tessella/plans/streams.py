"""Queries that run as streams; their twins are plain aggregates over the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.streaming.attempts import attempt_states
from tessella.streaming.logs import EVENTS, run_available, user_sessions, windowed_counts


def stream_daily_counts(spark, d):
    out = run_available(spark, f"{d}/events.parquet", EVENTS, windowed_counts, keys=["w", "event_type"])
    return out.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("value", 4).alias("value"))


def stream_user_sessions(spark, d):
    out = run_available(spark, f"{d}/events.parquet", EVENTS, user_sessions)
    return out.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_events"), F.max("n").alias("longest"))


def stream_attempts(spark, d):
    """Final state of every user's numbered tasks, from the answers as a stream."""
    schema = spark.read.parquet(f"{d}/user_answers.parquet").schema
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return run_available(spark, f"{d}/user_answers.parquet", schema, lambda s: attempt_states(submitted(s)), bytes_per_trigger=1 << 28, keys=["user", "task_id"])


def submitted(answers):
    """Submissions to numbered tasks; attempt_states counts copies of a row once."""
    rows = answers.where("entry_type = 'submission' and task_id rlike '^task[0-9]+$' and timestamp is not null and id is not null")
    return rows.select("id", F.lower(F.trim("username")).alias("user"), "task_id", "is_correct", "timestamp")


QUERIES = {"stream_attempts": stream_attempts, "stream_daily_counts": stream_daily_counts, "stream_user_sessions": stream_user_sessions}

ORACLES = {
    "stream_attempts": """WITH a AS (SELECT DISTINCT id, lower(trim(username)) AS u, task_id, coalesce(is_correct, false) AS ok, timestamp AS ts FROM user_answers
            WHERE entry_type = 'submission' AND regexp_matches(task_id, '^task[0-9]+$') AND timestamp IS NOT NULL AND username IS NOT NULL),
        n AS (SELECT *, row_number() OVER (PARTITION BY u, task_id ORDER BY ts, id) AS k FROM a), f AS (SELECT u, task_id, min(k) FILTER (WHERE ok) AS first, count(*) AS n FROM n GROUP BY 1, 2)
        SELECT u AS "user", task_id, coalesce(first, n) AS attempts, CASE WHEN first IS NOT NULL THEN 'solved' WHEN n >= 4 THEN 'may_skip' ELSE 'open' END AS state FROM f""",
    "stream_daily_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    "stream_user_sessions": """WITH f AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 1800000000 THEN 0 ELSE 1 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2)
        SELECT user_id, count(*) AS n_sessions, CAST(sum(n) AS BIGINT) AS n_events, max(n) AS longest FROM c GROUP BY 1""",
}
