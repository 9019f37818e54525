"""Queries p1_... (orphan references) and p2_... (sessions) with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.orphans import find_orphans, orphan_report
from tessella.operators.sessions import sessionize
from tessella.tables import table


def _references(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "test_database_open_minded")
    return (
        items.select("id", F.col("created_at").alias("at"), F.explode("relevant_chunk_ids").alias("r"))
        .select("id", F.expr("trim(r)").alias("ref_id"), "at")
        .where(F.col("ref_id").isNotNull() & F.col("ref_id").rlike(r"\S"))
    )


def _parents(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunk").select(F.col("chunk_id").alias("key"), F.col("ingested_at").alias("valid_from"), F.col("deleted_at").alias("valid_to"))
    lessons = table(spark, d, "lessons").select(F.col("url").alias("key"), F.col("scraped_at").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
    return chunks.unionByName(lessons)


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return find_orphans(_references(spark, d), _parents(spark, d)).dropDuplicates(["id", "ref_id"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("id", "ref_id")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d))


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "rag_queries").withColumn("user", F.lower(F.trim("username")))
    return sessionize(log, entity="user", ts="timestamp", id="id", kind="task_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d).select(F.col("entity").alias("username"), "start_id", "end_id")


def p2_sessions(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d).select(
        F.col("entity").alias("username"), *(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("start_ts", "end_ts")), "start_id", "end_id",
        F.round("duration_seconds", 6).alias("duration_seconds"), F.col("n_events").alias("n_queries"), F.col("n_kinds").alias("n_tasks"),
    )


QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p2_found": p2_found, "p2_sessions": p2_sessions}

_ORPHANS = """
refs AS (SELECT DISTINCT id, created_at, trim(r) AS ref_id
         FROM (SELECT id, created_at, unnest(relevant_chunk_ids) AS r FROM test_database_open_minded)
         WHERE r IS NOT NULL AND trim(r) <> ''),
orphans AS (SELECT DISTINCT id, ref_id, created_at FROM refs
            WHERE NOT EXISTS (SELECT 1 FROM chunk c WHERE c.chunk_id = refs.ref_id AND c.ingested_at <= refs.created_at
                              AND (c.deleted_at IS NULL OR c.deleted_at > refs.created_at))
              AND NOT EXISTS (SELECT 1 FROM lessons l WHERE l.url = refs.ref_id AND l.scraped_at <= refs.created_at))"""

_SESSIONS = """
q AS (SELECT DISTINCT id, lower(trim(username)) AS username, timestamp AS ts, task_id FROM rag_queries
      WHERE username IS NOT NULL AND timestamp IS NOT NULL),
f AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 1800000000 THEN 0 ELSE 1 END AS opens
      FROM q WINDOW w AS (PARTITION BY username ORDER BY ts, id)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY username ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS n FROM f)"""

ORACLES = {
    "p1_found": f"WITH {_ORPHANS} SELECT id, ref_id FROM orphans",
    "p1_report": f"""WITH {_ORPHANS} SELECT CASE WHEN regexp_matches(ref_id, '^[a-z]+://') THEN 'lessons' ELSE 'chunk' END AS referenced_table,
        strftime(created_at, '%Y-%m') AS month, count(*) AS "references", count(DISTINCT id) AS items FROM orphans GROUP BY 1, 2""",
    "p2_found": f"WITH {_SESSIONS} SELECT username, arg_min(id, (ts, id)) AS start_id, arg_max(id, (ts, id)) AS end_id FROM s GROUP BY username, n",
    "p2_sessions": f"""WITH {_SESSIONS} SELECT username, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS end_ts, arg_min(id, (ts, id)) AS start_id, arg_max(id, (ts, id)) AS end_id,
        round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS duration_seconds, count(*) AS n_queries, count(DISTINCT task_id) AS n_tasks
        FROM s GROUP BY username, n""",
}
