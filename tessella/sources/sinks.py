"""Writers: chunk files, statistics, summaries, logs and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_chunks(chunks: DataFrame, path: str, *, by: str | None = None, fmt: str = "parquet") -> None:
    """Chunks as Parquet or JSON lines, optionally one folder per value of a column."""
    w = chunks.write.mode("overwrite").format(fmt)
    (w.partitionBy(by) if by else w).save(path)


def split_errors(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rows whose status isn't 'success')."""
    bad = F.coalesce(F.col("status") != "success", F.lit(True))
    return results.where(~bad), results.where(bad)


def append_rows(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append to a log; its readers see whole files only."""
    rows.write.mode("append").format(fmt).save(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def export_tables(spark: SparkSession, names: list[str], folder: str) -> None:
    """Every named table or view as JSON lines below a folder."""
    for name in names:
        spark.table(name).write.mode("overwrite").json(f"{folder}/{name}")


def table_or_build(spark: SparkSession, path: str, build) -> DataFrame:
    """The Parquet table at ``path``; made by ``build()`` first where there is none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not marker.getFileSystem(conf).exists(marker):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: The log tables and their columns.
LOG_TABLES = {
    "user_answers": "id BIGINT, username STRING, task_id STRING, answer STRING, is_correct BOOLEAN, timestamp TIMESTAMP, entry_type STRING, model_used STRING, query STRING",
    "user_evaluations": "id BIGINT, username STRING, timestamp TIMESTAMP, sus_responses MAP<STRING, STRING>, task_difficulty MAP<STRING, STRING>, ai_helpfulness STRING, ai_relevance STRING, retrieval_quality STRING, "
    "traditional_comparison STRING, improvement_suggestions STRING, favorite_feature STRING, skipped_tasks ARRAY<STRING>",
    "system_logs": "id BIGINT, timestamp TIMESTAMP, level STRING, message STRING, logger STRING, pathname STRING, lineno INT",
    "rag_queries": "id BIGINT, timestamp TIMESTAMP, username STRING, task_id STRING, question STRING, model STRING, processing_time DOUBLE, num_docs_retrieved INT, answer_length INT",
}


def create_log_tables(spark: SparkSession, database: str = "default") -> None:
    """The log tables as Parquet tables, where they don't exist."""
    for name, columns in LOG_TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def table_size(spark: SparkSession, name: str) -> int | None:
    """Exact row count of a table, None where there is none."""
    return spark.table(name).count() if spark.catalog.tableExists(name) else None


def report(title: str, sections: dict[str, DataFrame], *, max_rows: int = 1000) -> tuple[str, str]:
    """(Markdown, JSON) of small result tables; more than ``max_rows`` rows in one are an error, not cut."""
    out, data = [f"# {title}"], {}
    for name, df in sections.items():
        rows = df.limit(max_rows + 1).collect()
        if len(rows) > max_rows:
            raise ValueError(f"{name} has more than {max_rows} rows; aggregate it first")
        data[name] = [r.asDict(recursive=True) for r in rows]
        out += [f"\n## {name}\n", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)]
    return "\n".join(out), json.dumps(data, default=str, ensure_ascii=False)
