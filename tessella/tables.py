"""Named test tables: one Parquet file or folder per table below a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "chunk lessons test_database_open_minded rag_queries user_answers user_evaluations "
    "split_limits mix_targets scan_samples encoding_samples"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table; columns and filters are pruned by Catalyst as usual."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
