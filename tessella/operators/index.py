"""An inverted-list vector index: centroids fitted on a bounded sample, every vector assigned, few lists probed per query."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators.retrieval import _cell
from tessella.session import materialize


@dataclass
class VectorIndex:
    """``centroids`` (at most ``max_lists`` rows) and ``rows``: (id, v, list, part) of every vector."""

    centroids: np.ndarray
    rows: DataFrame

    def save(self, path: str) -> None:
        spark = self.rows.sparkSession
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(self.centroids)], "list int, v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "VectorIndex":
        found = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()  # at most max_lists rows
        return cls(np.array([r["v"] for r in found]), spark.read.parquet(f"{path}/rows"))


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(11)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = _near(x, c, 1)[:, 0]
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _near(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centroids of every row, the nearest first."""
    d = (c * c).sum(1)[None, :] - 2 * x @ c.T
    k = min(k, len(c))
    part = np.argpartition(d, k - 1, axis=1)[:, :k]
    return np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), axis=1, kind="stable"), 1)


def build_index(corpus: DataFrame, *, list_rows: int = 4096, max_sample: int = 20_000, max_lists: int = 4096, min_lists: int = 16) -> VectorIndex:
    """Index all vectors of corpus: (id, v), one length.

    The centroids are fitted by k-means on about ``max_sample`` rows, chosen by
    a hash of their id; their number is that of the rows over ``list_rows``,
    between ``min_lists`` and ``max_lists``. Every row is then assigned to its
    nearest centroid, where it is read, and written once. A list of more than
    ``list_rows`` rows is cut into parts by a hash of the id, so that a hot
    list is searched in several tasks.

    Null ids and vectors take no part; an empty table gives an empty index.
    """
    spark = corpus.sparkSession
    rows = corpus.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<float>").alias("v")).where("id is not null and v is not null")
    n = rows.count()
    share = min(1.0, max_sample / max(1, n))
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000).select("v").toPandas()  # about max_sample rows
    x = np.stack(sample["v"].to_numpy()).astype(np.float64) if len(sample) else np.zeros((1, 1))
    centroids = _kmeans(x, min(len(x), max(min_lists, min(max_lists, -(-n // list_rows)))))
    shared = spark.sparkContext.broadcast(centroids)

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        return pd.Series(_near(np.stack(v.to_numpy()).astype(np.float64), shared.value, 1)[:, 0].astype(np.int32)) if len(v) else pd.Series([], dtype="int32")

    assigned = materialize(rows.withColumn("list", nearest("v")))
    parts = assigned.groupBy("list").agg(F.ceil(F.count("*") / list_rows).alias("parts"))  # at most max_lists rows
    return VectorIndex(centroids, assigned.join(F.broadcast(parts), "list").select("id", "v", "list", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")))


def search(queries: DataFrame, index: VectorIndex, *, k: int = 4, probes: int = 8, threshold: float | None = None, exclude_self: bool = False) -> DataFrame:
    """The k nearest vectors of every query among those in its ``probes`` nearest lists: (query_id, doc_id, distance, rank).

    queries: (id, v). A query is copied to the parts of the lists it probes and
    each vector is shuffled once, so what is shuffled grows with the vectors
    plus the queries times probes, not with their product. Each (list, part)
    is one matrix product that keeps k rows per query. Distances are exact;
    neighbours in lists that aren't probed are missed (``retrieval.knn`` is the
    exact way). Ties go to the smaller id; null ids and vectors take no part.
    """
    shared = queries.sparkSession.sparkContext.broadcast(index.centroids)

    @F.pandas_udf("array<int>")
    def lists(v: pd.Series) -> pd.Series:
        return pd.Series([r.astype(np.int32).tolist() for r in _near(np.stack(v.to_numpy()).astype(np.float64), shared.value, probes)] if len(v) else [], dtype="object")

    asked = queries.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<float>").alias("v")).where("id is not null and v is not null")
    parts = index.rows.groupBy("list").agg(F.max("part").alias("last"))
    qs = asked.select("id", "v", F.explode(lists("v")).alias("list")).join(parts, "list").select("id", "v", F.col("list").alias("ql"), F.explode(F.sequence(F.lit(0), "last")).alias("qp"))
    cells = qs.groupBy("ql", "qp").cogroup(index.rows.groupBy("list", "part")).applyInPandas(_cell(k, exclude_self), "query_id long, doc_id long, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", "doc_id")
    top = cells.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top if threshold is None else top.where(F.col("distance") <= threshold)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries of the exact result and the share of its neighbours that were found."""
    hit = exact.select("query_id", "doc_id").join(found.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    return hit.agg(F.countDistinct("query_id").alias("n_queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
