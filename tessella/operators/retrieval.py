"""Exact vector retrieval in blocks, and retrieval metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cell(k: int, exclude_self: bool):
    def best(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "doc_id": pd.Series(dtype="int64"), "distance": pd.Series(dtype="float64")})
        q, x = np.stack(queries["v"].to_numpy()).astype(np.float64), np.stack(rows["v"].to_numpy()).astype(np.float64)
        qi, xi = queries["id"].to_numpy(np.int64), rows["id"].to_numpy(np.int64)
        near = (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * q @ x.T
        if exclude_self:
            near[qi[:, None] == xi[None, :]] = np.inf
        take = min(len(xi), k + 8)  # some more than k, for the exact order below
        part = np.argpartition(near, take - 1, axis=1)[:, :take]
        out = []
        for r in range(len(qi)):
            at = part[r][np.isfinite(near[r, part[r]])]
            exact = ((x[at] - q[r]) ** 2).sum(1)
            order = np.lexsort((xi[at], exact))[:k]
            out.append(pd.DataFrame({"query_id": qi[r], "doc_id": xi[at][order], "distance": exact[order]}))
        return pd.concat(out, ignore_index=True)

    return best


def knn(queries: DataFrame, corpus: DataFrame, *, k: int = 4, threshold: float | None = None, exclude_self: bool = False, block_rows: int = 4096) -> DataFrame:
    """The k nearest corpus vectors of every query by squared Euclidean distance: (query_id, doc_id, distance, rank).

    queries and corpus: (id, v), vectors of one length. Exact: queries and
    corpus are cut into blocks of about ``block_rows`` rows by a hash of the
    id; every pair of blocks is one matrix product in one task, which keeps at
    most k rows per query, so memory per task is bounded and only k rows per
    query and corpus block are shuffled on. Equal distances are ordered by
    doc_id. ``threshold`` keeps distances up to it.

    Null ids and vectors take no part; with fewer than k vectors there are
    fewer rows; empty tables give no rows.
    """
    def side(df: DataFrame) -> tuple[DataFrame, int]:
        rows = df.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<float>").alias("v")).where("id is not null and v is not null")
        return rows, max(1, -(-rows.count() // block_rows))

    (q, nq), (x, nx) = side(queries), side(corpus)
    qb, xb = F.pmod(F.xxhash64("id"), F.lit(nq)), F.pmod(F.xxhash64("id"), F.lit(nx))
    qs = q.select("id", "v", qb.alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nx - 1).cast("long"))).alias("xb"))
    xs = x.select("id", "v", xb.alias("xb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long"))).alias("qb"))
    cells = qs.groupBy("qb", "xb").cogroup(xs.groupBy("qb", "xb")).applyInPandas(_cell(k, exclude_self), "query_id long, doc_id long, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", "doc_id")
    top = cells.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top if threshold is None else top.where(F.col("distance") <= threshold)


def metrics_by_query(retrieved: DataFrame, relevant: DataFrame, *, match: str = "exact") -> DataFrame:
    """Precision, recall, reciprocal rank, hit and NDCG of every query that has relevant documents.

    retrieved: (query_id, doc_key, rank); relevant: (query_id, rel_key). With
    match='substring', a relevant key counts as found if it contains the
    retrieved key or is contained in it (empty keys never match); NDCG is
    always by equality. Precision counts relevant keys found over documents
    retrieved. Without retrieved documents all are 0. The comparison is an
    equi-join on the query, so each query's own lists meet only.
    """
    got = retrieved.where("doc_key is not null and doc_key <> ''")
    rel = relevant.where("rel_key is not null").distinct()
    same = F.col("doc_key") == F.col("rel_key")
    fits = same if match == "exact" else F.contains("doc_key", "rel_key") | F.contains("rel_key", "doc_key")
    met = rel.join(got, "query_id").where(fits).groupBy("query_id").agg(
        F.countDistinct("rel_key").alias("found"), F.min("rank").alias("first"), F.sum(F.when(same, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg")
    )
    n_got, n_rel = got.groupBy("query_id").agg(F.count("*").alias("n_retrieved")), rel.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    all_ = n_rel.join(n_got, "query_id", "left").join(met, "query_id", "left").na.fill(0, ["n_retrieved", "found"])
    return _scores(all_)


def _scores(all_: DataFrame) -> DataFrame:
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", "n_retrieved").cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    r = lambda c, n: F.round(F.coalesce(c, F.lit(0.0)), 6).alias(n)
    return all_.select(
        "query_id", "n_retrieved", "n_relevant", r(F.try_divide("found", "n_retrieved"), "precision"), r(F.try_divide("found", "n_relevant"), "recall"),
        r(F.try_divide(F.lit(1.0), F.col("first")), "reciprocal_rank"), (F.col("found") > 0).cast("int").alias("hit"),
        r(F.when(F.col("n_retrieved") > 0, F.try_divide(F.col("dcg"), ideal)), "ndcg"),
    )


def label_metrics(retrieved: DataFrame, labels: DataFrame) -> DataFrame:
    """The metrics of ``metrics_by_query`` where all other rows of the query's label are relevant.

    retrieved: (query_id, doc_id, rank), without the query itself; labels: (id,
    label). Relevant rows are counted per label, never listed: only retrieved
    rows are joined with their labels. Queries whose label is theirs alone are
    left out.
    """
    n_of = labels.groupBy("label").agg((F.count("*") - 1).alias("n_relevant")).where("n_relevant > 0")
    own = labels.select(F.col("id").alias("query_id"), F.col("label").alias("own"))
    theirs = labels.select(F.col("id").alias("doc_id"), F.col("label").alias("its"))
    same = F.col("own") == F.col("its")
    per = retrieved.join(own, "query_id").join(theirs, "doc_id").groupBy("query_id", "own").agg(
        F.count("*").alias("n_retrieved"), F.count_if(same).alias("found"), F.min(F.when(same, F.col("rank"))).alias("first"),
        F.sum(F.when(same, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
    )
    return _scores(per.join(n_of, per.own == n_of.label))


def metrics_summary(by_query: DataFrame) -> DataFrame:
    """Macro averages and totals; one row, null averages without queries."""
    r = lambda c: F.round(F.avg(c), 6).alias(c)
    return by_query.agg(
        F.count("*").alias("n_queries"), *(r(c) for c in ("precision", "recall", "reciprocal_rank", "hit", "ndcg")),
        F.sum("n_retrieved").alias("total_retrieved"), F.sum("n_relevant").alias("total_relevant"),
    )


def citation(source_type: Column, name: Column, url: Column) -> Column:
    """One line of a source list; lessons are marked as such."""
    label = F.when(source_type == "lessons_learned", F.concat(F.lit("- Lesson Learned - "), name)).otherwise(F.concat(F.lit("- "), name))
    return F.concat(label, F.lit(": "), F.coalesce(url, F.lit("no link")))
