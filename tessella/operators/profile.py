"""Exact summaries and histograms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.quantiles import exact_quantiles, join_groups


def describe(df: DataFrame, columns: list[str], *, by: str | None = None) -> DataFrame:
    """Count, mean, sample deviation, extremes and interpolated quartiles of each column.

    One row per metric and group: (group_value, metric, n, mean, std, least, p25,
    p50, p75, most); group_value is null for the rows over everything. With
    ``by``, one ROLLUP gives the groups and the total in a single pass. Nulls
    are left out; without values all figures but n are null.
    """
    long = df.select(
        *([F.col(by).cast("string").alias("group_value")] if by else []),
        F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("x")) for c in columns])).alias("m"),
    ).select(*(["group_value"] if by else []), "m.metric", "m.x")
    sums = (
        F.count("x").alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_samp("x"), 4).alias("std"), F.min("x").alias("least"), F.max("x").alias("most"),
    )
    shares = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    if by is None:
        found, asked, keys = long.groupBy("metric").agg(*sums).withColumn("group_value", F.lit(None).cast("string")), long, ["metric"]
    else:
        tagged = long.groupingSets([[F.col("metric")], [F.col("metric"), F.col("group_value")]], F.col("metric"), F.col("group_value"))
        found = tagged.agg(*sums, F.grouping("group_value").cast("int").alias("_over"))
        asked = long.withColumn("_over", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("group_value", F.when(F.col("_over") == 0, F.col("group_value")))
        keys = ["metric", "group_value", "_over"]
    whole = join_groups(found, exact_quantiles(asked, keys, "x", shares), keys)
    return whole.select("group_value", "metric", "n", "mean", "std", "least", *(F.round(c, 6).alias(c) for c in shares), "most")


def width_histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts in ``bins`` ranges of equal width, the last one closed: (bin, low, high, n), empty ones included.

    All bins are empty over an empty table; with one value only, all of it is in bin 0.
    """
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    lo, hi = (float(lo), float(hi)) if lo is not None else (0.0, 0.0)
    at = F.least(F.lit(bins - 1), F.floor((F.col(column) - lo) / F.lit((hi - lo) or 1.0) * bins)).cast("int")
    counts = df.where(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    edge = lambda i: F.round(F.lit(lo) + F.lit(hi - lo) * i / bins, 6)
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").select("bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def fixed_ranges(df: DataFrame, column: str, edges: list[float | None], label: Callable) -> DataFrame:
    """Counts in half-open ranges between given edges: (bucket, label, n), empty ones included; None leaves the last open.

    The bucket is found by comparison, so rows are aggregated before anything is joined.
    """
    pairs = list(zip(edges, edges[1:]))
    x = F.col(column)
    bucket = F.coalesce(*[F.when((x >= a) & ((x < b) if b is not None else F.lit(True)), F.lit(i)) for i, (a, b) in enumerate(pairs)])
    counts = df.select(bucket.alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))
    grid = df.sparkSession.createDataFrame([(i, label(a, b)) for i, (a, b) in enumerate(pairs)], "bucket int, label string")
    return grid.join(counts, "bucket", "left").select("bucket", "label", F.coalesce("n", F.lit(0)).alias("n"))
