"""Order-dependent columns within groups of any size, without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_order(df: DataFrame, group: str, place: Column, tie: str, *, carry: Column | None = None, width: int = 256) -> DataFrame:
    """Add _ordinal, _previous and (with ``carry``) _carried to every row.

    Rows of a group are ordered by the number ``place`` (nulls first), then
    ``tie``. _ordinal counts from 1; _previous is the place of the row before
    (null for the first); _carried is the last non-null ``carry`` up to the row.

    A group is cut into buckets of ``width`` places. Windows run within
    (group, bucket); what goes on over bucket borders is one aggregate row per
    bucket, ordered in a second, small window and joined back. So a group with
    a third of all rows is spread over as many tasks as it has buckets.
    """
    rows = df.withColumn("_place", place).withColumn("_bucket", F.coalesce(F.floor(F.col("_place") / width), F.lit(-(1 << 60)))).withColumn("_carry", F.lit(None) if carry is None else carry)
    inner = Window.partitionBy(group, "_bucket").orderBy("_place", tie)
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    order = F.struct("_place", tie)
    per = rows.groupBy(group, "_bucket").agg(
        F.count("*").alias("_n"), F.max_by("_place", order).alias("_last"), F.max_by("_carry", F.when(F.col("_carry").isNotNull(), order)).alias("_kept")
    )
    outer = Window.partitionBy(group).orderBy("_bucket")
    before = per.select(
        F.col(group).alias("_g"), F.col("_bucket").alias("_b"),
        (F.sum("_n").over(outer) - F.col("_n")).alias("_offset"), F.lag("_last").over(outer).alias("_before"),
        F.last("_kept", ignorenulls=True).over(outer.rowsBetween(Window.unboundedPreceding, -1)).alias("_kept_before"),
    )
    near = rows.withColumn("_rn", F.row_number().over(inner)).withColumn("_lag", F.lag("_place").over(inner)).withColumn("_in", F.last("_carry", ignorenulls=True).over(upto))
    both = near.join(before, (F.col(group) == F.col("_g")) & (F.col("_bucket") == F.col("_b")))
    return both.select(
        *df.columns, (F.col("_offset") + F.col("_rn")).alias("_ordinal"), F.when(F.col("_rn") > 1, F.col("_lag")).otherwise(F.col("_before")).alias("_previous"),
        *([F.coalesce("_in", "_kept_before").alias("_carried")] if carry is not None else []),
    )
