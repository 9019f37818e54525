"""Structured Streaming forms of the log operators."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import delete, shared_dir

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def windowed_counts(events: DataFrame, *, window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Events and their value per window and type, with a watermark for late rows. Works on streams and tables."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def user_sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Events per user and session window."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))


def new_rows_only(rows: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """A stream without repeated keys within the watermark."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def run_available(spark: SparkSession, path: str, schema: str, plan, *, per_trigger: int = 1, bytes_per_trigger: int | None = None, keys: list[str] | None = None, checkpoint: str | None = None) -> DataFrame:
    """The final state of ``plan`` over all files now at ``path``, read as a stream of micro-batches.

    With ``keys``, the columns by which the plan groups, the query runs in
    update mode: a micro-batch writes only the groups that it changed, the
    watermark lets old state go, and the last update of each group is the
    result. Without them it runs in complete mode, which keeps all groups (as
    session windows need for their open ends). A micro-batch takes
    ``per_trigger`` files, or with ``bytes_per_trigger`` as many as have that
    size, so that many small files don't cost a batch each. ``checkpoint`` names a folder
    in which a later call goes on where this one ended; without it the query
    starts anew and its folder is removed in the end.
    """
    base = checkpoint or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    if checkpoint is None:
        atexit.register(delete, spark, base)
    glob = f"{path[:-1]}[{path[-1]}]"  # as a pattern, the path may be a folder or one file
    most = ("maxBytesPerTrigger", bytes_per_trigger) if bytes_per_trigger else ("maxFilesPerTrigger", per_trigger)
    stream = plan(spark.readStream.schema(schema).option(*most).parquet(glob))

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = stream.writeStream.outputMode("update" if keys else "complete").trigger(availableNow=True).option("checkpointLocation", f"{base}/state").foreachBatch(save).start()
    query.awaitTermination()
    out = spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out").drop("batch")
    if keys:
        rest = [c for c in out.columns if c not in keys and c != "_batch"]
        return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_last")).select(*keys, *[F.col("_last")[c].alias(c) for c in rest])
    last = out.agg(F.max("_batch")).first()[0]
    return out.where(F.col("_batch") == last).drop("_batch")
