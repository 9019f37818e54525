"""Grouping activity into sessions separated by inactivity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import materialize

_PART = "entity string, start_us long, start_id long, end_us long, end_id long, n_events long, kinds array<string>, edge boolean"
_ARROW = pa.schema([("entity", pa.string()), ("start_us", pa.int64()), ("start_id", pa.int64()), ("end_us", pa.int64()), ("end_id", pa.int64()), ("n_events", pa.int64()), ("kinds", pa.list_(pa.string())), ("edge", pa.bool_())])


def _scanner(gap_us: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One pass over rows sorted by (entity, us, id); holds one open session."""
        cur: dict | None = None  # the open session
        first = True  # whether the open session is the partition's first

        def rows(done: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(done, schema=_ARROW)

        for batch in batches:
            if not batch.num_rows:
                continue
            ent, us, ids, kind = (batch.column(i) for i in range(4))
            t, i = us.to_numpy(zero_copy_only=False), ids.to_numpy(zero_copy_only=False)
            same = np.zeros(len(t), dtype=bool)
            if len(t) > 1:
                same[1:] = pc.equal(ent.slice(1), ent.slice(0, len(t) - 1)).to_numpy(zero_copy_only=False)
            prev_t, prev_i = np.roll(t, 1), np.roll(i, 1)
            if cur is not None and cur["entity"] == ent[0].as_py():
                same[0], prev_t[0], prev_i[0] = True, cur["end_us"], cur["end_id"]
            twice = same & (t == prev_t) & (i == prev_i)  # the same stored row again
            cuts = np.flatnonzero(~same | (t - prev_t > gap_us))
            names, bounds = ent.take(pa.array(cuts)).to_pylist(), [*cuts.tolist(), len(t)]
            counts = np.concatenate([[0], np.cumsum(~twice)])
            done = []
            if bounds[0] > 0 and cur is not None:  # rows that go on with the open session
                e = bounds[0]
                cur["end_us"], cur["end_id"], cur["n_events"] = int(t[e - 1]), int(i[e - 1]), cur["n_events"] + int(counts[e])
                cur["kinds"].update(kind.slice(0, e).unique().to_pylist())
            for k, a in enumerate(bounds[:-1]):
                b = bounds[k + 1]
                if cur is not None:
                    done.append(cur | {"edge": first, "kinds": sorted(x for x in cur["kinds"] if x is not None)})
                    first = False
                cur = {"entity": names[k], "start_us": int(t[a]), "start_id": int(i[a]), "end_us": int(t[b - 1]), "end_id": int(i[b - 1]), "n_events": int(counts[b] - counts[a]), "kinds": set(kind.slice(a, b - a).to_pylist())}
            if done:
                yield rows(done)
        if cur is not None:
            yield rows([cur | {"edge": True, "kinds": sorted(x for x in cur["kinds"] if x is not None)}])

    return scan


def sessionize(events: DataFrame, *, entity: str, ts: str, id: str, kind: str, gap_seconds: int = 1800) -> DataFrame:
    """One row per session of ``entity``.

    Columns: entity, start_ts, end_ts, start_id, end_id, duration_seconds,
    n_events, n_kinds. A new session starts when more than ``gap_seconds``
    lie between two successive events (exactly that many stay together).
    Events are ordered by (ts, id); the same (entity, ts, id) again counts once.

    Rows are range-partitioned and sorted by (entity, ts, id), so that one hot
    entity spreads over as many tasks as its share of rows needs, and each
    partition is scanned once with one open session in memory. Only the first
    and last session of a partition can go on in its neighbour: those (two per
    partition) are stitched by a window over the entity.

    Rows with null entity, ts or id take no part; a null kind isn't counted as
    a kind. An empty table gives no sessions.
    """
    rows = events.select(
        F.col(entity).cast("string").alias("entity"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("us"),
        F.col(id).cast("long").alias("id"),
        F.col(kind).cast("string").alias("kind"),
    ).where("entity is not null and us is not null and id is not null")
    parts = materialize(
        rows.repartitionByRange("entity", "us", "id")
        .sortWithinPartitions("entity", "us", "id")
        .mapInArrow(_scanner(gap_seconds * 1_000_000), _PART)
    )  # read twice below, so that rows are scanned once
    w = Window.partitionBy("entity").orderBy("start_us", "start_id", "end_us")
    opens = F.coalesce((F.col("start_us") - F.lag("end_us").over(w) > gap_seconds * 1_000_000).cast("int"), F.lit(1))
    stitched = (
        parts.where("edge")
        .withColumn("s", opens)
        .withColumn("s", F.sum("s").over(w))
        .groupBy("entity", "s")
        .agg(
            F.min("start_us").alias("start_us"),
            F.min_by("start_id", F.struct("start_us", "start_id")).alias("start_id"),
            F.max("end_us").alias("end_us"),
            F.max_by("end_id", F.struct("end_us", "end_id")).alias("end_id"),
            F.sum("n_events").alias("n_events"),
            F.array_distinct(F.flatten(F.collect_list("kinds"))).alias("kinds"),
        )
        .drop("s")
    )
    whole = parts.where("not edge").drop("edge").unionByName(stitched)
    return whole.select(
        "entity",
        F.timestamp_micros("start_us").alias("start_ts"),
        F.timestamp_micros("end_us").alias("end_ts"),
        "start_id",
        "end_id",
        ((F.col("end_us") - F.col("start_us")) / 1e6).alias("duration_seconds"),
        "n_events",
        F.size("kinds").cast("long").alias("n_kinds"),
    )
