"""The state machine of attempts at a task: solved, or open to be skipped after some failures."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

OUTPUT = "user string, task_id string, attempts long, state string"


class _Attempts(StatefulProcessor):
    """Per user and task: the attempts up to the first success, by time and id, and whether it is there."""

    def __init__(self, skip_after: int) -> None:
        self.skip_after = skip_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        longs = ArrayType(LongType())
        self.held = handle.getValueState("held", StructType([StructField("times", longs), StructField("ids", longs), StructField("solved", BooleanType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.held.get() if self.held.exists() else None
        times, ids, solved = held or ([], [], False)
        old = [(t, i, False) for t, i in zip(times, ids)]
        if solved:
            old[-1] = (*old[-1][:2], True)
        now = sorted({*old, *((r["us"], r["id"], r["is_correct"]) for r in rows)})
        first = next((k for k, x in enumerate(now) if x[2]), None)
        solved = first is not None
        now = now[: first + 1] if solved else now  # the first success only moves to the front, so what comes after it never counts
        if now != old:
            self.held.update(([x[0] for x in now], [x[1] for x in now], solved))
            state = "solved" if solved else "may_skip" if len(now) >= self.skip_after else "open"
            yield Row(user=key[0], task_id=key[1], attempts=len(now), state=state)

    def close(self) -> None:
        pass


def attempt_states(submissions: DataFrame, *, skip_after: int = 4) -> DataFrame:
    """(user, task_id, attempts, state) whenever a task's state changes; state is open, may_skip or solved.

    submissions: (id, user, task_id, is_correct, timestamp) of a stream or a
    table. Attempts after the first success don't count; a null is_correct is
    a failure. Attempts count by time, then id, in whatever order they arrive,
    and repeated ones once: per user and task the (time, id) of those up to
    the first success are held, no others.
    """
    rows = submissions.select("id", "user", "task_id", F.coalesce("is_correct", F.lit(False)).alias("is_correct"), F.unix_micros(F.col("timestamp").cast("timestamp")).alias("us")).where("user is not null and task_id is not null")
    return rows.groupBy("user", "task_id").transformWithState(statefulProcessor=_Attempts(skip_after), outputStructType=OUTPUT, outputMode="Update", timeMode="None")
