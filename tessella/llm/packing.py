"""Filling containers of fixed capacity with items of varying length."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.tokens import DEFAULT_TOKENIZER, token_count
from tessella.session import materialize

#: Items of one length that are ranked in one task, on the average.
RANKED = 50_000


def shallow_patterns(counts: np.ndarray, capacity: int, window: int, per_length: int = 6) -> list[dict[int, int]]:
    """Combinations of few different lengths whose sum lies in [capacity - window, capacity].

    ``counts[s]`` is the number of items of length s. For every length present,
    as many copies as useful are combined with a second and, where the rest is
    still above the window, a third length, preferring lengths with many items.
    At most about ``per_length`` x the number of lengths are made, however many items there are.
    """
    lengths = np.flatnonzero(counts)
    out: dict[tuple, dict[int, int]] = {}
    for x in lengths.tolist():
        most = min(int(counts[x]), capacity // x)
        for a in sorted({most, max(1, most * 3 // 4), max(1, most // 2), 1}, reverse=True):
            rest = capacity - a * x
            pattern = {x: a}
            for _ in range(2):
                if rest <= window:
                    break
                fits = lengths[lengths <= rest]
                if not len(fits):
                    break
                times = np.minimum(rest // fits, np.maximum(counts[fits] // 4, 1))
                left = rest - times * fits
                y = int(fits[np.lexsort((-counts[fits], np.maximum(left, window)))[0]])
                b = int(min(rest // y, max(counts[y] // 4, 1)))
                pattern[y] = pattern.get(y, 0) + b
                rest -= b * y
            if rest <= window:
                out.setdefault(tuple(sorted(pattern.items())), pattern)
    return list(out.values())


def nnls(patterns: list[dict[int, int]], counts: np.ndarray, rounds: int = 2000, gain: float = 1e-4) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - counts|^2, by multiplicative updates on the sparse A.

    Ends when ten rounds lower the residual by less than ``gain`` of it.
    """
    rows = np.concatenate([np.fromiter(p, np.int64) for p in patterns])
    vals = np.concatenate([np.fromiter(p.values(), np.float64) for p in patterns])
    cols = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    b = counts.astype(float)
    scale = 1.0 / np.sqrt(np.maximum(b, 1.0))  # relative error counts, else rare lengths are ignored
    w = vals * scale[rows]
    target = b * scale
    x = np.full(len(patterns), max(1.0, b.sum() / max(1.0, vals.sum())))
    top = np.bincount(cols, w * target[rows], len(patterns))
    before = np.inf
    for k in range(rounds):
        ax = np.bincount(rows, w * x[cols], len(b))
        if k % 10 == 0:
            residual = float(((ax - target) ** 2).sum())
            if before - residual <= gain * before and k:
                break
            before = residual
        x *= top / np.maximum(np.bincount(cols, w * ax[rows], len(patterns)), 1e-12)
    return x


def plan_containers(counts: np.ndarray, capacity: int, window: int | None = None) -> list[tuple[dict[int, int], int]]:
    """(pattern, repeats) that place every item exactly once; works on the histogram alone.

    Repeat counts come from NNLS over the shallow patterns, rounded down and cut
    to the items left; the residual is packed greedily: the longest remaining
    item, filled up by the longest that fit, repeated as often as counts allow.
    Every greedy step uses up a length, so the plan has at most a few entries
    per length.
    """
    left = counts.astype(np.int64).copy()
    window = capacity // 256 if window is None else window
    plan: list[tuple[dict[int, int], int]] = []
    if left.sum() == 0:
        return plan
    patterns = shallow_patterns(left, capacity, window)
    if patterns:
        x = nnls(patterns, left)
        for k in np.argsort(-x):
            p = patterns[k]
            times = min(int(x[k]), *(int(left[s]) // m for s, m in p.items()))
            if times > 0:
                plan.append((p, times))
                for s, m in p.items():
                    left[s] -= m * times
    while left.any():
        rest, pattern = capacity, {}
        while rest > 0:
            fits = np.flatnonzero(left[: rest + 1])
            fits = fits[left[fits] > np.array([pattern.get(int(s), 0) for s in fits])] if pattern else fits
            if not len(fits):
                break
            s = int(fits[-1])
            m = int(min(rest // s, left[s] - pattern.get(s, 0)))
            pattern[s] = pattern.get(s, 0) + m
            rest -= s * m
        times = min(int(left[s]) // m for s, m in pattern.items())
        plan.append((pattern, times))
        for s, m in pattern.items():
            left[s] -= m * times
    return plan


def _slots(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """Per length the rows (first rank, first container, items per container)."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    base = 0
    for pattern, times in plan:
        for s, m in pattern.items():
            out.setdefault(s, []).append((ranks.get(s, 0), base, m))
            ranks[s] = ranks.get(s, 0) + m * times
        base += times
    return {s: np.array(rows, dtype=np.int64) for s, rows in out.items()}


def pack_documents(docs: DataFrame, *, capacity: int = 2048, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """Assign documents (doc_id, text) to containers of ``capacity`` tokens.

    Rows: doc_id, piece_no (from 1), n_pieces, tokens, container (from 0). Only
    texts above the capacity are cut, into full pieces and one remainder. Null
    and empty texts have no tokens and need no container; repeated rows of a
    doc_id count once; null ids take no part. An empty table gives no rows.

    The driver sees only the histogram of lengths (at most ``capacity`` rows)
    and plans on it; ranks within a length are taken per salt bucket, a bucket
    for about every ``RANKED`` items of the length, so one length held by a
    third of all items doesn't fall to one task. Sizes are written once, so
    that ranks stay the same if tasks are repeated.
    """
    sized = docs.where("doc_id is not null").select("doc_id", token_count(F.col("text"), tokenizer).alias("n")).where("n > 0").dropDuplicates(["doc_id"])
    items = materialize(
        sized.withColumn("n_pieces", F.ceil(F.col("n") / capacity).cast("int"))
        .select("doc_id", "n", "n_pieces", F.explode(F.expr("sequence(1, n_pieces)")).alias("piece_no"))
        .select(
            "doc_id", "piece_no", "n_pieces",
            F.least(F.lit(capacity), F.col("n") - (F.col("piece_no") - 1) * capacity).cast("int").alias("tokens"),
        )
    )
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in items.groupBy("tokens").count().collect():  # at most capacity rows
        counts[r["tokens"]] = r["count"]
    slots = items.sparkSession.sparkContext.broadcast(_slots(plan_containers(counts, capacity)))
    salts = F.array(*[F.lit(int(-(-c // RANKED) or 1)) for c in counts])
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece_no"), salts[F.col("tokens")]).cast("int"))
    cells = salted.groupBy("tokens", "salt").agg(F.count("*").alias("n"))
    before = cells.select("tokens", "salt", (F.sum("n").over(Window.partitionBy("tokens").orderBy("salt")) - F.col("n")).alias("before"))

    @F.pandas_udf("long")
    def container(tokens: pd.Series, rank: pd.Series) -> pd.Series:
        table, s, at_rank = slots.value, tokens.to_numpy(np.int64), rank.to_numpy(np.int64)
        out = np.empty(len(s), dtype=np.int64)
        for size in np.unique(s):
            at, rows = s == size, table[int(size)]
            k = np.searchsorted(rows[:, 0], at_rank[at], side="right") - 1
            out[at] = rows[k, 1] + (at_rank[at] - rows[k, 0]) // rows[k, 2]
        return pd.Series(out)

    w = Window.partitionBy("tokens", "salt").orderBy("doc_id", "piece_no")
    ranked = salted.withColumn("rn", F.row_number().over(w)).join(before, ["tokens", "salt"])
    return ranked.select("doc_id", "piece_no", "n_pieces", "tokens", container("tokens", F.col("before") + F.col("rn") - 1).alias("container"))


def container_fill(assigned: DataFrame, capacity: int = 2048) -> DataFrame:
    """container, items, tokens and fill (share of the capacity) of each container."""
    return assigned.groupBy("container").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens")).withColumn("fill", F.round(F.col("tokens") / capacity, 6))
