"""Mixing sources to target shares by balanced (cube-method) sampling."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.tokens import DEFAULT_TOKENIZER, token_count
from tessella.session import materialize

EPS = 1e-9


def water_fill(total: float, shares: np.ndarray, caps: np.ndarray) -> np.ndarray:
    """Sizes summing to ``total`` (or to all caps) nearest in squares to shares x total, with 0 <= size <= cap."""
    want = shares * total
    total = min(total, float(caps.sum()))
    lo, hi = -float(want.max(initial=0)) - 1, float(caps.sum()) + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        if np.clip(want + mid, 0, caps).sum() < total:
            lo = mid
        else:
            hi = mid
    return np.clip(want + hi, 0, caps)


class Flight:
    """Flight phase of the cube method for one source, one unit at a time.

    Balances the number of documents and their tokens: of three undecided units
    the probabilities move along the null space of the two constraints until
    one of them is 0 or 1. At most two units stay undecided.
    """

    def __init__(self) -> None:
        self.units: list[list] = []  # [key, tokens, probability]

    def add(self, key, tokens: float, p: float, u: float) -> list[tuple]:
        """Take a unit in; (key, tokens, 0 or 1) of those that are thereby decided."""
        if p < EPS or p > 1 - EPS:
            return [(key, tokens, round(p))]
        self.units.append([key, tokens, p])
        if len(self.units) < 3:
            return []
        (a, b, c) = (unit[1] for unit in self.units)
        v = (b - c, c - a, a - b)  # sum v = 0 and sum v * tokens = 0
        if not any(v):
            v = (1.0, -1.0, 0.0)
        steps = []
        for sign in (1, -1):
            room = [((1 - unit[2]) if sign * d > 0 else unit[2]) / abs(d) for unit, d in zip(self.units, v) if d]
            steps.append(min(room))
        step = steps[0] if u * (steps[0] + steps[1]) < steps[1] else -steps[1]
        for unit, d in zip(self.units, v):
            unit[2] += step * d
        out = [(x[0], x[1], round(x[2])) for x in self.units if x[2] < EPS or x[2] > 1 - EPS]
        self.units = [x for x in self.units if EPS <= x[2] <= 1 - EPS]
        return out


def land(units: list[list]) -> list[tuple]:
    """Landing phase: the choice for the last few units that keeps tokens, then documents, nearest."""
    if not units:
        return []
    tokens, docs = sum(x[1] * x[2] for x in units), sum(x[2] for x in units)
    best = min(itertools.product((0, 1), repeat=len(units)), key=lambda c: (abs(sum(x[1] * k for x, k in zip(units, c)) - tokens), abs(sum(c) - docs), c))
    return [(x[0], x[1], k) for x, k in zip(units, best)]


def _uniform(seed: int) -> F.Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def _fly(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    flights: dict[str, Flight] = {}
    for df in batches:
        out = []
        for key, source, n, p, u in zip(df["doc_id"].tolist(), df["source"].tolist(), df["tokens"].tolist(), df["p"].tolist(), df["u"].tolist()):
            out += [(k, source, t, float(x)) for k, t, x in flights.setdefault(source, Flight()).add(key, n, p, u)]
        yield pd.DataFrame(out, columns=["doc_id", "source", "tokens", "x"])
    yield pd.DataFrame([(x[0], s, x[1], x[2]) for s, f in flights.items() for x in f.units], columns=["doc_id", "source", "tokens", "x"])


def _finish(df: pd.DataFrame) -> pd.DataFrame:
    flight, done = Flight(), []
    df = df.sort_values(["tokens", "doc_id"], ascending=[False, True])
    for key, n, p, u in zip(df["doc_id"].tolist(), df["tokens"].tolist(), df["x"].tolist(), df["u"].tolist()):
        done += flight.add(key, n, p, u)
    done += land(flight.units)
    return pd.DataFrame({"doc_id": [k for k, _, _ in done], "source": df["source"].iloc[0], "tokens": [int(t) for _, t, _ in done], "x": [float(x) for _, _, x in done]})


def _facts(rows: DataFrame, **values: dict) -> DataFrame:
    """``rows`` with a column per argument: its value for the row's source (0 without one), by a join with a table of the sources, whose number was checked."""
    names = sorted(set().union(*values.values()))
    small = rows.sparkSession.createDataFrame([(n, *(float(v.get(n, 0.0)) for v in values.values())) for n in names], "source string, " + ", ".join(f"{c} double" for c in values))
    return rows.join(F.broadcast(small), "source", "left").na.fill(0.0, list(values))


def _round(sized: DataFrame, odds: dict[str, float], seed: int) -> DataFrame:
    """Each row's x, 0 or 1, with probability odds[source] and both sums of a source kept."""
    schema = "doc_id long, source string, tokens int, x double"
    flown = materialize(
        _facts(sized, p=odds).repartition("doc_id")
        .sortWithinPartitions("source", F.desc("tokens"), "doc_id")
        .select("doc_id", "source", "tokens", "p", _uniform(seed).alias("u"))
        .mapInPandas(_fly, schema)
    )
    landed = flown.where("x > 0 and x < 1").withColumn("u", _uniform(seed + 1)).groupBy("source").applyInPandas(_finish, schema)
    return flown.where("x = 0 or x = 1").unionByName(landed)


def mix_sources(docs: DataFrame, targets: DataFrame, *, tokenizer: str = DEFAULT_TOKENIZER, seed: int = 1, max_sources: int = 10_000, long_factor: float = 4.0) -> DataFrame:
    """How often each document of the listed sources is used: (doc_id, source, tokens, uses).

    docs: (doc_id, text, source); targets: (source, target_share, max_repeats).
    Sources are compared in lower case without outer spaces. The set is to be
    as large in tokens as all documents of the listed sources together; each
    source's size is the one nearest (in squares) to its share that max_repeats
    allows, what a short source lacks goes to the others in equal parts.

    Every document of a source is used floor(r) times, r being the source's
    wanted size over its own; which are used once more is drawn by the cube
    method: a flight per partition balances documents and tokens and leaves at
    most two open units per partition and source; these few fly again, and the
    last two land by enumeration. Documents over ``long_factor`` times their
    source's mean length are drawn first; the odds of the others are then set
    so that they make up for the tokens by which those landed off. Longer
    documents fly first, so that only short ones are open at the end. Random
    numbers are hashes of the doc_id and ``seed``, and sizes and flights are
    written before use, so repeated tasks agree.

    Documents without tokens, without id or of other sources aren't listed; a
    repeated doc_id counts once. Sources without documents get nothing. With no
    documents or targets the result is empty. Only ``targets`` (checked against
    ``max_sources``) and sums per source reach the driver.
    """
    goal = targets.where("source is not null").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    rows = goal.limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} target sources")
    names = [r["source"] for r in rows]
    sized = materialize(
        docs.select("doc_id", "text", F.lower(F.trim("source")).alias("source"))
        .where(F.col("doc_id").isNotNull() & F.col("source").isin(names))
        .select("doc_id", "source", token_count(F.col("text"), tokenizer).alias("tokens"))
        .where("tokens > 0")
        .dropDuplicates(["doc_id"])
    )
    own, mean = {}, {}
    for r in sized.groupBy("source").agg(F.sum("tokens").alias("t"), F.avg("tokens").alias("m")).collect():
        own[r["source"]], mean[r["source"]] = int(r["t"]), float(r["m"])
    have = np.array([own.get(n, 0) for n in names], dtype=float)
    repeats = np.array([max(0, int(r["repeats"] or 0)) for r in rows], dtype=float)
    shares = np.array([max(0.0, float(r["share"] or 0)) for r in rows])
    sizes = water_fill(have.sum(), shares / shares.sum() if shares.sum() else shares, have * repeats)
    ratio = np.divide(sizes, have, out=np.zeros_like(sizes), where=have > 0)
    whole = np.minimum(np.floor(ratio + EPS), repeats)
    odds = dict(zip(names, np.clip(ratio - whole, 0, 1).tolist()))
    told = _facts(sized, mean=mean).withColumn("is_long", F.col("tokens") > long_factor * F.col("mean"))
    longs = materialize(_round(told.where("is_long").select(sized.columns), odds, seed))
    left = {n: odds[n] * own.get(n, 0) for n in names}
    rest = dict(own)
    for r in longs.groupBy("source").agg(F.sum(F.col("tokens") * F.col("x")).alias("used"), F.sum("tokens").alias("t")).collect():
        left[r["source"]] -= r["used"]
        rest[r["source"]] -= r["t"]
    again = {n: min(1.0, max(0.0, left[n] / rest[n])) for n in names if rest.get(n)}
    shorts = _round(told.where("not is_long").select(sized.columns), again, seed + 2)
    return _facts(longs.unionByName(shorts), base=dict(zip(names, whole.tolist()))).select("doc_id", "source", "tokens", (F.col("base") + F.col("x")).cast("int").alias("uses"))


def mix_shares(uses: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: target_share, documents used, times used, tokens and actual_share of the mix."""
    goal = targets.where("source is not null").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    sums = uses.groupBy("source").agg(
        F.sum((F.col("uses") > 0).cast("long")).alias("documents"), F.sum(F.col("uses").cast("long")).alias("times_used"),
        F.max("uses").alias("most_uses"), F.sum(F.col("tokens").cast("long") * F.col("uses")).alias("mixed_tokens"),
    )
    total = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1)))  # as many rows as targets
    return (
        goal.join(sums, "source", "left").withColumn("total", total)
        .select("source", "target_share", "max_repeats", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "times_used", "most_uses", "mixed_tokens")), F.round(F.coalesce(F.col("mixed_tokens") / F.col("total"), F.lit(0.0)), 9).alias("actual_share"))
    )
