"""Exact quantiles of groups of any size, without holding a group's values in one buffer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of equal width into which a group's values are cut.
BINS = 1024


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys..., one column per share): linearly interpolated quantiles, as ``percentile`` gives them.

    Equal values are counted together first. A group is cut into ``BINS`` ranges between its
    extremes; their counts, at most ``BINS`` rows a group, tell in which ranges
    the wanted ranks lie, and only values of those ranges are ranked, in a
    window per (group, range). So neither a buffer nor a task holds all
    distinct values of a group. Nulls are left out; groups without values don't
    appear. Null keys form a group.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    counts = rows.where(F.col(value).isNotNull()).groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(value).cast("double").alias("x")).agg(F.count("*").alias("n"))
    ends = counts.groupBy(*names).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("n").alias("total"))

    def both(a: DataFrame, b: DataFrame, more: list[str] = ()) -> DataFrame:
        a, b = a.alias("a"), b.alias("b")
        on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*names, *more]]
        joined = a.crossJoin(b) if not on else a.join(b, on)  # without keys, one side is one row
        extra = [c for c in b.columns if c not in names and c not in more]
        return joined.select("a.*", *[f"b.{c}" for c in extra])

    binned = both(counts, ends).withColumn("bin", F.least(F.lit(BINS - 1), F.coalesce(F.floor(F.try_divide((F.col("x") - F.col("lo")) * BINS, F.col("hi") - F.col("lo"))), F.lit(0))).cast("int"))
    per = binned.groupBy(*names, "bin").agg(F.sum("n").alias("n"), F.first("total").alias("total"))
    upto = Window.partitionBy(*(names or [F.lit(1)])).orderBy("bin")
    spans = per.withColumn("before", F.sum("n").over(upto) - F.col("n"))  # at most BINS rows a group
    ranks = [(F.lit(q) * (F.col("total") - 1)) for q in shares.values()]
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(r), F.ceil(r)) for r in ranks])))
    held = spans.where(F.exists(wanted, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))).select(*names, "bin", "before")
    inner = both(binned.select(*names, "bin", "x", "n", "total"), held, ["bin"])
    placed = inner.withColumn("last", F.col("before") + F.sum("n").over(Window.partitionBy(*names, "bin").orderBy("x")) - 1).withColumn("first", F.col("last") - F.col("n") + 1)
    at = lambda r: F.max(F.when((F.col("first") <= r) & (F.col("last") >= r), F.col("x")))
    picked = placed.groupBy(*names).agg(*[x for (c, _), r in zip(shares.items(), ranks) for x in (at(F.floor(r)).alias(f"_lo_{c}"), at(F.ceil(r)).alias(f"_hi_{c}"))], F.first("total").alias("total"))
    out = [(F.col(f"_lo_{c}") + (F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) * (F.lit(q) * (F.col("total") - 1) - F.floor(F.lit(q) * (F.col("total") - 1)))).alias(c) for c, q in shares.items()]
    return picked.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], *out)


def join_groups(sums: DataFrame, quantiles: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``sums`` with the quantiles of their group; groups without values get nulls. Null keys match."""
    if not keys:  # one row each, or none without values
        return sums.join(quantiles, F.lit(True), "left")
    a, b = sums.alias("a"), quantiles.alias("b")
    return a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "left").select("a.*", *[f"b.{c}" for c in quantiles.columns if c not in keys])
