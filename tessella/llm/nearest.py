"""Matching records of two tables by nearest time within a tolerance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ticks per word of the bit map that tells at which ticks an entity has left rows.
WORD = 63


def tick_candidates(lefts: DataFrame, rights: DataFrame, tol: int, tick: int) -> DataFrame:
    """(entity, tick, past, us, right_id): right rows expanded to the ticks within ``tol`` at which their entity has left rows.

    lefts: (entity, us); rights: (entity, us, right_id), one row per instant.
    Of all right rows of an entity within one tick only the first and the last
    can be nearest to another tick, so two rows per (entity, tick) are
    expanded whatever the density: at most 2 x ticks within the tolerance per
    tick with right rows. Their ticks are read off the entity's bit map, one
    row per (entity, word of 63 ticks), which a right row's words find by an
    equi-join; so no two records meet, and ticks that nobody asks for are
    never made.
    """
    at = F.expr(f"(us - pmod(us, {tick})) div {tick}")
    asked = (
        lefts.select("entity", at.alias("t")).withColumn("word", F.floor(F.col("t") / WORD))
        .groupBy("entity", "word").agg(F.bit_or(F.expr(f"shiftleft(1L, cast(t - word * {WORD} as int))")).alias("bits"))
    )
    order = F.struct("us", "right_id")
    ends = rights.withColumn("own", at).groupBy("entity", "own").agg(F.min(order).alias("first"), F.max(order).alias("last"))
    reach = -(-tol // tick)
    words = ends.withColumn("word", F.explode(F.sequence(F.floor((F.col("own") - reach) / WORD), F.floor((F.col("own") + reach) / WORD))))
    ticks = F.expr(f"filter(sequence(greatest(own - {reach}, word * {WORD}), least(own + {reach}, word * {WORD} + {WORD - 1})), t -> t <> own and (shiftright(bits, cast(t - word * {WORD} as int)) & 1) = 1)")
    spread = words.join(asked, ["entity", "word"]).select("entity", "own", "first", "last", F.explode(ticks).alias("tick"))
    past = F.col("own") < F.col("tick")
    near = F.when(past, F.col("last")).otherwise(F.col("first"))
    return spread.select("entity", "tick", past.alias("past"), near["us"].alias("us"), near["right_id"].alias("right_id"))


def _nearer(us: Column, options: list[Column]) -> Column:
    """The least (distance, right_id) of the options (structs of us and right_id); nulls are passed over."""
    return F.array_min(F.filter(F.array(*[F.when(o.isNotNull(), F.struct(F.abs(o["us"] - us).alias("distance_us"), o["right_id"].alias("right_id"))) for o in options]), lambda x: x.isNotNull()))


def nearest_in_time(left: DataFrame, right: DataFrame, *, tolerance_seconds: int = 120, tick_seconds: int = 1) -> DataFrame:
    """Pair each left row with the nearest right row of its entity.

    left and right: (entity, ts, id). Rows: left_id, right_id, distance_us; of
    two equally near right rows the smaller id counts. Left rows without a
    right row within the tolerance don't appear; a right row may serve many.

    Tick expansion: time is cut into ticks of ``tick_seconds``. Right rows are
    expanded to every tick within the tolerance (see ``tick_candidates``), the
    nearest before and after the tick are kept per (entity, tick) by a
    map-side-combined aggregate, and left rows find them by an equi-join on
    (entity, tick). Right rows within a left row's own tick are met by one sort
    of that tick, so fractions of a tick stay exact. All keys are (entity,
    tick) or (entity, word of ticks), so a hot entity spreads over time.

    Rows with null entity, ts or id take no part; repeated rows count once;
    empty tables give no pairs. Ties are decided by the id, so results are
    deterministic.
    """
    tol, tick = tolerance_seconds * 1_000_000, tick_seconds * 1_000_000

    def rows(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("entity").cast("string").alias("entity"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("id").alias(name)).where(f"entity is not null and us is not null and {name} is not null")

    lefts, rights = rows(left, "left_id").dropDuplicates(["left_id", "entity", "us"]), rows(right, "right_id")
    rights = rights.groupBy("entity", "us").agg(F.min("right_id").alias("right_id"))
    spread = tick_candidates(lefts, rights, tol, tick)
    pair = F.struct("us", "right_id")
    best = spread.groupBy("entity", "tick").agg(F.max(F.when(F.col("past"), pair)).alias("before"), F.min(F.when(~F.col("past"), pair)).alias("after"))
    at = F.expr(f"(us - pmod(us, {tick})) div {tick}").alias("tick")
    both = lefts.select("entity", "us", "left_id", F.lit(None).cast(rights.schema["right_id"].dataType).alias("right_id"), at)
    both = both.unionByName(rights.select("entity", "us", F.lit(None).cast(lefts.schema["left_id"].dataType).alias("left_id"), "right_id", at))
    met = F.when(F.col("right_id").isNotNull(), pair)
    order = Window.partitionBy("entity", "tick").orderBy("us")
    inner = both.select(
        "*", F.last(met, ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, 0)).alias("own_before"),
        F.first(met, ignorenulls=True).over(order.rangeBetween(0, Window.unboundedFollowing)).alias("own_after"),
    ).where("left_id is not null")
    found = inner.join(best, ["entity", "tick"], "left").withColumn("m", _nearer(F.col("us"), [F.col(c) for c in ("before", "own_before", "own_after", "after")]))
    return found.where(F.col("m.distance_us") <= tol).select("left_id", "m.right_id", "m.distance_us")
