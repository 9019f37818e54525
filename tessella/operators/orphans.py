"""References to records that do not exist (yet, any more, or at all)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.bloom import MAX_BITS, BloomFilter


def find_orphans(refs: DataFrame, parents: DataFrame, *, max_bits: int = MAX_BITS) -> DataFrame:
    """Rows of ``refs`` whose key was in no parent row at that time.

    refs: (id, ref_id, at, ...); parents: (key, valid_from, valid_to), where a
    null ``valid_to`` means still valid. A reference is good if some parent row
    has exactly its key, valid_from <= at and valid_to null or > at.

    A broadcast Bloom filter of the parent keys (never above ``max_bits``)
    proves most orphans without a shuffle; only references it lets through are
    verified by an exact anti-join. Parent rows are combined per (key,
    valid_to) first, so repeated deliveries of a hot key shrink to one row
    before the shuffle; the anti-join's left side may be split by AQE.

    Null and blank references are no references. A null ``at`` matches no
    parent, so such a reference is an orphan. Parents with a null key or null
    ``valid_from`` are ignored. Empty parents make every reference an orphan.
    Other columns of ``refs`` pass through.
    """
    live = (
        parents.where(F.col("key").isNotNull() & F.col("valid_from").isNotNull())
        .groupBy(F.col("key").alias("_key"), F.col("valid_to").alias("_to"))
        .agg(F.min("valid_from").alias("_from"))
    )
    asked = refs.where(F.col("ref_id").isNotNull() & (F.trim("ref_id") != ""))
    bloom = BloomFilter.build(parents.select("key"), "key", max_bits=max_bits)
    probed = bloom.probe(asked, "ref_id", "__may_have_parent")
    proven = probed.where("not __may_have_parent").drop("__may_have_parent")
    open_ = probed.where("__may_have_parent").drop("__may_have_parent").alias("r")
    verified = open_.join(
        live.alias("p"),
        (F.col("r.ref_id") == F.col("p._key"))
        & (F.col("p._from") <= F.col("r.at"))
        & (F.col("p._to").isNull() | (F.col("p._to") > F.col("r.at"))),
        "left_anti",
    )
    return proven.unionByName(verified)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts per referenced table and month: (referenced_table, month, references, items).

    A URL refers to lessons, everything else to chunk; a null time gives month null.
    """
    return (
        orphans.groupBy(
            F.when(F.col("ref_id").rlike("^[a-z]+://"), "lessons").otherwise("chunk").alias("referenced_table"),
            F.date_format("at", "yyyy-MM").alias("month"),
        )
        .agg(F.count("*").alias("references"), F.countDistinct("id").alias("items"))
    )
