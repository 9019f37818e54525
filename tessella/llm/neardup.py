"""Near-duplicate texts by meet-in-the-middle ball hashing of MinHash fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import floor, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.filters import KeyFilter
from tessella.llm.shingles import Shingled, mix
from tessella.operators.components import connected_components
from tessella.session import materialize

SYMBOLS, RADIUS, FINGERPRINTS = 3, 1, 8
#: Symbols of the sketch that travels with a variant (four bits each), and of the second, finer one (eight bits each).
COARSE, FINE = 56, 128
#: One class in so many is looked at to tell which variants are crowded.
SAMPLED = 64
#: Bytes of text that are shingled at once.
BYTES = 1 << 21


def variants(symbols: np.ndarray, radius: int, number: int) -> np.ndarray:
    """All variants of fingerprints with ``radius`` symbols deleted, one 64-bit key each.

    symbols: (texts, symbols per fingerprint). Two fingerprints that differ in
    at most ``radius`` symbols lie within 2 x radius deletions and insertions
    of one another; deleting from each side, half of that, they meet in a
    common variant.
    """
    m = symbols.shape[1]
    out = []
    for k, gone in enumerate(combinations(range(m), radius)):
        h = np.full(len(symbols), np.uint64(number * 1009 + k + 1))
        for j in range(m):
            if j not in gone:
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + symbols[:, j])
        out.append(h)
    return np.stack(out, axis=1)


def _texts(batches: Iterator[pa.RecordBatch], k: int, min_words: int):
    """The batch of (id, text, hash of the id), the shingles, the rows with enough words and their class ids, of some MB of text at a time."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)) if batch.num_rows else []
        start = 0
        while start < batch.num_rows:
            held = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, held + BYTES, side="right")))
            part = batch.slice(start, stop - start)
            start = stop
            s = Shingled(part.column(1).to_pylist(), k)
            rows = np.flatnonzero(s.n_words >= max(min_words, k))
            if len(rows):
                yield part, s, rows, s.sequence[rows].view(np.int64)


def _classes(batches, k: int, min_words: int, n_symbols: int):
    """Per batch the class ids that are new in this partition, the id hash of the row that has each, and its MinHash symbols."""
    seen: set[int] = set()
    for part, s, rows, cls in _texts(batches, k, min_words):
        new = np.array([not (c in seen or seen.add(c)) for c in cls.tolist()], dtype=bool)
        rows, cls = rows[new], cls[new]
        if len(rows):
            yield cls, part.column(2).to_numpy(zero_copy_only=False)[rows], s.minima(rows, max(COARSE, n_symbols))


def _short(signs: np.ndarray) -> np.ndarray:
    """The symbols in 32 bits each; equal ones stay equal, and a chance agreement is found out when the pair is verified."""
    return mix(signs).astype(np.uint32)


def _all_variants(symbols: np.ndarray, fingerprints: int, n: int, radius: int) -> np.ndarray:
    """(texts, variants) of short symbols, ``n`` to each fingerprint."""
    wide = symbols.astype(np.uint64)
    return np.concatenate([variants(wide[:, t * n : (t + 1) * n], radius, t) for t in range(fingerprints)], axis=1)


def _sample_keys(k: int, min_words: int, fingerprints: int, symbols: int, radius: int):
    """(key, cls) of the variants of all texts given."""

    def run(batches):
        for cls, _, signs in _classes(batches, k, min_words, fingerprints * symbols):
            keys = _all_variants(_short(signs[:, : fingerprints * symbols]), fingerprints, symbols, radius)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(cls, keys.shape[1]))], names=["key", "cls"])

    return run


def _emit_classes(k: int, min_words: int, n_symbols: int):
    """(cls, first, symbols, sketch) of the classes in this partition; first: the id hash of a row that has the text."""

    def run(batches):
        for cls, first, signs in _classes(batches, k, min_words, n_symbols):
            yield pa.RecordBatch.from_arrays(
                [pa.array(cls), pa.array(first), _binary(_short(signs[:, :n_symbols]).view(np.uint8)), _binary(nibbles(signs))], names=["cls", "first", "symbols", "sketch"]
            )

    return run


def _once(batches):
    """Of rows sorted by their first column, a class id, the first one of each class."""
    last = None
    for batch in batches:
        cls = batch.column(0).to_numpy(zero_copy_only=False)
        if len(cls):
            new = np.ones(len(cls), dtype=bool)
            new[1:] = cls[1:] != cls[:-1]
            new[0] = last is None or cls[0] != last
            last = cls[-1]
            yield batch.filter(pa.array(new))


def nibbles(signs: np.ndarray) -> np.ndarray:
    """Four bits of each of the first ``COARSE`` symbols, two to a byte."""
    low = (mix(signs[:, :COARSE]) & np.uint64(15)).astype(np.uint8)
    return low[:, ::2] | (low[:, 1::2] << np.uint8(4))


def agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many nibbles of the sketches x and y (rows of 32-bit words) are equal."""
    d = x ^ y
    d |= d >> np.uint32(1)
    d |= d >> np.uint32(2)
    return COARSE - np.bitwise_count(d & np.uint32(0x11111111)).sum(axis=1, dtype=np.int64)


def _emit_keys(crowded, fingerprints: int, symbols: int, radius: int):
    """(key, class, sketch) of all variants of the classes given; those with a crowded variant come out once more, with null key."""

    def run(batches):
        hot = crowded.value
        for batch in batches:
            if not batch.num_rows:
                continue
            cls, sketch = batch.column(0).to_numpy(zero_copy_only=False), _fixed(batch.column(2), COARSE // 2)
            keys = _all_variants(_fixed(batch.column(1), 4 * fingerprints * symbols).view(np.uint32), fingerprints, symbols, radius)
            flat = keys.ravel()
            free = ~hot.may_hold(flat) if hot is not None else np.ones(len(flat), dtype=bool)
            at = np.flatnonzero(free)
            whose = at // keys.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)[at]), pa.array(cls[whose]), _binary(sketch[whose])], names=["key", "cls", "sketch"])
            rest = np.unique(np.flatnonzero(~free) // keys.shape[1])
            if len(rest):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(rest), pa.int64()), pa.array(cls[rest]), pa.nulls(len(rest), pa.binary())], names=["key", "cls", "sketch"])

    return run


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def least_agreeing(n_symbols: int, threshold: float, values: int = 256, deviations: float = 3.95) -> int:
    """How many symbols of two sketches (of so many values) must agree; a pair at the threshold falls short as often as a normal variable by ``deviations``."""
    p = threshold + (1 - threshold) / values
    return floor(n_symbols * p - deviations * sqrt(n_symbols * p * (1 - p)))


def _collide(max_bucket: int, least: int):
    """Rows sorted by (key, cls) to the pairs (a, b) of each key group whose sketches agree enough.

    A group above max_bucket gives its classes as (a, null).
    """
    width = COARSE // 2

    def run(batches):
        rest_k, rest_c, rest_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, width), np.uint8)
        hot_key = None

        def out(a: list[np.ndarray], b: list[np.ndarray], crowd: np.ndarray) -> pa.RecordBatch:
            left = np.concatenate([*a, crowd])
            null = np.arange(len(left)) >= len(left) - len(crowd)
            return pa.RecordBatch.from_arrays([pa.array(left), pa.array(np.concatenate([*b, np.zeros(len(crowd), np.int64)]), mask=null)], names=["a", "b"])

        def pairs(k, c, s):
            begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            size = np.diff(np.append(begin, len(k)))
            hot = np.repeat((size > max_bucket) | (k[begin] == hot_key if hot_key is not None else False), size)
            keep = np.flatnonzero(~hot & np.repeat(size > 1, size))
            k2, c2, s2 = k[keep], c[keep], np.ascontiguousarray(s[keep]).view(np.uint32)
            a, b = [], []
            same = np.arange(len(k2))
            for lag in range(1, max_bucket):  # of those with a partner at this distance, some have one at the next
                same = same[same + lag < len(k2)]
                same = same[k2[same + lag] == k2[same]]
                if not len(same):
                    break
                for part in np.array_split(same, len(same) // 100_000 + 1):
                    part = part[agreeing(s2[part], s2[part + lag]) >= least]
                    a.append(c2[part])
                    b.append(c2[part + lag])
            return out(a, b, c[hot])

        for batch in batches:
            lone = batch.column(0).null_count  # null keys come first
            if lone:
                yield out([], [], np.unique(batch.column(1).slice(0, lone).to_numpy(zero_copy_only=False)))
                batch = batch.slice(lone)
            k = np.concatenate([rest_k, batch.column(0).to_numpy(zero_copy_only=False)])
            c = np.concatenate([rest_c, batch.column(1).to_numpy(zero_copy_only=False)])
            s = np.concatenate([rest_s, _fixed(batch.column(2), width)])
            if not len(k):
                continue
            fresh = np.ones(len(k), dtype=bool)
            fresh[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
            k, c, s = k[fresh], c[fresh], s[fresh]
            cut = int(np.searchsorted(k, k[-1]))  # the last group may go on
            if cut:
                yield pairs(k[:cut], c[:cut], s[:cut])
            rest_k, rest_c, rest_s = k[cut:], c[cut:], s[cut:]
            if len(rest_k) > max_bucket or rest_k[0] == hot_key:  # already known as hot: needn't be held
                hot_key = rest_k[0]
                yield out([], [], rest_c)
                rest_k, rest_c, rest_s = rest_k[:0], rest_c[:0], rest_s[:0]
        if len(rest_k):
            yield pairs(rest_k, rest_c, rest_s)

    return run


def _emit_members(k: int, min_words: int, bloom):
    """(cls, id) of every row; shingles and the fine sketch only with the row that stands for a class asked for, so copies bring none."""

    def run(batches):
        seen: set[int] = set()
        for part, s, rows, cls in _texts(batches, k, min_words):
            ids, first = part.column(0), part.column(2).to_numpy(zero_copy_only=False)[rows]
            wanted = bloom.value.may_hold((cls ^ first).view(np.uint64))
            new = np.array([w and not (c in seen or seen.add(c)) for c, w in zip(cls.tolist(), wanted.tolist())], dtype=bool)
            fresh = rows[new]
            sets, fine = iter(s.sets(fresh)), iter(mix(s.minima(fresh, FINE)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(cls), ids.take(pa.array(rows)), pa.array([next(sets).view(np.int64) if n else None for n in new], pa.list_(pa.int64())),
                    pa.array([next(fine).tobytes() if n else None for n in new], pa.binary()),
                ],
                names=["cls", "id", "shingles", "fine"],
            )

    return run


def _prefix_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """Exact candidates among (cls, shingles): classes that share one of their rarest shingles.

    Sets with Jaccard >= t share a shingle among the n - ceil(t n) + 1 rarest
    of each; shingles that everything shares sort last and bring no candidates.
    """
    flat = sets.select("cls", F.size("shingles").alias("n"), F.explode("shingles").alias("h"))
    freq = flat.groupBy("h").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("cls").orderBy("df", "h"))
    head = flat.join(freq.where("df > 1"), "h", "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("r", rank)
    head = head.where((F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1) & (F.col("df") > 1)).select("h", "cls", "n")
    x, y = head.select("h", F.col("cls").alias("a"), F.col("n").alias("na")), head.select("h", F.col("cls").alias("b"), F.col("n").alias("nb"))
    near = (F.col("a") < F.col("b")) & (F.col("na") >= F.col("nb") * threshold) & (F.col("nb") >= F.col("na") * threshold)
    return x.join(y, "h").where(near).select("a", "b").distinct()


def _agreeing(pairs: DataFrame, fine: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) whose fine sketches agree in at least so many symbols."""

    def agree(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="int64")
        p, q = (np.frombuffer(b"".join(v), np.uint8).reshape(len(v), FINE) for v in (x, y))
        return pd.Series((p == q).sum(axis=1))

    both = pairs.join(fine.select(F.col("cls").alias("a"), F.col("fine").alias("fa")), "a").join(fine.select(F.col("cls").alias("b"), F.col("fine").alias("fb")), "b")
    return both.where(F.pandas_udf(agree, "long")("fa", "fb") >= least).select("a", "b")


def near_duplicates(
    docs: DataFrame, *, id: str, text: str, threshold: float = 0.8, shingle: int = 5, min_words: int = 1,
    fingerprints: int = FINGERPRINTS, symbols: int = SYMBOLS, radius: int = RADIUS, max_bucket: int = 16_384,
) -> tuple[DataFrame, DataFrame]:
    """(links, members): pairs of text classes with their similarity, and the class of each id.

    links: (a, b, similarity), a < b; members: (cls, id). Texts with the same
    words in the same order form one class, whatever their number, so copies
    are compared once. Similarity is the Jaccard coefficient of the distinct
    word shingles; pairs below ``threshold`` are left out.

    Classes are first told apart by a shuffle of one row (some 140 bytes) a
    text, then every class has ``fingerprints`` fingerprints of ``symbols`` MinHash
    symbols. Each emits all variants within half the radius (``radius``
    deletions); the variants are shuffled by key with a sketch of 28 bytes,
    classes that collide are deduplicated and verified exactly on their
    shingles. A pair of similarity J is a candidate with probability
    1 - (1 - p)^fingerprints, p being the chance that at least symbols -
    radius of the symbols agree. Pairs that meet are first compared on two
    sketches of their symbols, which drop far pairs and about one in 750 of
    those at the threshold (one in 50,000 at 0.1 above it). What is shuffled grows in proportion to the classes,
    but for that one row a text; shingles are written once a class.

    A variant shared by more than about ``max_bucket`` classes isn't shuffled:
    such crowded variants are told beforehand from one text in ``SAMPLED``,
    and the classes under them, and under any bucket that the sample missed,
    go through an exact prefix-filter join, in which text shared by all brings
    no candidates. So neither a crowd nor a wrong guess about it loses a link.

    Texts are read three times rather than shuffled. The broadcast filters
    (crowded variants, classes to verify) are sized by what they hold, up to
    32 MB; a full one sends more rows through the exact joins, but the result
    stays the same.

    Rows with null id or text and texts of fewer than ``min_words`` words (or
    fewer than one shingle) take no part. Repeated rows count once; an id with
    two different texts is a member of two classes. Empty tables give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("t"), F.xxhash64(id).alias("h")).where(f"id is not null and t is not null and length(t) >= {2 * min_words - 1}")
    how = (shingle, min_words, fingerprints, symbols, radius)
    sampled = rows.where(F.pmod(F.xxhash64("t"), F.lit(SAMPLED)) == 0).mapInArrow(_sample_keys(*how), "key long, cls long").distinct()
    full = materialize(sampled.groupBy("key").count().where(F.col("count") > max(2, max_bucket // SAMPLED)).select("key"))
    crowded = spark.sparkContext.broadcast(None if full.isEmpty() else KeyFilter.build(full))
    spread = rows.mapInArrow(_emit_classes(shingle, min_words, fingerprints * symbols), "cls long, first long, symbols binary, sketch binary").repartition("cls").sortWithinPartitions("cls")
    classes = materialize(spread.mapInArrow(_once, spread.schema))
    keyed = classes.select("cls", "symbols", "sketch").mapInArrow(_emit_keys(crowded, fingerprints, symbols, radius), "key long, cls long, sketch binary")
    collide = _collide(max_bucket, least_agreeing(COARSE, threshold, 16, 3.0))
    # a null key marks a class under a crowded variant; those are spread by their class
    place = F.coalesce("key", F.xxhash64("cls"))
    met = materialize(keyed.repartition(place).sortWithinPartitions("key", "cls").mapInArrow(collide, "a long, b long").distinct())
    cand = met.where("b is not null")
    crowd = met.where("b is null").select(F.col("a").alias("cls"))
    is_crowd = not crowd.isEmpty()
    asked = cand.select(F.explode(F.array("a", "b")).alias("cls"))
    if is_crowd:
        asked = asked.unionByName(crowd)
    standing = classes.select("cls", "first").join(asked.distinct(), "cls", "left_semi")
    probe = spark.sparkContext.broadcast(KeyFilter.build(standing.select(F.col("cls").bitwiseXOR(F.col("first")))))
    members = materialize(rows.mapInArrow(_emit_members(shingle, min_words, probe), f"cls long, id {docs.schema[id].dataType.simpleString()}, shingles array<long>, fine binary"))
    fine = members.where("fine is not null").groupBy("cls").agg(F.first("fine").alias("fine"))
    near = _agreeing(cand, fine, least_agreeing(FINE, threshold))
    sets = members.where("shingles is not null")
    if is_crowd:
        pairs = _prefix_pairs(sets.join(crowd, "cls", "left_semi").groupBy("cls").agg(F.first("shingles").alias("shingles")), threshold)
        near = near.unionByName(_agreeing(pairs, fine, least_agreeing(FINE, threshold, deviations=6.0))).distinct()  # falls short once in 10**9
    near = materialize(near)
    sets = sets.join(near.select(F.explode(F.array("a", "b")).alias("cls")), "cls", "left_semi").groupBy("cls").agg(F.first("shingles").alias("shingles"))
    both = F.size(F.array_intersect("sa", "sb"))
    links = (
        near.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), "a")
        .join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb")), "b")
        .where((F.size("sa") >= threshold * F.size("sb")) & (F.size("sb") >= threshold * F.size("sa")))
        .select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).alias("sizes"))
        .select("a", "b", (F.col("both") / (F.col("sizes") - F.col("both"))).alias("similarity"))
        .where(F.col("similarity") >= threshold)
    )
    return links, members.select("cls", "id").distinct()


def expand_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of different ids, (id_a, id_b) with id_a < id_b: linked classes and copies within a class.

    Two ids of one class each meet once only, so their pairs, which copies
    multiply, go out as they are joined; only pairs with an id of several
    classes are shuffled to be made distinct.
    """
    # by id alone, so that one shuffle serves both the distinct rows and the count of an id's classes
    told = materialize(members.select("cls", "id").repartition("id").distinct().withColumn("many", F.count("*").over(Window.partitionBy("id")) > 1))
    solo, many = told.where("not many"), told.where("many")

    def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
        x, y = left.select(F.col("cls").alias("a"), F.col("id").alias("i")), right.select(F.col("cls").alias("b"), F.col("id").alias("j"))
        across = links.select("a", "b").join(x, "a").join(y, "b").select("i", "j").where("i <> j")
        within = x.join(y, F.col("a") == F.col("b")).where("i < j").select("i", "j")
        return across.unionByName(within).select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"))

    if many.isEmpty():
        return pairs(solo, solo)
    links = materialize(links)
    return pairs(solo, solo).unionByName(pairs(many, told).unionByName(pairs(solo, many)).distinct())


def near_groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """One row per id: cls, its number of linked other classes (n_links) and its group (the least class linked, over any path)."""
    links = materialize(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links"))
    comp = connected_components(links.select("a", "b"))
    return (
        members.join(degree, "cls", "left").join(comp.withColumnRenamed("node", "cls"), "cls", "left")
        .select("id", "cls", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "cls").alias("group_id"))
    )
