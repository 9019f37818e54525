"""A Bloom filter of bounded size, built on the JVM and probed from Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most bits that are ever broadcast: 2**26 bits are 8 MB whatever the number of keys.
MAX_BITS = 1 << 26
MIN_BITS = 1 << 13


class BloomFilter:
    """Set membership without false negatives; ``bits`` is a power of two.

    The filter never exceeds ``max_bits``. With more keys than it is made for,
    only its false-positive rate rises; callers verify positives exactly, so
    results don't depend on its size.
    """

    def __init__(self, words: np.ndarray, hashes: int) -> None:
        self.words, self.hashes = words, hashes
        self.bits = len(words) * 64

    @staticmethod
    def _h(key: Column) -> tuple[Column, Column]:
        return F.xxhash64(key), F.xxhash64(key, F.lit(17)).bitwiseOR(F.lit(1))

    @classmethod
    def build(cls, keys: DataFrame, key: str, bits_per_key: int = 12, max_bits: int = MAX_BITS) -> "BloomFilter":
        """One aggregation: each task combines its keys to at most bits/64 words before the shuffle.

        Nulls are left out. What reaches the driver is the bit array itself.
        """
        n = max(1, keys.select(F.approx_count_distinct(key)).first()[0])
        bits = min(max_bits, max(MIN_BITS, 1 << math.ceil(math.log2(n * bits_per_key))))
        hashes = max(1, min(8, round(0.69 * bits / n)))
        h1, h2 = cls._h(F.col(key))
        at = [(F.col("h1") + F.lit(i) * F.col("h2")).bitwiseAND(F.lit(bits - 1)) for i in range(hashes)]
        rows = (
            keys.where(F.col(key).isNotNull())
            .select(h1.bitwiseAND(F.lit((1 << 40) - 1)).alias("h1"), h2.bitwiseAND(F.lit((1 << 40) - 1)).alias("h2"))
            .select(F.explode(F.array(*at)).alias("p"))
            .groupBy(F.shiftright("p", 6).alias("w"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
            .toPandas()
        )
        words = np.zeros(bits // 64, dtype=np.int64)
        words[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64)
        return cls(words, hashes)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h1), dtype=bool)
        for i in range(self.hashes):
            p = (h1 + i * h2) & (self.bits - 1)
            ok &= (self.words[p >> 6] >> (p & 63)) & 1 == 1
        return ok

    def probe(self, df: DataFrame, key: str, into: str) -> DataFrame:
        """Add the boolean ``into``: False proves that the key is in no parent row. A null key gives False."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("boolean")
        def might_contain(h1: pd.Series, h2: pd.Series) -> pd.Series:
            return pd.Series(shared.value.contains(h1.to_numpy(np.int64), h2.to_numpy(np.int64)))

        mask = F.lit((1 << 40) - 1)
        h1, h2 = self._h(F.col(key))
        return df.withColumn(into, might_contain(h1.bitwiseAND(mask), h2.bitwiseAND(mask)) & F.col(key).isNotNull())
