"""A pruning filter over keys: a bit array sized by the number of keys, whose positives are verified by a join."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most bits of a filter: 2**28 bits are 32 MB. Beyond that more keys pass, and the joins behind it meet more rows.
MAX_BITS = 1 << 28
MIN_BITS = 1 << 13
BITS_PER_KEY = 16
HASHES = 4


class KeyFilter:
    """Set membership without false negatives; a positive proves nothing, so callers join the keys that pass."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.mask = words, len(words) * 64 - 1

    @staticmethod
    def places(h: np.ndarray, mask: int) -> np.ndarray:
        """(keys, HASHES) bit positions of 64-bit hashes."""
        step = (h >> np.uint64(32)) | np.uint64(1)
        at = h[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        return ((at ^ (at >> np.uint64(29))) & np.uint64(mask)).astype(np.int64)

    @classmethod
    def build(cls, keys: DataFrame, *, max_bits: int = MAX_BITS, bits_per_key: int = BITS_PER_KEY) -> "KeyFilter":
        """keys: one string or 64-bit column, nulls left out. Each task sends its set words once, combined by bit_or."""
        n = max(1, keys.count())
        bits = max(64, min(max_bits, max(MIN_BITS, 1 << math.ceil(math.log2(n * bits_per_key)))))
        mask = bits - 1

        def run(batches):
            words = np.zeros(bits >> 6, dtype=np.int64)
            for batch in batches:
                column = batch.column(0).drop_null()
                h = hashes(column.to_pylist()) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.to_numpy(zero_copy_only=False).view(np.uint64)
                p = cls.places(h, mask).ravel()
                np.bitwise_or.at(words, p >> 6, np.int64(1) << (p & 63))
            at = np.flatnonzero(words)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], names=["w", "b"])

        rows = keys.mapInArrow(run, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
        words = np.zeros(bits >> 6, dtype=np.int64)
        words[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64)
        return cls(words)

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        """Per 64-bit hash whether its key may be in the set."""
        if not len(h):
            return np.zeros(0, dtype=bool)
        p = self.places(h, self.mask)
        return ((self.words[p >> 6] >> (p & 63)) & 1 == 1).all(axis=1)

    def may_hold_text(self, key: str) -> bool:
        return bool(self.may_hold(hashes([key]))[0])


def hashes(keys: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
