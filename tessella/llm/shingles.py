"""Word shingles of whole Arrow batches as hashes, without a Python loop over words."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(97, 123), *range(48, 58)]] = True
_POWERS = {int(x): np.ones(1, dtype=np.uint64) for x in (_P, _Q)}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS[int(base)]
    if len(have) < n:
        have = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 2 * len(have)), base)]), dtype=np.uint64)
        _POWERS[int(base)] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingled:
    """Of a list of texts: ``n_words`` and ``sequence`` (a hash of all words in order) per text,
    ``hashes`` of all shingles of ``k`` words and ``owner``, the text of each (ascending).

    Words are the maximal runs of a-z and 0-9 in the lower-cased text.
    """

    def __init__(self, texts: list[str], k: int) -> None:
        raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
        n = len(raw)
        buf = np.frombuffer(b"\xff".join(raw) + b"\xff", dtype=np.uint8)
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, n) + 1)
        word = _IS_WORD[buf]
        first = word.copy()
        first[1:] &= ~word[:-1]
        starts = np.flatnonzero(first)
        at = np.flatnonzero(word)
        if not len(starts):
            self.n_words, self.sequence = np.zeros(n, np.int64), np.zeros(n, np.uint64)
            self.hashes, self.owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            return
        begin = np.searchsorted(at, starts)
        size = np.diff(np.append(begin, len(at)))
        pos = np.arange(len(at)) - np.repeat(begin, size)
        values = mix(np.add.reduceat(_BYTE[buf[at]] * _powers(_P, int(size.max()) + 1)[pos], begin))
        doc = np.searchsorted(ends, starts, side="right")
        self.n_words = np.bincount(doc, minlength=n)
        head = np.concatenate([[0], np.cumsum(self.n_words)[:-1]])
        place = np.arange(len(values)) - head[doc]
        self.sequence = np.zeros(n, np.uint64)
        full = np.flatnonzero(self.n_words)
        self.sequence[full] = mix(np.add.reduceat(values * _powers(_Q, int(self.n_words.max()) + 1)[place], head[full]) + self.n_words[full].astype(np.uint64))
        m = max(0, len(values) - k + 1)
        h = np.zeros(m, np.uint64)
        for j in range(k):
            h = mix(h * _P + values[j : m + j])
        keep = doc[:m] == doc[k - 1 : m + k - 1]
        self.hashes, self.owner = h[keep], doc[:m][keep]

    def minima(self, rows: np.ndarray, n_hashes: int) -> np.ndarray:
        """(len(rows), n_hashes) MinHash symbols of the texts in ``rows`` (ascending; each with a shingle)."""
        chosen = np.zeros(len(self.n_words), dtype=bool)
        chosen[rows] = True
        use = chosen[self.owner]
        x, owner = self.hashes[use], self.owner[use]
        begin = np.searchsorted(owner, rows)
        rng = np.random.default_rng(7)
        a = rng.integers(1, 2**63, n_hashes, dtype=np.uint64) | np.uint64(1)
        c = rng.integers(1, 2**63, n_hashes, dtype=np.uint64)
        out = np.empty((len(rows), n_hashes), dtype=np.uint64)
        for j in range(n_hashes):
            out[:, j] = np.minimum.reduceat((x ^ c[j]) * a[j], begin) if len(rows) else 0
        return out

    def sets(self, rows: np.ndarray) -> list[np.ndarray]:
        """The distinct shingle hashes of each text in ``rows``, sorted."""
        lo, hi = np.searchsorted(self.owner, rows), np.searchsorted(self.owner, rows, side="right")
        return [np.unique(self.hashes[i:j]) for i, j in zip(lo, hi)]
