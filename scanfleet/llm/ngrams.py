"""Sets of word n-grams as sorted 64-bit hashes, and MinHash band keys, in numpy."""

from __future__ import annotations

import math

import numpy as np

_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit changes about half of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SYMBOL = mix(np.arange(1, 257, dtype=np.uint64))


class Powers:
    """Powers of the base and of its inverse, as far as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(n, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))


_powers = Powers()


def words(text: str | None) -> list[str]:
    """Lower-cased runs without white space."""
    return (text or "").lower().split()


def ngram_set(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's n-grams of words. A text of fewer words is one n-gram; one without words has none."""
    found = words(text)
    if not found:
        return np.empty(0, dtype=np.uint64)
    data = np.frombuffer(" ".join(found).encode(), dtype=np.uint8)
    _powers.reach(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_SYMBOL[data] * _powers.up[: len(data)], out=sums[1:])
    gaps = np.flatnonzero(data == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
    k = min(n, len(starts))
    starts, ends = starts[: len(starts) - k + 1], ends[k - 1 :]
    return np.unique(mix((sums[ends] - sums[starts]) * _powers.down[starts]))


def bands_for(similarity: float, rows: int, recall: float) -> int:
    """The fewest bands of ``rows`` rows that find a pair of ``similarity`` with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 1):
        k = np.arange(bands * rows, dtype=np.uint64) + np.uint64(seed << 32)
        self.factor, self.shift = mix(k * np.uint64(2) + np.uint64(1)) | np.uint64(1), mix(k + np.uint64(1 << 48))
        self.bands, self.rows = bands, rows

    def band_keys(self, ngrams: np.ndarray) -> np.ndarray:
        """One 64-bit key per band; equal sets get equal keys, and sets of similarity s share a band's key with probability s**rows."""
        least = np.full(len(self.factor), _M64, dtype=np.uint64)
        for i in range(0, len(ngrams), 512):
            part = ngrams[i : i + 512, None] * self.factor
            part += self.shift
            np.minimum(least, part.min(axis=0), out=least)
        key = np.arange(self.bands, dtype=np.uint64)
        for column in least.reshape(self.bands, self.rows).T:
            key = mix(key * np.uint64(_BASE) + column)
        return key
