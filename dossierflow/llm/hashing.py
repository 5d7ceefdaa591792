"""Word and n-gram hashes of many texts at once, vectorised over the bytes of an Arrow batch."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: bytes hashed at once; longer texts are cut at white space
CHUNK = 1 << 21

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE), np.full(size, _INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(16, int(size).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every bit of the sum reaches every bit of the hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Prefix:
    """Hashes of any ranges of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def ranges(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.down[lo])


def bytes_prefix(data: np.ndarray) -> Prefix:
    return Prefix(_BYTE[data])


class Words:
    """Words of the rows of a slice: byte range, row and hash of each, and each row's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        if n:
            inside = ~SPACE[data]
            edge = np.zeros(n + 1, bool)
            edge[offsets] = True
            before = np.concatenate(([False], inside[:-1]))
            after = np.concatenate((inside[1:], [False]))
            self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
            self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.hashes = self._hash(data)
        #: word number at which each row begins, and one more for the end
        self.first = np.searchsorted(self.starts, offsets, "left")

    def _hash(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.starts), np.uint64)
        lo = 0
        while lo < len(self.starts):
            at = self.starts[lo]
            hi = max(lo + 1, int(np.searchsorted(self.ends, at + CHUNK, "right")))
            part = bytes_prefix(data[at : self.ends[hi - 1]])
            out[lo:hi] = part.ranges(self.starts[lo:hi] - at, self.ends[lo:hi] - at)
            lo = hi
        return out

    def rows(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every run of ``n`` words; a row of fewer, but not none, has one run of all."""
    first, counts = words.first[:-1], np.diff(words.first)
    prefix = Prefix(words.hashes)
    runs = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    row = np.repeat(np.arange(len(counts)), runs)
    place = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs)
    lo = first[row] + place
    return row, prefix.ranges(lo, lo + np.minimum(n, counts[row]))
