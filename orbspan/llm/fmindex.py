"""FM-index over the letters of one shard, in numpy.

Letters are 1..31 and 0 separates documents.  Suffixes are sorted by their first
DEPTH letters, which is exact for phrases of up to DEPTH letters; the
Burrows-Wheeler letters go into a wavelet matrix of five bit levels with block
counts.  All phrases step back together: two ranks per letter and phrase.  The
index lives as long as one task, so the position of every suffix is kept (a
sampling rate of 1): four bytes a letter, where sampled positions would need
suffixes that are sorted to their end to step to the next sample.
"""

from __future__ import annotations

import numpy as np

HALF = 12
DEPTH = HALF
_BITS = 5


def packed(letters: np.ndarray) -> np.ndarray:
    """The HALF letters from each position on, five bits each; past the end come zeros."""
    n = len(letters)
    one = np.zeros(n + HALF, dtype=np.int64)
    one[:n] = letters
    two = (one[:-1] << 5) | one[1:]
    four = (two[:-2] << 10) | two[2:]
    eight = (four[:-4] << 20) | four[4:]
    return (eight[: n] << 20) | four[8 : 8 + n]


class FmIndex:
    def __init__(self, letters: np.ndarray):
        self.n = n = len(letters)
        order = np.argsort(packed(letters))
        self.positions = order.astype(np.int32)
        before = np.concatenate([letters[-1:], letters[:-1]])[order] if n else letters
        self.first = np.r_[0, np.cumsum(np.bincount(letters, minlength=1 << _BITS))]
        self.levels = []
        for bit in range(_BITS - 1, -1, -1):
            ones = ((before >> bit) & 1).astype(bool)
            words = np.zeros((n // 64 + 1) * 8, dtype=np.uint8)
            bits = np.packbits(ones, bitorder="little")
            words[: len(bits)] = bits
            words = words.view(np.uint64)
            counts = np.bitwise_count(words).astype(np.int64)
            self.levels.append((words, np.cumsum(counts) - counts, n - int(ones.sum())))
            before = np.concatenate([before[~ones], before[ones]])
        self.begin = self._walk(np.arange(1 << _BITS), np.zeros(1 << _BITS, dtype=np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, (words, counts, zeros) in zip(range(_BITS - 1, -1, -1), self.levels):
            w = at >> 6
            low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = counts[w] + np.bitwise_count(words[w] & low)
            at = np.where((symbol >> bit) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Number of each symbol among the first ``at`` letters before the sorted suffixes."""
        return self._walk(symbol, at) - self.begin[symbol]

    def search(self, phrases: np.ndarray, low=None, high=None) -> tuple[np.ndarray, np.ndarray]:
        """[low, high) of the suffixes that start with each phrase (q, k); given bounds are extended to the left."""
        q, k = phrases.shape
        low = np.zeros(q, dtype=np.int64) if low is None else low.copy()
        high = np.full(q, self.n, dtype=np.int64) if high is None else high.copy()
        open_ = np.flatnonzero(low < high)
        for j in range(k - 1, -1, -1):
            c = phrases[open_, j].astype(np.int64)
            low[open_] = self.first[c] + self.rank(c, low[open_])
            high[open_] = self.first[c] + self.rank(c, high[open_])
            open_ = open_[low[open_] < high[open_]]
        return low, np.maximum(low, high)

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position) of all occurrences."""
        size = high - low
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        rows = np.arange(total) + np.repeat(low - (ends - size), size)
        return np.repeat(np.arange(len(low)), size), self.positions[rows].astype(np.int64)
