"""Numpy helpers over packed UTF-8 texts: one byte array and the offsets of its documents.

Everything here is vectorised over a whole pack; a document boundary is never crossed."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_STEP = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2^64
_BACK = pow(_STEP, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_VALUES = mixed((np.arange(1, 257, dtype=U64)) * U64(_BASE))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept and grown on demand."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 19)
        out = np.empty(size, U64)
        out[0] = 1
        done = 1
        while done < size:
            take = min(done, size - done)
            out[done : done + take] = out[:take] * U64(pow(base, done, 1 << 64))
            done += take
        have = _powers[base] = out
    return have[:n]


class Rolling:
    """Hashes of any stretch of `values` in constant time, from running sums."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.empty(n + 1, U64)
        self.sums[0] = 0
        np.cumsum(values * powers(_STEP, n), out=self.sums[1:])
        self.back = powers(_BACK, n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.back[starts])

    def every(self, width: int) -> np.ndarray:
        """The hash of each stretch of `width` values, by its start."""
        return mixed((self.sums[width:] - self.sums[:-width]) * self.back[: len(self.sums) - width])


def word_bounds(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the offsets of the documents in words."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~space[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Rolling(BYTE_VALUES[data]).of(starts, ends)


def owners(offsets: np.ndarray) -> np.ndarray:
    """For each element the index of its document."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def window_starts(offsets: np.ndarray, width: int) -> np.ndarray:
    """Starts of all stretches of `width` elements that stay in one document."""
    total = int(offsets[-1])
    if total < width:
        return np.zeros(0, np.int64)
    lengths = np.diff(offsets)
    good = np.ones(total, np.int8)
    tails = offsets[1:][lengths > 0]
    marks = np.zeros(total + 1, np.int64)
    # the last width-1 elements of a document start no window
    np.add.at(marks, np.maximum(tails - (width - 1), offsets[:-1][lengths > 0]), 1)
    np.add.at(marks, tails, -1)
    good = np.cumsum(marks[:-1]) == 0
    return np.flatnonzero(good)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each stretch of `width` values, by its start."""
    span, out = 1, values
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def covered(total: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of `total` elements lie in one of the stretches."""
    marks = np.zeros(total + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, ends, -1)
    return np.cumsum(marks[:-1]) > 0


def runs(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The number of maximal runs of true elements in each document."""
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    first[edges] = mask[edges]
    return per_document(first, offsets)


def per_document(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of `values` by document."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]
