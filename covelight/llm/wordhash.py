"""Words, lines and word windows of a block of texts as 64-bit hashes, all by array arithmetic.

A word is a run of bytes other than 0x20 and 0x09-0x0D, so the words of the UTF-8 bytes are the words of the
text. A span's hash is the polynomial of its bytes' random values modulo 2^64, read off two prefix sums, then
mixed; a window's hash is the polynomial of its words' hashes. Two different spans share a hash with a chance
of about 2^-64 a pair, which this package takes as never.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        m = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(m, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[starts[i]:ends[i]]; equal contents have equal hashes wherever they stand."""
    power, inverse = _power(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


@dataclass
class Words:
    """starts, ends: byte positions in the block. first: for each row the index of its first word, and the total."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """The words of each row; lower folds A-Z."""
    solid = ~SPACE[data]
    cuts = offsets[1:-1]
    before, after = np.empty_like(solid), np.empty_like(solid)
    if len(data):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = solid[:-1], solid[1:]
        before[cuts[cuts < len(data)]] = False
        after[cuts[cuts > 0] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    hashes = span_hashes((_LOWER if lower else _BYTE)[data], starts, ends)
    return Words(starts, ends, np.searchsorted(starts, offsets), hashes)


def windows_of(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of each window of `size` words inside one row, in order."""
    counts = np.maximum(np.diff(words.first) - (size - 1), 0)
    total = int(counts.sum())
    begin = np.repeat(words.first[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(total)
    return begin, span_hashes(words.hashes, begin, begin + size)


def covered(n: int, begin: np.ndarray, size: int) -> np.ndarray:
    """Which of n words lie in a window of `size` words that starts at one of `begin`."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, begin, 1)
    np.add.at(edge, np.minimum(begin + size, n), -1)
    return np.cumsum(edge[:n]) > 0


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of flags within each row."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[offsets])


def repeats(row: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """How often each entry's (row, hash) occurs."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    key = hashes ^ mix(row.astype(np.uint64) + np.uint64(1))
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    return counts[inverse]
