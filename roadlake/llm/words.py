"""Words of whole Arrow batches as numpy arrays: positions, hashes, hashes of word
sequences, and content-selected anchors.

A word is ``[^\\x20\\x09-\\x0D]+``. Hashes are sums of byte (or word) values times powers of an
odd base modulo 2**64, so that the hash of any stretch is a difference of two prefix sums.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_rng = np.random.default_rng(20_240_607)
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_BASES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93]
_WORD = np.ones(256, bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _pow(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, at least n of each."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        base, size = _BASES[which], max(n, 1 << 16)
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            pair.append(np.cumprod(a))
        have = _powers[which] = (pair[0], pair[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class Sums:
    """Hashes of stretches of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, base: int):
        p, self._inverse = _pow(base, len(values) + 1)
        self._sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * p[: len(values)], out=self._sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self._sums[end] - self._sums[start]) * self._inverse[start]
        return mix(raw + (end - start).astype(np.uint64) * _U(0x9FB21C651E98DF25))


def find(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the first word of each text (with the end)."""
    n = len(data)
    is_word = _WORD[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.ones(n, bool)
    before[1:] = ~is_word[:-1]
    after = np.ones(n, bool)
    after[:-1] = ~is_word[1:]
    starts = np.flatnonzero(is_word & (before | edge[:n]))
    ends = np.flatnonzero(is_word & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Sums(_BYTE[data], 0).hash(starts, ends)


def anchors(seeds: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` seeds, the index of its smallest one (the first of equals)."""
    n = len(seeds)
    best = np.arange(n)
    span = 1

    def narrower(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(seeds[b] < seeds[a], b, a)

    while span * 2 <= width:
        best = narrower(best[:-span], best[span:])
        span *= 2
    rest = width - span
    return narrower(best[:-rest], best[rest:]) if rest else best


class Selected:
    """The windows of all texts of a batch and the anchor each selects.

    ``window`` words make a window and ``seed`` words a seed; the anchor of a window is its
    smallest seed, so equal windows select equal places. ``start`` and ``count`` describe runs of
    windows with one anchor: word index of the first window (in the batch) and how many.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, window: int, seed: int):
        self.starts, self.ends, self.first = find(data, off)
        w = self.words = hashes(data, self.starts, self.ends)
        n_words = np.diff(self.first)
        self.a, self.b = Sums(w, 1), Sums(mix(w ^ _U(0xA0761D6478BD642F)), 2)
        n_seeds = max(0, len(w) - seed + 1)
        at = np.arange(n_seeds)
        seeds = self.a.hash(at, at + seed)
        n_windows = np.maximum(n_words - window + 1, 0)
        self.row = np.repeat(np.arange(len(n_words)), n_windows)
        if not len(self.row):
            self.start = self.count = self.anchor = np.zeros(0, np.int64)
            self.seed = np.zeros(0, np.uint64)
            return
        where = np.arange(len(self.row)) + np.repeat(self.first[:-1] - (np.cumsum(n_windows) - n_windows), n_windows)
        chosen = anchors(seeds, window - seed + 1)[where]
        new = np.ones(len(where), bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (self.row[1:] != self.row[:-1])
        head = np.flatnonzero(new)
        self.row, self.start, self.anchor = self.row[head], where[head], chosen[head]
        self.count = np.diff(np.append(head, len(where)))
        self.seed = seeds[self.anchor]

    def stretch(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for each stretch of words."""
        return self.a.hash(start, end).view(np.int64), self.b.hash(start, end).view(np.int64)
