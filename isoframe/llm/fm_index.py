"""FM-index over sequences of words: suffix order, Burrows-Wheeler transform and a wavelet matrix with packed ranks."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The places of all suffixes in order, by prefix doubling. Symbols that end sequences must be distinct and least."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        second = np.zeros(n, np.int64)
        second[:-step or None] = rank[step:] + 1
        key = rank * (n + 2) + second
        order = np.argsort(key)
        new = np.empty(n, np.int64)
        new[order] = np.r_[0, np.cumsum(key[order][1:] != key[order][:-1])]
        rank = new
        if rank.max(initial=0) == n - 1 or step >= n:
            return order
        step *= 2


class Bits:
    """A bit vector with rank: 64-bit words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)].astype(np.int32)
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class Wavelet:
    """Wavelet matrix of symbols below ``size``."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.depth = max(1, int(size - 1).bit_length())
        self.levels = []
        for shift in range(self.depth - 1, -1, -1):
            bits = (symbols >> shift & 1).astype(np.uint8)
            self.levels.append(Bits(bits))
            symbols = np.r_[symbols[bits == 0], symbols[bits == 1]]
        every = np.arange(size)
        self.first = self._down(every, np.zeros(size, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bits in enumerate(self.levels):
            ones = bits.ones(at)
            at = np.where(symbol >> (self.depth - 1 - level) & 1, bits.zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._down(symbol, at) - self.first[symbol]


class FMIndex:
    """Of sequences of word ids from 1; ``owners`` gives each sequence's document."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, owners: np.ndarray, size: int):
        n_seq = len(lengths)
        ends = np.cumsum(lengths + 1) - 1
        text = np.zeros(len(words) + n_seq, np.int64)
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = words
        ordered = text + (n_seq - 1)
        ordered[ends] = np.arange(n_seq)
        order = suffix_order(ordered)
        self.n = len(text)
        self.wavelet = Wavelet(text[order - 1], size)
        self.starts = np.r_[0, np.cumsum(np.bincount(text, minlength=size))]
        # least owner of any range of suffixes, by a table of ranges of powers of two
        least = np.repeat(owners, lengths + 1)[order]
        self.least = [least]
        step = 1
        while 2 * step <= self.n:
            self.least.append(np.minimum(self.least[-1][:-step], self.least[-1][step:]))
            step *= 2

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the ranges after one more symbol in front."""
        at = self.wavelet.rank(np.r_[symbol, symbol], np.r_[low, high])
        base = self.starts[symbol]
        return base + at[: len(symbol)], base + at[len(symbol) :]

    def least_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of ranges that are not empty."""
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.empty(len(low), self.least[0].dtype)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.least[k][low[at]], self.least[k][high[at] - (1 << int(k))])
        return out


def repeated(index: FMIndex, words: np.ndarray, begin: np.ndarray, end: np.ndarray, owner: np.ndarray, window: int) -> np.ndarray:
    """For every word of ``words``: whether a window of its lane that covers it occurs with a smaller owner.

    Lanes are [begin, end) of ``words`` and are searched side by side. A lane tries a stretch from its far end backwards;
    where the search fails, no window that holds the failed part can occur, so the lane moves past it. After a success the
    next stretch is longer, after a failure of a stretch longer than a window it is halved.
    """
    covered = np.zeros(len(words) + 1, np.int32)
    lane = np.flatnonzero(end - begin >= window)
    if not len(lane):
        return covered[:-1] > 0
    stop, own = end[lane], owner[lane]
    left = begin[lane].copy()  # first window not judged yet
    extra = np.zeros(len(lane), np.int64)  # windows in the stretch besides the first
    at = left + window - 1
    last = at.copy()
    low, high = np.zeros(len(lane), np.int64), np.full(len(lane), index.n, np.int64)
    while len(left):
        low, high = index.extend(words[at], low, high)
        ok = high > low
        ok[ok] = index.least_owner(low[ok], high[ok]) < own[ok]
        done = ok & (at == left)
        np.add.at(covered, left[done], 1)
        np.add.at(covered, last[done] + 1, -1)
        short = ~ok & (extra == 0)
        long = ~ok & (extra > 0)
        # next stretch of the lanes whose stretch is judged
        left = np.where(done, last - window + 2, np.where(short, at + 1, left))
        extra = np.where(done, np.minimum(2 * extra + 15, 255), np.where(long, extra // 2, np.where(short, 0, extra)))
        fresh = done | ~ok
        room = stop - window - left
        keep = ~fresh | (room >= 0)
        extra = np.where(fresh, np.minimum(extra, np.maximum(room, 0)), extra)
        last = np.where(fresh, left + window - 1 + extra, last)
        at = np.where(fresh, last, at - 1)
        low, high = np.where(fresh, 0, low), np.where(fresh, index.n, high)
        if not keep.all():
            left, extra, last, at, low, high, stop, own = (x[keep] for x in (left, extra, last, at, low, high, stop, own))
    return np.cumsum(covered[:-1]) > 0
