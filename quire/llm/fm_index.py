"""A word-level FM-index: suffix order, Burrows-Wheeler transform, wavelet matrix, sampled positions.

Symbol 0 is a separator and matches nothing; every separator counts as different from every other,
so the suffix order is settled within one run between separators. Plain numpy, no Spark.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start positions in suffix order, by prefix doubling over what is not settled yet.

    The last symbol must be a separator.
    """
    n = len(symbols)
    separators = symbols == 0
    m = int(separators.sum())
    rank = symbols.astype(np.int64) + m  # words after all separators
    rank[separators] = np.arange(m)
    key = rank * (int(rank.max(initial=0)) + 1)
    key[:-1] += rank[1:]
    key[separators] = rank[separators] * (int(rank.max(initial=0)) + 1)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    slot = np.arange(n)
    fresh = np.r_[True, ranked[1:] != ranked[:-1]]
    group = np.maximum.accumulate(np.where(fresh, slot, 0))
    rank[order] = group
    span = 2
    last = np.r_[fresh[1:], True]
    slots = np.flatnonzero(~(fresh & last))  # slots of groups with two or more members
    while len(slots):
        at = order[slots]
        sub = rank[at] * (n + 1) + rank[at + span]
        by = np.argsort(sub, kind="stable")
        at, sub = at[by], sub[by]
        order[slots] = at
        fresh = np.r_[True, sub[1:] != sub[:-1]]
        group = np.maximum.accumulate(np.where(fresh, slots, 0))
        rank[at] = group
        last = np.r_[fresh[1:], True]
        slots = slots[~(fresh & last)]
        span *= 2
    return order


class _Bits:
    """A bit vector with rank: 64-bit words and a running count before each."""

    def __init__(self, bits: np.ndarray) -> None:
        self.words = np.packbits(np.r_[bits, np.zeros(64 - len(bits) % 64, bool)], bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Rank of symbols in a sequence, one bit vector for each bit of the alphabet."""

    def __init__(self, sequence: np.ndarray, width: int) -> None:
        self.width, self.levels, self.zeros = width, [], []
        now = sequence
        for level in range(width - 1, -1, -1):
            bits = ((now >> level) & 1).astype(bool)
            self.levels.append(_Bits(bits))
            self.zeros.append(int(len(bits) - bits.sum()))
            now = np.concatenate([now[~bits], now[bits]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        low, high = np.zeros_like(at), at.copy()
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = ((symbol >> (self.width - 1 - k)) & 1).astype(bool)
            a, b = bits.rank(low), bits.rank(high)
            low = np.where(one, zeros + a, low - a)
            high = np.where(one, zeros + b, high - b)
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at positions."""
        now, out = at.copy(), np.zeros(len(at), np.int64)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            one = bits.get(now).astype(bool)
            ones = bits.rank(now)
            out = out * 2 + one
            now = np.where(one, zeros + ones, now - ones)
        return out


class FMIndex:
    """Counts and locates phrases in one shard of symbols."""

    def __init__(self, symbols: np.ndarray, alphabet: int, sample: int = 16) -> None:
        """``symbols``: ints in [0, alphabet), 0 a separator, the last one 0."""
        order = suffix_order(symbols)
        bwt = symbols[order - 1]
        bwt[order == 0] = 0
        self.n = len(symbols)
        self.first = np.r_[0, np.cumsum(np.bincount(symbols, minlength=alphabet))].astype(np.int64)
        self.wavelet = WaveletMatrix(bwt.astype(np.int64), max(1, int(alphabet - 1).bit_length()))
        # Known positions: every sample-th, and those after a separator, where a walk must end.
        known = (order % sample == 0) | (bwt == 0)
        self.known, self.positions = _Bits(known), order[known]

    def intervals(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all phrases at once (rows padded with 0): [low, high) in suffix order."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1]):
            live = np.flatnonzero((lengths > k) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, lengths[live] - 1 - k]
            start = self.first[symbol]
            ends = self.wavelet.rank(np.r_[symbol, symbol], np.r_[low[live], high[live]])
            low[live], high[live] = start + ends[: len(live)], start + ends[len(live) :]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix order: step back to the nearest known one."""
        at, out, steps = rows.copy(), np.full(len(rows), -1, np.int64), 0
        todo = np.arange(len(rows))
        while len(todo):
            now = at[todo]
            hit = self.known.get(now).astype(bool)
            done = todo[hit]
            out[done] = self.positions[self.known.rank(now[hit])] + steps
            todo, now = todo[~hit], now[~hit]
            symbol = self.wavelet.access(now)
            at[todo] = self.first[symbol] + self.wavelet.rank(symbol, now)
            steps += 1
        return out

    def find(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase number, text position) of every occurrence."""
        low, high = self.intervals(phrases, lengths)
        count = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(phrases)), count)
        within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        return which, self.locate(np.repeat(low, count) + within)
