"""Recompression of word sequences: equal stretches get equal interior symbols. Plain numpy.

A round names either runs of one symbol or pairs. For pairs, a bit of each symbol's name puts it
left or right, and every left symbol followed by a right one is merged into a new symbol. A name is
a hash of what it stands for, so the same content has the same name in every task. Different
content may share a name; whoever finds equal names compares what they stand for.

Whether two neighbours merge depends on these two alone. So inside a stretch of words all symbols
are settled by the stretch itself, but for a few at its ends: a right symbol at its start may merge
with what is before, a left symbol at its end with what is behind, and a run there may go on. A
window's anchor is the least name among its settled symbols in the last round that leaves any; it
is a function of the window's words, wherever the window stands. The half of the window before or
behind the anchor's start, whichever it holds in full, is mixed into the anchor's name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

U = np.uint64
ROUNDS = 24


def mix(x: np.ndarray) -> np.ndarray:
    """A public 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: ASCII white space.
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
PART = 1 << 19
#: Low bytes of a 64-bit load to keep, by their number.
KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def word_names(raw: bytes, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(name, first byte) of each word of UTF-8 text, in parts that end between words.

    Words of up to 16 bytes are mixed from two loads, longer ones are hashed with XXH3. Names are
    cut to ``bits``.
    """
    found, places, at = [np.zeros(0, U)], [np.zeros(0, np.int64)], 0
    data = np.frombuffer(raw + bytes(16), np.uint8)
    size = len(raw)
    loads = np.ndarray((size + 9,), "<u8", data.data, strides=(1,))
    while at < size:
        end = at + PART
        while end < size and not (cut := np.flatnonzero(SPACE[data[at : min(end, size)]])).size:
            end += PART
        end = size if end >= size else at + int(cut[-1]) + 1
        inside = np.zeros(end - at + 2, np.int8)
        inside[1:-1] = ~SPACE[data[at:end]]
        edge = np.flatnonzero(np.diff(inside)) + at
        first, last = edge[::2], edge[1::2]
        length = last - first
        low = loads[first] & KEEP[np.minimum(length, 8)]
        high = loads[first + 8] & KEEP[np.clip(length - 8, 0, 8)]
        name = mix(mix(low ^ (length.astype(U) << U(56))) + high * U(0x9E3779B97F4A7C15))
        for k in np.flatnonzero(length > 16).tolist():
            name[k] = xxhash.xxh3_64_intdigest(raw[first[k] : last[k]])
        found.append(name & U((1 << bits) - 1))
        places.append(first)
        at = end
    return np.concatenate(found), np.concatenate(places)


def batch_names(texts: list[bytes], bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(word names of all texts, ends of the texts among them)."""
    names, places = word_names(b" ".join(texts), bits)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return names, np.searchsorted(places, ends)


@dataclass
class Records:
    """Runs of consecutive windows with one anchor. Positions count from the start of the batch."""

    name: np.ndarray  # of the anchor and the half beside it
    first: np.ndarray  # first window
    count: np.ndarray  # number of windows, at most the window's length


def window_starts(ends: np.ndarray, window: int) -> np.ndarray:
    """Starts of all windows inside documents that end at ``ends``."""
    begins = np.r_[0, ends[:-1]]
    count = np.maximum(ends - begins - window + 1, 0)
    shift = np.repeat(begins - np.r_[0, np.cumsum(count)[:-1]], count)
    return shift + np.arange(int(count.sum()))


def anchors(words: np.ndarray, ends: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(name, position of its first word) of each window's anchor."""
    name, place = np.empty(len(starts), U), np.empty(len(starts), np.int64)
    symbol, at = words, np.arange(len(words))
    doc = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
    live, low, high = np.arange(len(starts)), starts.copy(), starts + window  # settled: [low, high)

    def settle(which: np.ndarray) -> None:
        """Take the least name of what is settled now as the anchor."""
        lo, hi, to = low[which], high[which], live[which]
        best, spot = symbol[lo], lo.copy()
        for k in range(1, int((hi - lo).max(initial=0))):
            more = np.flatnonzero(lo + k < hi)
            other = symbol[lo[more] + k]
            less = other < best[more]
            best[more[less]], spot[more[less]] = other[less], lo[more[less]] + k
        name[to], place[to] = best, at[spot]

    for level in range(ROUNDS):
        if not len(live):
            break
        n = len(symbol)
        if level == 0:  # runs
            head = np.r_[True, (symbol[1:] != symbol[:-1]) | (doc[1:] != doc[:-1])]
            number = np.cumsum(head) - 1
            firsts = np.flatnonzero(head)
            length = np.diff(np.r_[firsts, n])
            # The first and the last run may go on outside.
            lo, hi = number[low] + 1, number[high - 1]
            symbol_next = np.where(length > 1, mix(symbol[firsts] + mix(length.astype(U) + U(77))), symbol[firsts])
        else:  # pairs
            left = (mix(symbol + U(level * 0x51ED27)) & U(1)).astype(bool)
            merged = np.r_[left[:-1] & ~left[1:] & (doc[:-1] == doc[1:]), False]
            head = np.r_[True, ~merged[:-1]]
            number = np.cumsum(head) - 1
            firsts = np.flatnonzero(head)
            lo = low + ~left[low]
            hi = high - left[high - 1]
            inside = lo < hi
            lo = np.where(inside, number[np.minimum(lo, n - 1)], 1)
            hi = np.where(inside, number[hi - 1] + 1, 0)
            second = np.r_[symbol[1:], U(0)][firsts]
            symbol_next = np.where(merged[firsts], mix(symbol[firsts] * U(0xD6E8FEB86659FD93) + mix(second + U(1))), symbol[firsts])
        gone = lo >= hi
        if gone.any():
            settle(np.flatnonzero(gone))
        stay = ~gone
        live, low, high = live[stay], lo[stay], hi[stay]
        symbol, at, doc = symbol_next, at[firsts], doc[firsts]
    if len(live):
        settle(np.arange(len(live)))
    return name, place


def stretch_names(words: np.ndarray, length: int) -> np.ndarray:
    """A name for each stretch of ``length`` words, from names of stretches of 1, 2, 4, ... words."""
    power, done, out = words, 0, None
    size = 1
    while True:
        if length & size:
            n = len(words) - done - size + 1
            tail = power[done : done + max(n, 0)]
            out = tail if out is None else mix(out[: len(tail)] * U(0xD6E8FEB86659FD93) + mix(tail + U(size)))
            done += size
        if 2 * size > length:
            return out
        power = mix(power[:-size] * U(0x9E3779B97F4A7C15) + mix(power[size:] + U(1))) if len(power) > size else power[:0]
        size *= 2


def records(words: np.ndarray, ends: np.ndarray, window: int) -> Records:
    """All windows of a batch of documents (word names, ends of documents) by anchor."""
    starts = window_starts(ends, window)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Records(none.astype(U), none, none)
    name, place = anchors(words, ends, starts, window)
    half = max(1, window // 2)
    behind = place - starts < half  # else the window holds the half before the anchor
    name = mix(name + mix(stretch_names(words, half)[np.where(behind, place, place - half)] + behind.astype(U)))
    fresh = np.r_[True, (name[1:] != name[:-1]) | (place[1:] != place[:-1]) | (np.diff(starts) != 1)]
    at = np.flatnonzero(fresh)
    count = np.diff(np.r_[at, len(starts)])
    return Records(name[at], starts[at], count)
