"""Static range asymmetric numeral system over numpy lanes.

A block of symbols is coded by ``lanes`` interleaved 64-bit states that share one frequency table:
symbol i belongs to lane i mod lanes. States stay in [2**31, 2**63) and give off 32-bit words.
Each block carries its own final states, so blocks decode alone.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LOW = 1 << 31
LANES = 4096
HEAD = struct.Struct("<IIII")  # symbols, lanes, words, checksum of the rest


class Model:
    """Frequencies scaled to 2**bits, every counted symbol at least 1."""

    def __init__(self, freq: np.ndarray, bits: int) -> None:
        self.bits, self.freq = bits, freq.astype(np.uint64)
        self.start = np.r_[0, np.cumsum(freq)[:-1]].astype(np.uint64)
        self.both = self.freq | self.start << np.uint64(32)  # one lookup for the two
        self._slots: np.ndarray | None = None

    @classmethod
    def from_counts(cls, counts: np.ndarray, bits: int = 18) -> Model:
        total, size = int(counts.sum()), 1 << bits
        seen = counts > 0
        if int(seen.sum()) > size:
            raise ValueError("more symbols than 2**bits slots")
        freq = np.zeros(len(counts), np.int64)
        if total:
            # 1 for each symbol that occurs, the other slots in proportion.
            spare = size - int(seen.sum())
            freq[seen] = 1 + (counts[seen].astype(np.float64) * (spare / total)).astype(np.int64)
            freq[int(np.argmax(counts))] += size - int(freq.sum())
        return cls(freq, bits)

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            kind = np.uint16 if len(self.freq) <= 1 << 16 else np.int32
            self._slots = np.repeat(np.arange(len(self.freq), dtype=kind), self.freq.astype(np.int64))
        return self._slots

    def to_bytes(self) -> bytes:
        body = zlib.compress(self.freq.astype("<u4").tobytes())
        return struct.pack("<4sIII", b"QFRQ", self.bits, len(self.freq), zlib.crc32(body)) + body

    @classmethod
    def from_bytes(cls, raw: bytes) -> Model:
        magic, bits, n, crc = struct.unpack_from("<4sIII", raw)
        if magic != b"QFRQ" or zlib.crc32(raw[16:]) != crc:
            raise ValueError("not a frequency table, or a damaged one")
        return cls(np.frombuffer(zlib.decompress(raw[16:]), "<u4", n), bits)


def encode_block(symbols: np.ndarray, model: Model, lanes: int = LANES) -> bytes:
    n = len(symbols)
    lanes = min(lanes, max(16, n // 64))  # states of few symbols must not outweigh them
    bits = np.uint64(model.bits)
    freq, start = model.freq[symbols], model.start[symbols]
    top = freq << np.uint64(63 - model.bits)  # a state at or above it gives off a word first
    state = np.full(lanes, LOW, np.uint64)
    words = []
    for at in range((n - 1) // lanes * lanes, -1, -lanes) if n else ():
        end = min(n, at + lanes)
        x, f = state[: end - at], freq[at:end]
        full = x >= top[at:end]
        if full.any():
            words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            x = np.where(full, x >> np.uint64(32), x)
        q, r = np.divmod(x, f)
        state[: end - at] = (q << bits) + r + start[at:end]
    out = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    body = state.astype("<u8").tobytes() + out.tobytes()
    return HEAD.pack(n, lanes, len(out), zlib.crc32(body)) + body


def block_size(raw: bytes, at: int) -> int:
    _, lanes, words, _ = HEAD.unpack_from(raw, at)
    return HEAD.size + 8 * lanes + 4 * words


def decode_block(raw: bytes, model: Model, at: int = 0) -> np.ndarray:
    n, lanes, count, crc = HEAD.unpack_from(raw, at)
    body = memoryview(raw)[at + HEAD.size : at + block_size(raw, at)]
    if zlib.crc32(body) != crc:
        raise ValueError("a block's checksum is wrong")
    state = np.frombuffer(body, "<u8", lanes).astype(np.uint64)
    words = np.frombuffer(body, "<u4", count, 8 * lanes).astype(np.uint64)
    bits, mask, slots = np.uint64(model.bits), np.uint64((1 << model.bits) - 1), model.slots
    both, low32 = model.both, np.uint64(0xFFFFFFFF)
    out, used = np.empty(n, np.int32), 0
    for first in range(0, n, lanes):
        end = min(n, first + lanes)
        x = state[: end - first]
        low = x & mask
        s = slots[low]
        out[first:end] = s
        found = both[s]
        x = (found & low32) * (x >> bits) + low - (found >> np.uint64(32))
        short = x < LOW
        k = int(np.count_nonzero(short))
        if k:
            x[short] = (x[short] << np.uint64(32)) | words[used : used + k]
            used += k
        state[: end - first] = x
    if used != count or not (state == LOW).all():
        raise ValueError("a block does not end where it should")
    return out
