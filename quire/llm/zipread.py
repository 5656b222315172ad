"""ZIP archives of stored members: central and ZIP64 directories by range reads, and a writer.

Only the directory and the wanted ranges are read; nothing is extracted. Plain Python, no Spark.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

LOCAL = struct.Struct("<4sHHHHHIIIHH")
CENTRAL = struct.Struct("<4sHHHHHHIIIHHHHHII")
END = struct.Struct("<4sHHHHIIH")
END64 = struct.Struct("<4sQHHIIQQQQ")
LOCATOR = struct.Struct("<4sIQI")
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
DATE = 0x21  # 1 January 1980


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    crc: int
    packed: int
    size: int
    header: int  # where its local header starts


def _extra64(extra: bytes) -> bytes:
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            return extra[at + 4 : at + 4 + n]
        at += 4 + n
    return b""


def directory(read: Callable[[int, int], bytes], length: int) -> list[Member]:
    """Members by the archive's central directory; ``read(at, n)`` reads a range of it."""
    if length < END.size:
        raise ValueError("too short for a ZIP archive")
    tail_at = max(0, length - END.size - FULL16)
    tail = read(tail_at, length - tail_at)
    at = tail.rfind(b"PK\5\6")
    while at >= 0 and (at + END.size > len(tail) or at + END.size + END.unpack_from(tail, at)[-1] > len(tail)):
        at = tail.rfind(b"PK\5\6", 0, at)
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP archive")
    _, _, _, _, count, size, start, _ = END.unpack_from(tail, at)
    locator_at = tail_at + at - LOCATOR.size
    if locator_at >= 0 and (raw := read(locator_at, LOCATOR.size))[:4] == b"PK\6\7":
        end64 = END64.unpack(read(LOCATOR.unpack(raw)[2], END64.size))
        if end64[0] != b"PK\6\6":
            raise ValueError("the ZIP64 locator points elsewhere")
        count, size, start = end64[7], end64[8], end64[9]
    body, pos, out = read(start, size), 0, []
    for _ in range(count):
        f = CENTRAL.unpack_from(body, pos)
        if f[0] != b"PK\1\2":
            raise ValueError("a damaged central directory")
        n, m, k = f[10], f[11], f[12]
        name = body[pos + CENTRAL.size : pos + CENTRAL.size + n]
        extra = body[pos + CENTRAL.size + n : pos + CENTRAL.size + n + m]
        packed, full, header = f[8], f[9], f[16]
        wide, used = _extra64(extra), 0
        # The ZIP64 field holds only the values that are full in the plain ones, in this order.
        values = []
        for v in (full, packed, header):
            if v == FULL32:
                v = struct.unpack_from("<Q", wide, used)[0]
                used += 8
            values.append(v)
        full, packed, header = values
        out.append(Member(name.decode("utf-8" if f[3] & 0x800 else "cp437"), f[4], f[7], packed, full, header))
        pos += CENTRAL.size + n + m + k
    return out


def data_start(read: Callable[[int, int], bytes], member: Member) -> int:
    """Where a stored member's bytes start."""
    if member.method != 0:
        raise ValueError(f"{member.name} is not stored but compressed")
    f = LOCAL.unpack(read(member.header, LOCAL.size))
    if f[0] != b"PK\3\4":
        raise ValueError(f"{member.name} has no local header")
    return member.header + LOCAL.size + f[9] + f[10]


class ZipWriter:
    """Writes stored members one after the other; ZIP64 where sizes ask for it, or always."""

    def __init__(self, write: Callable[[bytes], object], always64: bool = False) -> None:
        self._write, self._at, self._done, self._always = write, 0, [], always64

    def _put(self, raw: bytes) -> None:
        self._write(raw)
        self._at += len(raw)

    def add(self, name: str, data: bytes) -> None:
        raw, n, header = name.encode(), len(data), self._at
        wide = self._always or n >= FULL32
        extra = struct.pack("<HHQQ", 1, 16, n, n) if wide else b""
        short = FULL32 if wide else n
        crc = zlib.crc32(data)
        self._put(LOCAL.pack(b"PK\3\4", 45 if wide else 20, 0x800, 0, 0, DATE, crc, short, short, len(raw), len(extra)) + raw + extra)
        self._put(data)
        self._done.append((raw, crc, n, header))

    def close(self) -> None:
        start = self._at
        for raw, crc, n, header in self._done:
            big = [v for v in (n, n, header) if self._always or v >= FULL32]
            extra = struct.pack(f"<HH{len(big)}Q", 1, 8 * len(big), *big) if big else b""
            short = [FULL32 if self._always or v >= FULL32 else v for v in (n, n, header)]
            self._put(CENTRAL.pack(b"PK\1\2", 45, 45 if big else 20, 0x800, 0, 0, DATE, crc, short[0], short[1], len(raw), len(extra), 0, 0, 0, 0, short[2]) + raw + extra)
        size, count, end = self._at - start, len(self._done), self._at
        wide = self._always or count >= FULL16 or max(size, start) >= FULL32
        if wide:
            self._put(END64.pack(b"PK\6\6", END64.size - 12, 45, 45, 0, 0, count, count, size, start))
            self._put(LOCATOR.pack(b"PK\6\7", 0, end, 1))
        few = FULL16 if wide else count
        self._put(END.pack(b"PK\5\6", 0, 0, few, few, FULL32 if wide else size, FULL32 if wide else start, 0))
