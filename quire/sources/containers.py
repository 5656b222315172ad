"""Containers: ZIP packages, compound files, BIFF record streams. Plain Python over bytes."""

from __future__ import annotations

import io
import posixpath
import struct
import zipfile
from collections.abc import Iterator

CFB_MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
FREE = 0xFFFFFFFA  # sector numbers from here on are marks


class Package:
    """Parts of a ZIP package by name; a missing part is None, anything else wrong is an error."""

    def __init__(self, content: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())

    def part(self, name: str) -> bytes | None:
        return self.zip.read(name) if name in self.names else None

    def relationships(self, part: str) -> dict[str, tuple[str, str]]:
        """id -> (type's last word, target part) of a part; external ones are left out."""
        from quire.sources.xmltree import parse

        folder, _, name = part.rpartition("/")
        raw = self.part(f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels")
        out = {}
        for rel in parse(raw).children("Relationship") if raw else ():
            if rel.get("TargetMode") != "External":
                target = rel.get("Target", "")
                path = target[1:] if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
                out[rel.get("Id", "")] = (rel.get("Type", "").rpartition("/")[2], path)
        return out

    def related(self, part: str, kind: str) -> list[str]:
        """Targets of one type, by relationship id."""
        return [path for _, (k, path) in sorted(self.relationships(part).items()) if k == kind]


class Compound:
    """Streams of a compound file by name."""

    def __init__(self, content: bytes) -> None:
        if content[:8] != CFB_MAGIC:
            raise ValueError("not a compound file")
        self.raw = content
        shift, small = struct.unpack_from("<HH", content, 30)
        if shift not in (9, 12) or small > 12:
            raise ValueError("a compound file with odd sectors")
        self.size, self.small_size = 1 << shift, 1 << small
        _, first_dir, _, self.cutoff, first_small, _, first_far, n_far = struct.unpack_from("<IIIIIIII", content, 44)
        table = list(struct.unpack_from("<109I", content, 76))
        seen = 0
        while first_far < FREE and seen < n_far:
            block = struct.unpack(f"<{self.size // 4}I", self._sector(first_far))
            table += block[:-1]
            first_far, seen = block[-1], seen + 1
        self.fat: list[int] = []
        for s in table:
            if s < FREE:
                self.fat += struct.unpack(f"<{self.size // 4}I", self._sector(s))
        self.entries: dict[str, tuple[int, int, int]] = {}
        directory = self._chain(first_dir)
        root = (0, 0)
        for at in range(0, len(directory) - 127, 128):
            n, kind = struct.unpack_from("<HB", directory, at + 64)
            start, = struct.unpack_from("<I", directory, at + 116)
            size, = struct.unpack_from("<Q", directory, at + 120)
            if self.size == 512:
                size &= 0xFFFFFFFF
            name = directory[at : at + max(0, n - 2)].decode("utf-16-le", "replace")
            if kind == 5:
                root = (start, size)
            elif kind == 2:
                self.entries.setdefault(name, (kind, start, size))
        self.mini = self._chain(root[0])[: root[1]] if root[1] else b""
        chain = self._chain(first_small) if first_small < FREE else b""
        self.mini_fat = struct.unpack(f"<{len(chain) // 4}I", chain)

    def _sector(self, n: int) -> bytes:
        at = (n + 1) * self.size
        return self.raw[at : at + self.size].ljust(self.size, b"\0")

    def _chain(self, n: int) -> bytes:
        out, left = [], len(self.fat) + 1
        while n < FREE:
            if n >= len(self.fat) or not left:
                raise ValueError("a damaged sector chain")
            out.append(self._sector(n))
            n, left = self.fat[n], left - 1
        return b"".join(out)

    def stream(self, name: str) -> bytes | None:
        if name not in self.entries:
            return None
        _, n, size = self.entries[name]
        if size >= self.cutoff:
            return self._chain(n)[:size]
        out, left = [], len(self.mini_fat) + 1
        while n < FREE:
            if n >= len(self.mini_fat) or not left:
                raise ValueError("a damaged short chain")
            out.append(self.mini[n * self.small_size : (n + 1) * self.small_size])
            n, left = self.mini_fat[n], left - 1
        return b"".join(out)[:size]


CONTINUE = 0x3C


def biff_records(stream: bytes) -> Iterator[tuple[int, int, list[bytes]]]:
    """(kind, offset, parts): a record with the CONTINUE records behind it."""
    at, held = 0, None
    while at + 4 <= len(stream):
        kind, n = struct.unpack_from("<HH", stream, at)
        body = stream[at + 4 : at + 4 + n]
        if kind == CONTINUE and held:
            held[2].append(body)
        else:
            if held:
                yield held
            held = (kind, at, [body])
        at += 4 + n
    if held:
        yield held
