"""Files in the shared folder, written and range-read from executors.

Paths are URIs of any file system that Arrow opens (file, hdfs, s3, ...). A task writes under a
name of its own and reports it, so a repeated or speculative task never disturbs another's file:
only the names that successful tasks report are read.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri.replace("file:", "file://", 1))


class Writer:
    """A new file ``folder/stem-<unique>.<end>`` with its length so far."""

    def __init__(self, folder: str, stem: str, end: str) -> None:
        system, at = opened(folder)
        system.create_dir(at, recursive=True)
        self.uri = f"{folder}/{stem}-{uuid.uuid4().hex}.{end}"
        self._out = system.open_output_stream(f"{at}/{self.uri.rpartition('/')[2]}")
        self.size = 0

    def write(self, raw: bytes) -> int:
        """Returns where ``raw`` starts."""
        at = self.size
        self._out.write(raw)
        self.size += len(raw)
        return at

    def close(self) -> None:
        self._out.close()


class Reader:
    """Range reads of one file."""

    def __init__(self, uri: str) -> None:
        system, at = opened(uri)
        self._in = system.open_input_file(at)
        self.size = self._in.size()

    def read(self, at: int, n: int) -> bytes:
        self._in.seek(at)
        raw = self._in.read(n)
        if len(raw) != n:
            raise ValueError(f"{n} bytes at {at} asked for, {len(raw)} there")
        return raw

    def close(self) -> None:
        self._in.close()


def put(folder: str, stem: str, end: str, raw: bytes) -> str:
    out = Writer(folder, stem, end)
    out.write(raw)
    out.close()
    return out.uri


def get(uri: str) -> bytes:
    file = Reader(uri)
    try:
        return file.read(0, file.size)
    finally:
        file.close()
