"""Compression bands: Zstandard ratios of whole texts and fixed chunks, with limits by length.

Repetitive text compresses to a small share of its bytes, random or encoded text hardly at all.
Short texts compress worse than long ones, so every length band has its own limits. The word-level
base counts (which catch short documents and repeated windows) are taken in the same pass.

Everything is decided per row in one map over Arrow batches: no shuffle, memory of one text.
Defined cases: null and empty texts have no words (base_failed, not kept) and ratio null; texts of
any length are read whole; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from quire.llm.common import mapped

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """``limits``: (bytes up to, least ratio, greatest ratio) of whole texts, by rising length.

    The greatest ratios lie between clean prose and encoded noise (base64, base85, random printable
    characters) of each length. Such noise is ASCII, and scripts of two or three bytes a character
    compress worse while short, so a whole text's greatest ratio rises by ``script_room`` times
    the share of its bytes that are not ASCII.

    A text longer than one chunk is also cut into chunks of ``chunk_bytes``; it is rejected if
    more than ``max_bad_share`` or more than ``max_bad_chunks`` of them lie outside
    ``chunk_limits``, or two in a row. A last part shorter than half a chunk is no chunk; with
    the bytes before it to ``min_tail`` at least, it is judged by the limits of its own length,
    and the text is rejected if it lies outside.
    """

    level: int = 3
    limits: tuple[tuple[float, float, float], ...] = (
        (256, 0.15, 0.87),
        (384, 0.15, 0.82),
        (512, 0.15, 0.79),
        (768, 0.15, 0.75),
        (1024, 0.15, 0.735),
        (1536, 0.12, 0.71),
        (2048, 0.12, 0.69),
        (4096, 0.12, 0.68),
        (8192, 0.12, 0.64),
        (65536, 0.10, 0.60),
        (float("inf"), 0.07, 0.60),
    )
    script_room: float = 0.15
    chunk_bytes: int = 8192
    chunk_limits: tuple[float, float] = (0.10, 0.62)
    max_bad_share: float = 0.2
    max_bad_chunks: int = 2
    min_tail: int = 1024
    min_words: int = 50
    max_repeat_percent: int = 50
    symbols: str = field(default=SYMBOLS)


def base_counts(text: str | None, symbols: str = SYMBOLS) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() cuts at exactly the six ASCII white-space characters
    chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    n_symbols = sum(text.count(c) for c in symbols)
    lines = [x for x in raw.split(b"\n") if x.strip()]  # bytes.strip() drops the same six
    return len(words), chars, n_symbols, len(lines) - len(set(lines)), _repeat_words(words)


def _repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, n)
    v = len(names)
    pairs = ids[:-1] * v + ids[1:]
    if v < 2_000_000:
        keys = pairs[:-1] * v + ids[2:]
    else:
        keys = np.unique(pairs, return_inverse=True)[1][:-1] * v + ids[2:]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    again = np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : k + len(keys)] |= again
    return int(hit.sum())


def _within(raw: bytes | memoryview, ratio: float, bands: Bands) -> bool:
    """Whether the ratio lies in the limits of the text's length."""
    low, high = next((lo, hi) for most, lo, hi in bands.limits if len(raw) <= most)
    if ratio > high:
        high += bands.script_room * np.count_nonzero(np.frombuffer(raw, np.uint8) > 127) / len(raw)
    return low <= ratio <= high


def ratio_verdict(raw: bytes, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple[float | None, int, int, bool]:
    """(whole ratio, chunks judged, chunks outside, passes)."""
    if not raw:
        return None, 0, 0, False
    ratio = len(packer.compress(raw)) / len(raw)
    good = _within(raw, ratio, bands)
    judged = outside = 0
    if len(raw) > bands.chunk_bytes:
        view = memoryview(raw)
        before = False
        for at in range(0, len(raw), bands.chunk_bytes):
            part = view[at : at + bands.chunk_bytes]
            if 2 * len(part) < bands.chunk_bytes:
                part = view[min(at, len(raw) - bands.min_tail) :]
                good = good and _within(part, len(packer.compress(part)) / len(part), bands)
                break
            r = len(packer.compress(part)) / len(part)
            bad = not bands.chunk_limits[0] <= r <= bands.chunk_limits[1]
            judged += 1
            outside += bad
            good = good and not (bad and before)
            before = bad
        good = good and outside <= min(bands.max_bad_share * judged, bands.max_bad_chunks)
    return ratio, judged, outside, good


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"
)


def compression_bands(documents: DataFrame, bands: Bands | None = None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Base counts, ratios and the verdict ``kept`` per document."""
    rule = bands or Bands()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=rule.level, write_checksum=False)
        for batch in batches:
            rows = []
            for value in batch.column(1):
                t = value.as_py()
                n, chars, symbols, dup, again = base_counts(t, rule.symbols)
                failed = n < rule.min_words or 100 * again > rule.max_repeat_percent * n
                ratio, judged, outside, good = ratio_verdict((t or "").encode("utf-8", "surrogatepass"), rule, packer)
                rows.append((n, chars, symbols, dup, again, failed, not failed and good, ratio, judged, outside))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 10
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                names=[x.split()[0] for x in SCHEMA.split(", ")],
            )

    return mapped(documents.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"`{text}` text"), judge, SCHEMA)
