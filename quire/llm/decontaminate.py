"""Benchmark decontamination with an FM-index for each training shard.

A shard is a run of documents of one task, closed at ``shard_words`` words. Its words become
symbols: words of no benchmark item can be in no phrase and turn into separators. The shard's
FM-index is searched backwards for all phrases at once, occurrences are located from sampled
suffix positions, and their spans are merged into the words hit.

The benchmark is the stated query set. It is collected only up to ``block_bytes`` of text at a
time; a larger one is read in blocks, each searched against all documents, and the spans of the
blocks are merged per row. Nothing is shuffled for a single block; with more, the rows are staged
after each, so that one block at a time is in memory.

Two operators act on the hits: ``drop_contaminated`` drops documents, ``cut_contaminated`` removes
the merged spans from their texts. A single full window is enough for either. A short item (fewer
words than a window) may be as common as one word, so documents go only for two of them.

Defined cases: null and empty texts have no words; an item without words has no phrase; items with
a null item_id are searched like any other and count as one item that has no name in the list;
repeated items and rows are judged alike; empty tables on either side give no hits; extra columns
pass through untouched under the operators that return documents and are not read otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import mapped, own_name, staged
from quire.llm.fm_index import FMIndex

#: Bytes that are not part of a word: all below 0x80 but digits and lower-case letters.
_GAPS = bytes(0x20 if b < 0x80 and not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A) else b for b in range(256))
#: A word of a text's bytes as they stand (A-Z are lower-cased before matching).
_WORD_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
WINDOW = 8


def word_list(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_GAPS).split()


def in_order(items: set[str | None]) -> list[str | None]:
    """Items by code point, the one without a name last."""
    return sorted(items, key=lambda i: (i is None, i or ""))


class Phrases:
    """The benchmark's windows as symbol rows, with the items of each."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW) -> None:
        self.symbols: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        self.items = in_order({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.items)}
        for item, text in items:
            ids = [self.symbols.setdefault(w, len(self.symbols) + 1) for w in word_list(text)]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[at : at + window]), set()).add(number[item])
        self.rows = np.zeros((len(found), window), np.int64)
        self.lengths = np.array([len(p) for p in found], np.int64)
        for k, p in enumerate(found):
            self.rows[k, : len(p)] = p
        self.of = [sorted(x) for x in found.values()]
        self.window = window
        self.alphabet = len(self.symbols) + 1


def _shard_hits(texts: list[np.ndarray], phrases: Phrases) -> tuple[list[np.ndarray], list[set[int]], np.ndarray]:
    """For each document of a shard (its words as symbols): which are hit, the item numbers, and
    whether a full window is among them."""
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.r_[0, np.cumsum(sizes)]
    total = int(first[-1])
    items: list[set[int]] = [set() for _ in texts]
    hit, full = np.zeros(total, bool), np.zeros(len(texts), bool)
    ids = np.concatenate(texts).astype(np.int64)
    at = np.flatnonzero(ids)
    if len(at):
        doc = np.repeat(np.arange(len(texts)), sizes)
        # One separator stands for a run of foreign words, and for the end of a document.
        breaks = np.r_[True, (np.diff(at) > 1) | (doc[at[1:]] != doc[at[:-1]])]
        place = np.arange(len(at)) + np.cumsum(breaks) - 1
        symbols = np.zeros(int(place[-1]) + 2, np.int64)
        symbols[place] = ids[at]
        origin = np.zeros(len(symbols), np.int64)
        origin[place] = at
        which, where = FMIndex(symbols, phrases.alphabet).find(phrases.rows, phrases.lengths)
        begin = origin[where]
        edge = np.zeros(total + 1, np.int64)
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + phrases.lengths[which], -1)
        hit = np.cumsum(edge[:-1]) > 0
        full[doc[begin[phrases.lengths[which] == phrases.window]]] = True
        for d, p in np.unique(np.stack([doc[begin], which], axis=1), axis=0).tolist():
            items[d].update(phrases.of[p])
    return np.split(hit, first[1:-1]), items, full


#: What a scan adds: words, words hit, sorted item_ids, whether a full window occurs, a bit for each word hit.
HITS = ("n_words", "n_hit", "found", "full", "hit_bits")


def _scan(documents: DataFrame, at: int, shared: Broadcast, shard_words: int, names: tuple[str, ...]) -> DataFrame:
    """All rows and columns plus ``names`` (see HITS).

    Where ``documents`` has those columns already, from the block before, the hits are merged.
    """
    own = [c for c in documents.columns if c not in names]
    add = ["0L", "0L", "cast(array() as array<string>)", "false", "cast('' as binary)"]
    schema = documents.selectExpr(*[f"`{c}`" for c in own], *[f"{x} `{n}`" for x, n in zip(add, names, strict=True)]).schema
    merge = len(own) < len(documents.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        held: list[pa.RecordBatch] = []
        texts: list[np.ndarray] = []
        size = 0
        look = p.symbols.get

        def flush() -> Iterator[pa.RecordBatch]:
            hits, items, full = _shard_hits(texts, p)
            ids = [{p.items[k] for k in x} for x in items]
            done = 0
            for b in held:
                part = slice(done, done := done + b.num_rows)
                if merge:
                    before = zip(*(b.column(b.num_columns + c).to_pylist() for c in (-3, -2, -1)), strict=True)
                    for k, (found, whole, bits) in enumerate(before, part.start):
                        ids[k] |= set(found)
                        full[k] |= whole
                        hits[k] = hits[k] | np.unpackbits(np.frombuffer(bits, np.uint8), count=len(hits[k])).astype(bool)
                new = [
                    pa.array([len(t) for t in texts[part]], pa.int64()),
                    pa.array([int(h.sum()) for h in hits[part]], pa.int64()),
                    pa.array([in_order(x) for x in ids[part]], pa.list_(pa.string())),
                    pa.array(full[part]),
                    pa.array([np.packbits(h).tobytes() for h in hits[part]], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(own)], *new], names=[*own, *names])

        for batch in batches:
            for cut in range(0, batch.num_rows, 256):
                piece = batch.slice(cut, 256)
                held.append(piece)
                for v in piece.column(at):
                    words = word_list(v.as_py())
                    texts.append(np.fromiter((look(w, 0) for w in words), np.int32, len(words)))
                    size += len(words)
                if size >= shard_words:
                    yield from flush()
                    held, texts, size = [], [], 0
        if held:
            yield from flush()

    return mapped(documents, run, schema)


def benchmark_blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> list[DataFrame]:
    """The benchmark in parts of about ``block_bytes`` of text; one part if it is no larger."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("text"))
    length = [F.coalesce(F.octet_length(c), F.lit(0)) for c in ("item_id", "text")]
    size = items.agg(F.sum(length[0] + length[1])).first()[0] or 0
    n = max(1, -(-int(size) // block_bytes))
    return [items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) for k in range(n)] if n > 1 else [items]


def with_hits(
    documents: DataFrame,
    benchmark: DataFrame,
    names: tuple[str, ...] = HITS,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shard_words: int = 400_000,
    block_bytes: int = 16 << 20,
) -> DataFrame:
    """``documents`` with what HITS lists, under ``names``."""
    at, out = documents.columns.index(text), documents
    blocks = benchmark_blocks(benchmark, item_id, item_text, block_bytes)
    for k, block in enumerate(blocks):
        phrases = Phrases([(r[0], r[1]) for r in block.collect()], window)
        shared = documents.sparkSession.sparkContext.broadcast(phrases)
        found = _scan(out, at, shared, shard_words, names)
        if k < len(blocks) - 1:
            found = staged(found, "hits")
            shared.destroy()
        out = found
    return out


def contamination(documents: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_items: int = 2, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    slim = documents.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"`{text}` text")
    out = with_hits(slim, benchmark, **options)
    return out.select(
        "doc_id", "n_words", "n_hit",
        F.size("found").cast("long").alias("n_items"),
        F.sha2(F.array_join("found", ","), 256).alias("items_sha256"),
        (F.size("found") >= min_items).alias("contaminated"),
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", min_items: int = 2, **options) -> DataFrame:
    """Documents without a full window and with phrases of fewer than ``min_items`` items."""
    names = tuple(own_name(documents, *HITS))
    out = with_hits(documents, benchmark, names, text=text, **options)
    return out.where(~F.col(names[3]) & (F.size(names[2]) < min_items)).select(*documents.columns)


def removal_spans(raw: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """(first byte, end) of each run of words hit, what stands between them included."""
    words = [m.span() for m in _WORD_BYTES.finditer(raw)]
    edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    return [(words[a][0], words[b - 1][1]) for a, b in edge.reshape(-1, 2).tolist()]


def cut_contaminated(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", min_items: int = 2, **options) -> DataFrame:
    """All documents; those that ``drop_contaminated`` drops without the text of their spans."""
    names = tuple(own_name(documents, *HITS))
    at = documents.columns.index(text)
    own = documents.columns
    hits = with_hits(documents, benchmark, names, text=text, **options)
    (cut,) = own_name(hits, "cut")
    marked = hits.select(*own, names[4], (F.col(names[3]) | (F.size(names[2]) >= min_items)).alias(cut))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, bits, bad in zip(batch.column(at), *batch.columns[-2:], strict=True):
                t = value.as_py()
                if bad.as_py():
                    raw = t.encode("utf-8", "surrogatepass")
                    flags = np.unpackbits(np.frombuffer(bits.as_py(), np.uint8)).astype(bool)
                    kept, done = [], 0
                    for a, b in removal_spans(raw, flags):
                        kept.append(raw[done:a])
                        done = b
                    t = b"".join([*kept, raw[done:]]).decode("utf-8", "surrogatepass")
                out.append(t)
            columns = [*batch.columns[:at], pa.array(out, pa.string()), *batch.columns[at + 1 : len(own)]]
            yield pa.RecordBatch.from_arrays(columns, names=own)

    return mapped(marked, run, documents.schema)
