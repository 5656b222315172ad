"""Removal of repeated word sequences by recompression.

A word goes if a window of ``window`` consecutive words that covers it also starts in a document
with a smaller doc_id. Windows are judged on the input.

1. Tasks name runs and pairs of their documents' words in rounds (see ``recompress``), from low to
   high symbols. Equal windows have the same anchor symbol at the same place, and neighbouring
   windows share one, so a record stands for a run of windows. A Spark round groups the anchors'
   names over all documents and stages the table of those that two or more documents share.
2. Under shared names the words themselves are compared: each record's extent, all words of its
   windows, gets a 128-bit BLAKE2b digest of these words, and a second Spark round stages the first
   document of each extent. Records whose extent also stands in a smaller document are repeats.
3. Only where extents under one name differ, the first document of each extent has its windows
   digested one by one, and a third Spark round finds the smallest document of each window.

Names only say where to look: two contents that share a name are told apart by the digests of
their words, so ``name_bits`` may be small (tests use it) and costs time, never a result.

No pairs are listed and no group is collected; groups are minima, combined map side, so a name that
a third of all documents have is one row a task. The joins are plain equi-joins on staged tables,
which AQE splits at hot keys. Per document only its own ranges are gathered. Rows are numbered once,
in a staged table, so rows that repeat a doc_id are never taken for each other. Texts are dealt once
with their candidates; a second time only those that have some.

Defined cases: null and empty texts have no words; texts of fewer words than a window keep all; a
row with a null doc_id neither loses words nor makes others lose any; rows that repeat a doc_id are
not smaller than each other and are each judged by their own text; very long texts are read whole;
an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import mapped, release, staged
from quire.llm.recompress import batch_names, records

WINDOW = 50
#: A place is the first window << 8 | number of windows.
COUNT = 255
BATCH_BYTES = 3 << 19
PLACES = "array<struct<name: bigint, first_doc: bigint, place: bigint>>"


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _pieces(batch: pa.RecordBatch, text: int) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as bytes) of stretches of a batch of about BATCH_BYTES."""
    first, held, size = 0, [], 0
    for k, v in enumerate(batch.column(text)):
        held.append((v.as_py() or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= BATCH_BYTES:
            yield first, held
            first, held, size = k + 1, [], 0
    if held:
        yield first, held


def window_records(numbered: DataFrame, window: int, name_bits: int = 64) -> DataFrame:
    """row, doc_id, text -> name, row, doc_id, place: the anchors of all windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for row, texts in _pieces(batch, 2):
                names, ends = batch_names(texts, name_bits)
                got = records(names, ends, window)
                which = np.searchsorted(ends, got.first, side="right")
                place = (got.first - np.r_[0, ends][which]) << 8 | got.count
                name = got.name & np.uint64((1 << name_bits) - 1)
                columns = [name.view(np.int64), rows[row + which], ids[row + which], place]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["name", "row", "doc_id", "place"])

    rows = numbered.where("doc_id is not null and text is not null").select("row", "doc_id", "text")
    return mapped(rows, run, "name long, row long, doc_id long, place long")


def _cover(n: int, places: list[int], window: int) -> np.ndarray:
    """Words covered by the windows of places."""
    edge = np.zeros(n + 1, np.int64)
    for p in places:
        first, count = p >> 8, p & COUNT
        edge[first] += 1
        edge[min(n, first + count - 1 + window)] -= 1
    return np.cumsum(edge[:-1]) > 0


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _sorted_out(rows: DataFrame) -> DataFrame:
    """row, doc_id, text, look -> with n_words, and kept_sha256 of rows without candidates, whose
    text is not carried on."""
    names = ["row", "doc_id", "n_words", "kept_sha256", "text", "look"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            look = batch.column(3)
            done = look.is_null().to_pylist()
            words = [_words(t.as_py()) for t in batch.column(2)]
            counts = pa.array([len(w) for w in words], pa.int64())
            kept = pa.array([_digest(w) if d else None for w, d in zip(words, done, strict=True)], pa.string())
            text = pa.array([None if d else t.as_py() for t, d in zip(batch.column(2), done, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts, kept, text, look], names=names)

    rows = rows.select("row", "doc_id", "text", "look")
    return mapped(rows, run, rows.selectExpr("row", "doc_id", "0L n_words", "cast(null as string) kept_sha256", "text", "look").schema)


def _cut(rows: DataFrame, window: int) -> DataFrame:
    """doc_id, text, found (places of repeats) -> doc_id, n_words, n_removed, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                words = _words(text.as_py())
                gone = _cover(len(words), found.as_py() or [], window)
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out.append((len(words), len(words) - len(kept), _digest(kept)))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, zip(*out, strict=True))], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return mapped(rows.select("doc_id", "text", "found"), run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _digests(rows: DataFrame, window: int) -> DataFrame:
    """row, doc_id, text, look -> name, first_doc, row, doc_id, place and a digest of the words of the
    place's whole extent (x, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            keys = [np.repeat(batch.column(k).to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)) for k in (0, 1)]
            names, firsts, places = (lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in ("name", "first_doc", "place"))
            found, at = [], 0
            for text, listed in zip(batch.column(2), lists, strict=True):
                here = places[at : at + len(listed)]
                found += _digest_spans(text.as_py(), here >> 8, (here & COUNT) - 1 + window)
                at += len(listed)
            halves = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            columns = [names, firsts, *keys, places, halves[:, 0].copy(), halves[:, 1].copy()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["name", "first_doc", "row", "doc_id", "place", "x", "y"])

    schema = "name long, first_doc long, row long, doc_id long, place long, x long, y long"
    return mapped(rows.select("row", "doc_id", "text", "look"), run, schema)


def _window_digests(rows: DataFrame, window: int) -> DataFrame:
    """row, doc_id, text, open (places) -> row, doc_id, place and digest of each single window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, text, listed in zip(*batch.columns, strict=True):
                places = np.array(listed.as_py(), np.int64)
                count = places & COUNT
                within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                first = np.repeat(places >> 8, count) + within
                halves = np.frombuffer(b"".join(_digest_spans(text.as_py(), first, window)), np.int64).reshape(-1, 2)
                columns = [np.full(len(first), row.as_py()), np.full(len(first), doc.as_py()), first << 8 | 1, halves[:, 0].copy(), halves[:, 1].copy()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["row", "doc_id", "place", "x", "y"])

    return mapped(rows.select("row", "doc_id", "text", "open"), run, "row long, doc_id long, place long, x long, y long")


def _digest_spans(text: str | None, first: np.ndarray, size: np.ndarray | int) -> list[bytes]:
    """128-bit digests of the words [first, first + size) of a text."""
    words = _words(text)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.r_[0, ends[:-1] + 1]
    digest = hashlib.blake2b
    return [digest(joined[a:b], digest_size=16).digest() for a, b in zip(begins[first].tolist(), ends[first + size - 1].tolist(), strict=True)]


def _numbered(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    docs = documents.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"`{text}` text")
    return staged(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")


def remove_repeats(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, name_bits: int = 64) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    if not 1 <= window <= COUNT:
        raise ValueError("a window has 1 to 255 words")
    docs = _numbered(documents, doc_id, text)
    # Round 1: names that two or more documents share.
    found = staged(window_records(docs, window, name_bits), "records")
    shared = found.groupBy("name").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    shared = staged(shared.where("first_doc < last_doc").select("name", "first_doc"), "names")
    look = found.join(shared, "name").groupBy("row").agg(F.expr("collect_list(struct(name, first_doc, place))").alias("look"))
    dealt = staged(_sorted_out(docs.join(look, "row", "left")), "dealt")
    release(found, shared, docs)
    left = dealt.where("look is not null")
    # Round 2: the first document of each extent.
    extents = staged(_digests(left, window), "extents")
    first = staged(extents.groupBy("x", "y").agg(F.min("doc_id").alias("least")), "firsts")
    judged = staged(extents.join(first, ["x", "y"]).drop("x", "y"), "judged")
    release(extents, first)
    whole = judged.where("doc_id > least").select("row", "place")
    # Round 3: windows under names whose extents differ, once for each extent.
    firsts = judged.where("doc_id = least")
    names = staged(firsts.where("doc_id > first_doc").select("name").distinct(), "open")
    opened = firsts.join(names, "name", "left_semi").groupBy("row").agg(F.collect_list("place").alias("open"))
    windows = staged(_window_digests(left.drop("look").join(opened, "row"), window), "windows")
    least = windows.groupBy("x", "y").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last"))
    least = staged(least.where("least < last").drop("last"), "least")
    late = windows.join(least, ["x", "y"]).where("doc_id > least").select("row", "place")
    gone = staged(whole.unionByName(late).groupBy("row").agg(F.collect_list("place").alias("found")), "gone")
    release(judged, names, windows, least)
    done = dealt.where("look is null").selectExpr("doc_id", "n_words", "0L n_removed", "kept_sha256")
    return done.unionByName(_cut(left.select("row", "doc_id", "text").join(gone, "row", "left"), window))
