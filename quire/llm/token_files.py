"""Token ids in rANS-coded files that decode in parallel.

Documents are dealt by ranges of doc_id and sorted, encoded with the library, and staged as raw
ids (one pass over the texts). Their symbol counts give one shared frequency table. Each range
then becomes one file; files follow each other in doc_id order.

File: ``QTOK`` header (version, bytes of an id, checksum of the frequency table); segments; footer;
trailer. A segment is a checkpoint: it starts at a document, holds whole documents, a compressed
table of their ids and lengths, and independent blocks of at most ``block`` symbols. The footer
lists each segment's offset, bytes, documents, symbols and checksum; the trailer locates and
checks the footer. Readers take segments as splits, in any order, and check every checksum.

Memory: a task holds one segment, about ``segment`` symbols or one longer document.

Defined cases: null and empty texts are just the end id; a null doc_id sorts first and reads back
as null; repeated rows are written each, next to each other; an empty table writes no file and
reads back empty; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import files
from quire.llm.common import fresh_dir, mapped, staged, tasks_for, worker_state
from quire.llm.pretokens import PATTERN, Cache, Coder, load, pieces
from quire.llm.rans import Model, block_size, decode_block, encode_block

HEADER = struct.Struct("<4sHHI")
SEGMENT = struct.Struct("<QQQQI")  # offset, bytes, documents, symbols, checksum
TRAILER = struct.Struct("<QII4s")  # footer's offset, segments, checksum, magic
NO_ID = -(1 << 63)
END_ID = 2
#: Bytes of input for one file.
FILE_BYTES = 256 << 20

class _Ids:
    """Ids of texts as little-endian bytes, through a worker's cache of pre-tokens."""

    def __init__(self, path: str, width: int, most: int = 600_000) -> None:
        self.coder, self.kind = Coder(path), f"<u{width}"
        # Bytes of every id, ready to join.
        packed = [i.to_bytes(width, "little") for i in range(self.coder.tok.get_vocab_size())]
        tokens, join = self.coder.pre_token, b"".join
        self.codes = Cache(lambda piece: join([packed[t.id] for t in tokens(piece)]), {}, most)

    def ids(self, text: str) -> bytes:
        out = []
        for part in pieces(text):
            if self.coder.plain(part):
                out.append(b"".join(map(self.codes.__getitem__, PATTERN.findall(part))))
            else:
                out.append(np.array(self.coder.whole(part), self.kind).tobytes())
        return b"".join(out)


def encode_ids(documents: DataFrame, path: str, *, doc_id: str, text: str, end_id: int, width: int) -> DataFrame:
    """doc_id, ids, counts: one row per document, dealt and sorted by doc_id; behind the documents
    of a task one row with only the counts of its symbols (pairs of int64: symbol, count)."""
    rows = documents.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"`{text}` text")
    parts = tasks_for(rows, FILE_BYTES)
    # The other two keys let a range end inside one doc_id, however many rows repeat it.
    rows = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(parts, "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_state(("ids", path, width), lambda: _Ids(path, width))
        end = np.array([end_id], coder.kind).tobytes()
        names, seen = ["doc_id", "ids", "counts"], np.zeros(1 << 16, np.int64)
        for batch in batches:
            for cut in range(0, batch.num_rows, 512):
                piece = batch.slice(cut, 512)
                got = [coder.ids(v.as_py() or "") + end for v in piece.column(1)]
                found = np.bincount(np.frombuffer(b"".join(got), coder.kind))
                if len(found) > len(seen):
                    seen = np.pad(seen, (0, len(found) - len(seen)))
                seen[: len(found)] += found
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(got, pa.binary()), pa.nulls(len(got), pa.binary())], names=names)
        if (at := np.flatnonzero(seen)).size:
            pairs = np.stack([at, seen[at]], axis=1).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([pairs], pa.binary())], names=names)

    return mapped(rows, run, "doc_id long, ids binary, counts binary")


def symbol_counts(ids: DataFrame, size: int) -> np.ndarray:
    """How often each symbol occurs, from the tasks' counts; at most ``size`` rows come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for v in batch.column(0):
                symbol, n = np.frombuffer(v.as_py(), "<i8").reshape(-1, 2).T
                total[symbol] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["s", "n"])

    out = np.zeros(size, np.int64)
    found = mapped(ids.where("counts is not null").select("counts"), run, "s long, n long")
    for s, n in found.groupBy("s").agg(F.sum("n")).collect():
        out[s] = n
    return out


def _segment(ids: list[int | None], parts: list[bytes], kind: str, model: Model, block: int) -> tuple[bytes, int]:
    symbols = np.frombuffer(b"".join(parts), kind).astype(np.int64)
    lengths = np.array([len(p) for p in parts], "<i8") // int(kind[2:])
    names = np.array([NO_ID if i is None else i for i in ids], "<i8")
    table = zlib.compress(names.tobytes() + lengths.astype("<i8").tobytes(), 1)
    blocks = [encode_block(symbols[a : a + block], model) for a in range(0, len(symbols), block)]
    return struct.pack("<II", len(table), len(blocks)) + table + b"".join(blocks), len(symbols)


def write_file(folder: str, stem: str, rows: Iterator[tuple[int | None, bytes]], model: Model, crc: int, width: int, segment: int, block: int) -> tuple[str, int, int]:
    """One file of documents in order -> (uri, documents, symbols)."""
    out, kind = files.Writer(folder, stem, "qtok"), f"<u{width}"
    out.write(HEADER.pack(b"QTOK", 1, width, crc))
    footer, docs, total = [], 0, 0
    ids, parts, size = [], [], 0

    def flush() -> None:
        nonlocal docs, total, ids, parts, size
        raw, n = _segment(ids, parts, kind, model, block)
        footer.append(SEGMENT.pack(out.write(raw), len(raw), len(ids), n, zlib.crc32(raw)))
        docs, total = docs + len(ids), total + n
        ids, parts, size = [], [], 0

    for name, raw in rows:
        ids.append(name)
        parts.append(raw)
        size += len(raw) // width
        if size >= segment:
            flush()
    if ids:
        flush()
    body = b"".join(footer)
    out.write(body + TRAILER.pack(out.size, len(footer), zlib.crc32(body), b"QTOK"))
    out.close()
    return out.uri, docs, total


def segments(uri: str) -> list[tuple[int, int, int, int, int]]:
    """A file's checkpoints, from its footer."""
    file = files.Reader(uri)
    at, n, crc, magic = TRAILER.unpack(file.read(file.size - TRAILER.size, TRAILER.size))
    fits = magic == b"QTOK" and at + n * SEGMENT.size + TRAILER.size == file.size
    body = file.read(at, n * SEGMENT.size) if fits else b""
    file.close()
    if not fits or zlib.crc32(body) != crc:
        raise ValueError(f"{uri}: not a token file, or a damaged footer")
    return [SEGMENT.unpack_from(body, k * SEGMENT.size) for k in range(n)]


def read_segment(file: files.Reader, at: int, size: int, crc: int, model: Model) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, lengths, symbols) of one checkpoint."""
    raw = file.read(at, size)
    if zlib.crc32(raw) != crc:
        raise ValueError("a segment's checksum is wrong")
    n, blocks = struct.unpack_from("<II", raw)
    names, lengths = np.frombuffer(zlib.decompress(raw[8 : 8 + n]), "<i8").reshape(2, -1)
    pos, parts = 8 + n, []
    for _ in range(blocks):
        parts.append(decode_block(raw, model, pos))
        pos += block_size(raw, pos)
    symbols = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return [None if i == NO_ID else i for i in names.tolist()], lengths, symbols


def write_tokens(
    documents: DataFrame,
    path: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = END_ID,
    vocabulary: int | None = None,
    segment: int = 1 << 20,
    block: int = 1 << 19,
    folder: str | None = None,
) -> tuple[DataFrame, str]:
    """Write the files; (manifest ``part, uri, docs, symbols, start``, uri of the frequency table).

    ``vocabulary`` bounds the ids; without it, the tokenizer's own greatest id does.
    """
    spark = documents.sparkSession
    vocabulary = max(vocabulary or 1 + max(load(path).get_vocab(True).values(), default=0), end_id + 1)
    folder = folder or fresh_dir(spark, "tokens")
    width = 2 if vocabulary <= 1 << 16 else 4
    raw = fresh_dir(spark, "ids")
    encode_ids(documents, path, doc_id=doc_id, text=text, end_id=end_id, width=width).write.option("compression", "zstd").parquet(raw)
    ids = spark.read.schema("doc_id long, ids binary, counts binary").parquet(raw)
    table = Model.from_counts(symbol_counts(ids, vocabulary)).to_bytes()
    crc = zlib.crc32(table)
    model_uri = files.put(folder, "frequencies", "qfrq", table)
    # Spark names its part files by partition, so their names give the doc_id order.
    system, at = files.opened(raw)
    from pyarrow.fs import FileSelector

    names = sorted(f.base_name for f in system.get_file_info(FileSelector(at)) if f.base_name.startswith("part-"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            for k, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                model = model or Model.from_bytes(files.get(model_uri))
                got_system, got = files.opened(f"{raw}/{name}")
                file = pq.ParquetFile(got_system.open_input_file(got))
                parts = file.iter_batches(256, columns=["doc_id", "ids"])
                rows = (r for b in parts for r in zip(*(c.to_pylist() for c in b.columns), strict=True) if r[1] is not None)
                uri, docs, symbols = write_file(folder, f"part-{k:06d}", rows, model, crc, width, segment, block)
                yield pa.RecordBatch.from_pydict({"part": [k], "uri": [uri], "docs": [docs], "symbols": [symbols]})

    kind = "part long, uri string, docs long, symbols long"
    if not names:
        return spark.createDataFrame([], f"{kind}, start long"), model_uri
    todo = spark.createDataFrame(list(enumerate(names)), "part long, name string").repartition(len(names), "part")
    done = staged(mapped(todo, run, kind), "manifest")
    # One row a file: its first symbol's place among all.
    rows, start = [], 0
    for r in done.orderBy("part").collect():
        rows.append((*r, start))
        start += r["symbols"]
    return spark.createDataFrame(rows, f"{kind}, start long"), model_uri


def read_tokens(spark: SparkSession, manifest: DataFrame, model_uri: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32. Segments decode in parallel."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                for at, size, _, n, crc in segments(uri):
                    rows.append((uri, at, size, crc, start))
                    start += n
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["uri", "at", "size", "crc", "start"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            for uri, at, size, crc, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                model = model or Model.from_bytes(files.get(model_uri))
                file = files.Reader(uri)
                names, lengths, symbols = read_segment(file, at, size, crc, model)
                file.close()
                ends = np.cumsum(lengths)
                first = ends - lengths
                raw = memoryview(symbols.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(first + start), pa.array(lengths), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    parts = mapped(manifest.select("uri", "start"), split, "uri string, at long, size long, crc long, start long")
    # A segment is a row here and a decoded block of ids later.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), manifest.count())
    parts = parts.repartition(tasks)
    return mapped(parts, decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(documents: DataFrame, path: str, **options) -> DataFrame:
    """Write all documents and read the digest of each back from the files."""
    manifest, model_uri = write_tokens(documents, path, **options)
    return read_tokens(documents.sparkSession, manifest, model_uri)
