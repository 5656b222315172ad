"""WARC records in ZIP-packaged archives: write pages, read records by ranges.

An archive is a ZIP file of stored members: ``archive/*.warc.gz`` (one gzip member a record) and
``indexes/*.cdxj`` (a JSON line a record with file, offset and length). The reader parses each
archive's central or ZIP64 directory, finds the stored members and indexes, and reads only the
indexed ranges, many splits an archive; a WARC member that no index names is walked record by
record. Nothing is extracted to disk.

Writing: payload digests are grouped map side, so one payload that a third of all pages share is
one row a task; only digests that occur twice come back to the pages. Spark broadcasts them if
they are within its own threshold, else it joins by digest and AQE splits a hot digest.

Defined cases: a null page is an empty payload; a null url becomes ``urn:quire:none``; null
page_ids read back null and are never referred to, so a payload whose page_ids are all null is a
response each time; rows that repeat the largest page_id are all responses; an empty table writes
nothing and reads back empty; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import files
from quire.llm.common import fresh_dir, mapped, staged
from quire.llm.zipread import ZipWriter, data_start, directory

LEAST_REVISIT = 1000
PAGE_URN = "urn:quire:page:"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def _name(page_id: int | None) -> str:
    return f"<{PAGE_URN}{'none' if page_id is None else page_id}>"


def _page(name: str | None) -> int | None:
    found = re.fullmatch(rf"<{PAGE_URN}(-?\d+)>", name or "")
    return int(found[1]) if found else None


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header, whose length is the full payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:quire:none"
    sha = base64.b32encode(bytes.fromhex(digest)).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{sha}",
        "Content-Type: application/http;msgtype=response",
    ]
    if refers_to is not None:
        head += [
            f"WARC-Refers-To: {_name(refers_to)}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
        body = http
    else:
        body = http + payload
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def parse_record(raw: bytes) -> tuple | None:
    """A RECORD row of one uncompressed record; None for other kinds of record."""
    if not raw.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _headers(head)
    block = rest[: int(fields["content-length"])]
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    said = fields.get("warc-payload-digest", "").partition(":")[2]
    digest = base64.b32decode(said).hex() if said else None
    if kind == "response":
        own = hashlib.sha1(payload).hexdigest()
        if digest not in (None, own):
            raise ValueError("a payload's digest is wrong")
        digest, size = own, len(payload)
    else:
        size, payload = int(_headers(http).get("content-length", 0)), None
    return (
        _page(fields.get("warc-record-id")), fields.get("warc-target-uri"), kind,
        _page(fields.get("warc-refers-to")) if kind == "revisit" else None, digest, size, payload,
    )


def write_archives(
    pages: DataFrame,
    *,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    date: str = "2000-01-01T00:00:00Z",
    folder: str | None = None,
    member_bytes: int = 16 << 20,
    archive_bytes: int = 1 << 30,
    level: int = 4,
    always64: bool = False,
) -> DataFrame:
    """Write every page as a record; the manifest ``uri, records``."""
    spark = pages.sparkSession
    folder = folder or fresh_dir(spark, "warc")
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.where(F.length("payload") >= LEAST_REVISIT)
    first = large.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = staged(first.where("n > 1 and first is not null").select("digest", "first"), "payloads")
    rows = rows.join(first, "digest", "left")
    other = "case when page_id is null or page_id <> first then first end refers_to"
    rows = rows.selectExpr("page_id", "url", "payload", "digest", other)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = zipped = None
        body, lines, members, records = [], [], 0, 0
        at = 0

        def flush() -> None:
            nonlocal body, lines, members, at
            if not body:
                return
            stem = f"data-{members:05d}"
            zipped.add(f"archive/{stem}.warc.gz", b"".join(body))
            zipped.add(f"indexes/{stem}.cdxj", "".join(lines).encode())
            body, lines, at, members = [], [], 0, members + 1

        def close() -> pa.RecordBatch:
            flush()
            zipped.close()
            out.close()
            return pa.RecordBatch.from_pydict({"uri": [out.uri], "records": [records]})

        for batch in batches:
            for page, link, raw, digest, to in zip(*batch.columns, strict=True):
                if out is None:
                    out, members, records = files.Writer(folder, "pages", "zip"), 0, 0
                    zipped = ZipWriter(out.write, always64)
                record = record_bytes(page.as_py(), link.as_py(), raw.as_py(), digest.as_py(), to.as_py(), date)
                squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                packed = squeeze.compress(record) + squeeze.flush()
                place = {"filename": f"data-{members:05d}.warc.gz", "offset": at, "length": len(packed)}
                lines.append(f"{_name(page.as_py())} {date} {json.dumps(place)}\n")
                body.append(packed)
                at, records = at + len(packed), records + 1
                if at >= member_bytes:
                    flush()
                if out.size >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return staged(mapped(rows, run, "uri string, records long"), "manifest")


def _gunzip(raw: bytes) -> bytes:
    return zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw


def _walk(file: files.Reader, at: int, end: int, step: int = 1 << 20) -> Iterator[bytes]:
    """Records of a member without an index, one in memory at a time."""
    if file.read(at, min(2, end - at)) == b"\x1f\x8b":
        held = b""
        while at < end or held:
            unpack, parts = zlib.decompressobj(31), []
            while not unpack.eof:
                if not held:
                    if at >= end:
                        raise ValueError("a record is cut short")
                    held = file.read(at, min(step, end - at))
                    at += len(held)
                parts.append(unpack.decompress(held))
                held = unpack.unused_data
            yield b"".join(parts)
        return
    while at < end:
        head, n = b"", 4096
        while (cut := head.find(b"\r\n\r\n")) < 0:
            if len(head) == end - at:
                raise ValueError("a record is cut short")
            head = file.read(at, min(n, end - at))
            n *= 2
        size = cut + 4 + int(_headers(head[:cut])["content-length"]) + 4
        yield file.read(at, min(size, end - at))
        at += size


def archive_splits(uri: str, split_bytes: int) -> Iterator[tuple[str, int, int, list[int], list[int]]]:
    """(uri, start, end, offsets, lengths): indexed ranges in runs of about ``split_bytes``.

    A member without index entries is one run with no offsets.
    """
    file = files.Reader(uri)
    try:
        members = directory(file.read, file.size)
        stored = {m.name.rpartition("/")[2]: m for m in members if re.search(r"\.warc(\.gz)?$", m.name)}
        places: dict[str, list[tuple[int, int]]] = {name: [] for name in stored}
        for m in members:
            if re.search(r"\.cdxj?(\.gz)?$", m.name):
                lines = _gunzip(file.read(data_start(file.read, m), m.size)) if m.size else b""
                for line in lines.decode().splitlines():
                    if (brace := line.find("{")) >= 0:
                        entry = json.loads(line[brace:])
                        name = entry["filename"].rpartition("/")[2]
                        if name in places:
                            places[name].append((int(entry["offset"]), int(entry["length"])))
        for name, m in stored.items():
            start = data_start(file.read, m)
            found = sorted(set(places[name]))
            if not found:
                if m.size:
                    yield uri, start, start + m.size, [], []
                continue
            run: list[tuple[int, int]] = []
            for at, n in found:
                if run and at + n - run[0][0] > split_bytes:
                    yield uri, start + run[0][0], start + run[-1][0] + run[-1][1], [a - run[0][0] for a, _ in run], [k for _, k in run]
                    run = []
                run.append((at, n))
            yield uri, start + run[0][0], start + run[-1][0] + run[-1][1], [a - run[0][0] for a, _ in run], [k for _, k in run]
    finally:
        file.close()


def read_archives(spark: SparkSession, archives: DataFrame, *, split_bytes: int = 4 << 20, payloads: bool = True) -> DataFrame:
    """RECORD rows of all response and revisit records of the archives (column ``uri``)."""
    split = "uri string, start long, end long, offsets array<long>, lengths array<long>"

    def splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = ["uri", "start", "end", "offsets", "lengths"]
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                for row in archive_splits(uri, split_bytes):
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for uri, start, end, offsets, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file = files.Reader(uri)
                if offsets:
                    raw = file.read(start, end - start)
                    whole = (_gunzip(raw[a : a + n]) for a, n in zip(offsets, lengths, strict=True))
                else:
                    whole = _walk(file, start, end)
                rows, size = [], 0
                for record in whole:
                    if (row := parse_record(record)) is not None:
                        rows.append(row if payloads else (*row[:-1], None))
                        size += len(record)
                    if size > split_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, size = [], 0
                file.close()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    runs = mapped(archives.select("uri"), splits, split)
    runs = runs.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), archives.count()))
    return mapped(runs, records, RECORD)


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Per page, read back from its archive: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    back = read_archives(spark, write_archives(pages, **options), payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
