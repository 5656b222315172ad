import hashlib
import io
import random
import zipfile
import zlib

import pytest

from quire.llm import files, warc, zipread
from quire.llm.common import fresh_dir


def brute(rows):
    top, out = {}, []
    for page, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 1000 and page is not None:
            top[raw] = max(top.get(raw, page), page)
    for page, _, html in rows:
        raw = (html or "").encode()
        first = top.get(raw) if len(raw) >= 1000 else None
        again = first is not None and first != page
        out.append((str(page), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.selectExpr("*", "'x' payload", "'y' digest", "'z' uri", "1 first").repartition(3)


def case():
    rng = random.Random(3)
    big = ["".join(rng.choice("ab<>é\n\r") for _ in range(1200)) for _ in range(4)]
    rows = [(i, f"http://x/{i}?a=\r\nb c", rng.choice([*big, "small", "WARC/1.1\r\n\r\n" * 90])) for i in range(60)]
    return rows + [(100, None, None), (101, "", ""), (102, "u", "x" * 999), (103, "u", "x" * 999), (104, "u", "x" * 1000), (105, "u", "x" * 1000), (105, "u", "x" * 1000), (None, "u", big[0]), (None, None, "y" * 1000), (-7, "é", "日" * 400_000)]


def test_round_trip(spark):
    rows = case()
    for options in ({}, {"always64": True, "member_bytes": 2000}, {"archive_bytes": 5000, "member_bytes": 500}):
        got = warc.archive_round_trip(pages(spark, rows), **options).collect()
        assert sorted(((str(r[0]), *tuple(r)[1:]) for r in got), key=str) == brute(rows), options
    assert warc.archive_round_trip(pages(spark, [])).collect() == []


def test_payloads_and_foreign_archives(spark):
    """Archives by the standard library: plain and gzip members, with and without an index."""
    records = [warc.record_bytes(i, f"http://p/{i}", f"body {i}".encode() * i, hashlib.sha1(f"body {i}".encode() * i).hexdigest(), None, "2020-01-01T00:00:00Z") for i in range(30)]
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    squeeze = lambda r: (z := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(r) + z.flush()
    folder = fresh_dir(spark, "foreign")
    uris = []
    for name, member in (("plain.warc", info + b"".join(records)), ("packed.warc.gz", b"".join(map(squeeze, [info, *records])))):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            z.writestr("datapackage.json", "{}")
            z.writestr(f"archive/{name}", member)
        uris.append((files.put(folder, "a", "zip", out.getvalue()),))
    got = warc.read_archives(spark, spark.createDataFrame(uris, "uri string")).collect()
    assert sorted((r.page_id, bytes(r.payload)) for r in got) == sorted((i, f"body {i}".encode() * i) for i in range(30) for _ in range(2))


def test_directory_agrees_with_the_standard_library():
    rng = random.Random(1)
    for always in (False, True):
        out = io.BytesIO()
        writer = zipread.ZipWriter(out.write, always)
        data = {f"dir/é{i}.bin": rng.randbytes(rng.randrange(300)) for i in range(50)}
        for name, raw in data.items():
            writer.add(name, raw)
        writer.close()
        raw = out.getvalue()
        assert {n: zipfile.ZipFile(io.BytesIO(raw)).read(n) for n in data} == data
        read = lambda at, n, raw=raw: raw[at : at + n]
        members = zipread.directory(read, len(raw))
        assert {m.name: read(zipread.data_start(read, m), m.size) for m in members} == data
    many = io.BytesIO()
    with zipfile.ZipFile(many, "w") as z:
        for i in range(66_000):
            z.writestr(str(i), b"")
        z.comment = b"PK\5\6 in the comment"
    raw = many.getvalue()
    assert len(zipread.directory(lambda at, n: raw[at : at + n], len(raw))) == 66_000


def test_refuses_what_it_cannot_read():
    read = lambda raw: zipread.directory(lambda at, n: raw[at : at + n], len(raw))
    for bad in (b"", b"x" * 100, b"PK\5\6" + b"\0" * 10):
        with pytest.raises(ValueError):
            read(bad)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.warc", b"x" * 1000)
    raw = out.getvalue()
    with pytest.raises(ValueError, match="not stored"):
        zipread.data_start(lambda at, n: raw[at : at + n], read(raw)[0])
