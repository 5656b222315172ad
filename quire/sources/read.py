"""The parse stage: files to normalized tables, one Arrow map, errors kept as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quire.batches import mapped
from quire.sources import sniff, spreadsheets, texts, worddoc
from quire.sources.drawings import read_media
from quire.sources.odf_charts import read_package_charts
from quire.sources.parsed import TABLES, Parsed, Wanted, schema_of, wanting

READERS: dict[str, Callable[[bytes], Parsed]] = {
    "xlsx": spreadsheets.read_xlsx, "xls": spreadsheets.read_xls, "ods": spreadsheets.read_ods, "fods": spreadsheets.read_ods,
    "docx": texts.read_docx, "doc": worddoc.read_doc, "odt": texts.read_odt, "fodt": texts.read_odt,
    "pptx": texts.read_pptx, "odp": texts.read_odp, "fodp": texts.read_odp, "md": texts.read_markdown,
}
#: Files are parsed whole, so larger ones become error rows instead of taking a worker down.
MOST_BYTES = 256 << 20


#: Rows of documents that go on together in one Arrow batch.
BATCH_ROWS = 8192


def parse_one(kind: str | None, content: bytes | None, most: int = MOST_BYTES, wanted: Wanted | None = None) -> tuple[int, str | None, Parsed]:
    """(status, error, rows): 0 fine, 1 not readable."""
    if kind not in READERS or content is None:
        return 1, f"unsupported format: {kind}", Parsed()
    if len(content) > most:
        return 1, f"over {most} bytes", Parsed()
    try:
        with wanting(wanted):
            parsed = READERS[kind](content)
        if kind in ("ods", "odt", "odp") and parsed.wants("charts", "chart_points"):
            read_package_charts(content, parsed)
        if parsed.wants("media"):
            read_media(content, parsed)
        return 0, None, parsed
    except RecursionError:
        return 1, "nested too deep", Parsed()
    except Exception as wrong:  # a bad file is a row, never a failed job
        return 1, f"{type(wrong).__name__}: {wrong}"[:500], Parsed()


def parse_files(files: DataFrame, *, doc_id: str = "path", content: str = "content", most: int = MOST_BYTES, tables: Sequence[str] = tuple(TABLES)) -> DataFrame:
    """``files`` (doc_id, content) -> one row a document with an array for each of ``tables``."""
    name = F.col(doc_id).cast("string")
    extension = F.regexp_extract(name, r"(\.[^./\\]+)$", 1)
    rows = files.select(name.alias("doc_id"), sniff.reader_for(extension, F.col(content)).alias("format"), F.col(content).alias("content"))
    ddl = schema_of(tables)
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    wanted = None if set(tables) == set(TABLES) else Wanted(frozenset(tables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for one in _documents(batches):
            status, error, parsed = parse_one(one["format"], one["content"], most, wanted)
            row = {"doc_id": one["doc_id"], "format": one["format"], "status": status, "error": error, "default_tab": parsed.default_tab, **{t: parsed.rows[t] for t in tables}}
            held.append(row)
            size += 1 + sum(len(parsed.rows[t]) for t in tables)
            if size >= BATCH_ROWS or any(parsed.rows.get("media", ())):
                yield _packed(schema, held)
                held, size = [], 0
        if held:
            yield _packed(schema, held)

    out = mapped(rows, run, ddl)
    out.parsed_from = (rows, most, tuple(tables))
    return out


def _documents(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of the batches, one at a time as Python values."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}


def _packed(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


def read_documents(spark: SparkSession, path: str, **options) -> DataFrame:
    """Parse all files below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return parse_files(files.select("path", "content"), **options)


def view(parsed: DataFrame, name: str) -> DataFrame:
    """One normalized table: ``doc_id`` and its columns.

    Straight from ``parse_files``, the files are parsed for this table alone and its rows go on in
    batches, so no document's rows stand in one row of a frame.
    """
    files, most, tables = getattr(parsed, "parsed_from", (None, 0, ()))
    if files is None or name not in tables or parsed.is_cached:
        return parsed.select("doc_id", F.explode(name).alias("_row")).select("doc_id", "_row.*")
    schema = to_arrow_schema(StructType.fromDDL(TABLES[name]))
    whole = schema.insert(0, pa.field("doc_id", pa.string()))
    wanted = Wanted(frozenset([name]), lambda _, rows: _packed(schema, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = [], []
        for one in _documents(batches):
            _, _, parsed = parse_one(one["format"], one["content"], most, wanted)
            for part in parsed.packed.pop(name, ()):
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(one["doc_id"], pa.string()), part.num_rows), *part.columns], schema=whole)
            held += parsed.rows[name]
            ids += [one["doc_id"]] * len(parsed.rows[name])
            if len(held) >= BATCH_ROWS or name == "media":
                yield from _cut(whole, schema, ids, held)
                ids, held = [], []
        yield from _cut(whole, schema, ids, held)

    return mapped(files, run, f"doc_id string, {TABLES[name]}")


def _cut(whole: pa.Schema, schema: pa.Schema, ids: list, rows: list[dict]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), BATCH_ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + BATCH_ROWS], pa.string()), *_packed(schema, rows[at : at + BATCH_ROWS]).columns], schema=whole)


def source_text(parsed: DataFrame) -> DataFrame:
    """doc_id, text: paragraphs in order, table cells and sheet cells, joined by line feeds."""
    order = lambda arr, key: F.transform(F.array_sort(arr, lambda a, b: F.when(a[key] < b[key], -1).when(a[key] > b[key], 1).otherwise(0)), lambda r: r["text"])
    body = order(F.filter("blocks", lambda b: (b["kind"] == "paragraph") & b["text"].isNotNull()), "path")
    shown = F.transform(F.filter("cells", lambda c: c["kind"] != "empty"), lambda c: F.coalesce(c["txt"], c["num"].cast("string"), c["flag"].cast("string")))
    return parsed.select("doc_id", F.array_join(F.concat(body, shown), "\n").alias("text"))
