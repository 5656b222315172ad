"""Formats of files by their bytes, as Spark columns: no parsing, nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Marks inside ZIP packages, in the order they are tried; a package without any is docx.
ZIP_MARKS = (
    ("application/vnd.oasis.opendocument.text", "odt"),
    ("application/vnd.oasis.opendocument.spreadsheet", "ods"),
    ("application/vnd.oasis.opendocument.presentation", "odp"),
    ("word/document.xml", "docx"),
    ("ppt/presentation.xml", "pptx"),
    ("xl/workbook", "xlsx"),
)
#: Stream names inside compound files; one without any is doc.
CFB_MARKS = (("WordDocument", "doc"), ("Workbook", "xls"), ("Book", "xls"))
FLAT_MARKS = (("opendocument.text", "fodt"), ("opendocument.spreadsheet", "fods"), ("opendocument.presentation", "fodp"))
#: What each extension may be read as, and to what it is converted.
EXTENSIONS = (
    "docx", "docm", "dotx", "dotm", "doc", "dot", "odt", "ott", "fodt", "xlsx", "xlsm", "xltx", "xltm", "xls", "xlt",
    "ods", "ots", "fods", "pptx", "odp", "otp", "fodp", "md", "markdown",
)


def _starts(content: Column, hexed: str) -> Column:
    return F.hex(F.substring(content, 1, len(hexed) // 2)) == hexed


def _latin(content: Column, n: int | None = None) -> Column:
    return F.decode(content if n is None else F.substring(content, 1, n), "ISO-8859-1")


def detect_format(content: Column) -> Column:
    """docx, xlsx, pptx, odt, ods, odp, doc, xls, fodt, fods, fodp, or null."""
    zipped = F.lit("docx")
    for mark, kind in reversed(ZIP_MARKS):
        zipped = F.when(_latin(content).contains(mark), kind).otherwise(zipped)
    compound = F.lit("doc")
    for mark, kind in reversed(CFB_MARKS):
        wide = "".join(f"{c}\0" for c in mark) + "\0\0"
        compound = F.when(_latin(content).contains(wide), kind).otherwise(compound)
    head = _latin(content, 4096)
    flat = F.lit(None).cast("string")
    for mark, kind in reversed(FLAT_MARKS):
        flat = F.when(head.contains(mark), kind).otherwise(flat)
    return (
        F.when(_starts(content, "504B0304"), zipped)
        .when(_starts(content, "D0CF11E0A1B11AE1"), compound)
        .when(head.contains("office:document"), flat)
    )


def reader_for(extension: Column, content: Column) -> Column:
    """The reader of a file: its extension's, unless the bytes are another container."""
    ext = normalize(extension)
    found = detect_format(content)
    family = (
        F.when(ext.isin("docm", "dotx", "dotm"), "docx").when(ext == "dot", "doc").when(ext == "ott", "odt")
        .when(ext.isin("xlsm", "xltx", "xltm"), "xlsx").when(ext == "xlt", "xls").when(ext == "ots", "ods").when(ext == "otp", "odp")
        .when(ext == "markdown", "md").otherwise(ext)
    )
    return F.when(family == "md", "md").otherwise(F.coalesce(found, family))


def normalize(extension: Column) -> Column:
    """Lower case, without one leading dot."""
    return F.regexp_replace(F.lower(extension), r"^\.", "")


def formats(spark: SparkSession) -> DataFrame:
    """What can be read."""
    return spark.createDataFrame([(e,) for e in EXTENSIONS], "extension string")


def supports(extension: Column) -> Column:
    return normalize(extension).isin(*EXTENSIONS)


def image_format(content: Column) -> Column:
    """png, jpeg, gif or svg by magic bytes; null for anything else."""
    head = F.substring(content, 1, 2048)
    svg = _latin(content, 512).contains("<") & F.is_valid_utf8(F.decode(head, "ISO-8859-1")) & _latin(content, 2048).contains("<svg")
    return (
        F.when(_starts(content, "89504E47"), "png")
        .when(_starts(content, "FFD8"), "jpeg")
        .when(_starts(content, "474946"), "gif")
        .when(svg, "svg")
    )


def png_size(content: Column) -> Column:
    """struct(width, height) of a PNG's header; null otherwise."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    return F.when(_starts(content, "89504E47") & (F.length(content) >= 24), F.struct(number(17).alias("width"), number(21).alias("height")))


def base64_bytes(text: Column) -> Column:
    """Bytes of base64 text: other characters are skipped, the first = ends it; null if none."""
    bare = F.regexp_replace(F.regexp_replace(text, "(?s)=.*$", ""), "[^A-Za-z0-9+/]", "")
    whole = F.substring(bare, F.lit(1), (F.length(bare) - F.when(F.length(bare) % 4 == 1, 1).otherwise(0)).cast("int"))
    padded = F.concat(whole, F.repeat(F.lit("="), F.pmod(-F.length(whole), F.lit(4)).cast("int")))
    return F.when(whole != "", F.unbase64(padded))


def data_uri(text: Column) -> Column:
    """Bytes of a base64 data: address; null for others."""
    return F.when(text.rlike("(?s)^data:[^,]*;base64,"), base64_bytes(F.regexp_replace(text, "(?s)^data:[^,]*,", "")))


def jpeg_dimensions(data: bytes) -> tuple[int, int] | None:
    """(width, height) from a JPEG's first frame header."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 < len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        mark = data[at + 1]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        at += 2 if mark in (0xFF, 0x01) or 0xD0 <= mark <= 0xD8 else 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None
