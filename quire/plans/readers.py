"""Reader queries: files are built from the driver's tables inside the query, parsed, and their views held against SQL."""

from __future__ import annotations

import io
import struct
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

from quire.plans.sheets import table
from quire.sources.read import parse_files, view

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# Files -------------------------------------------------------------------------------------------

@pandas_udf(BinaryType())
def zipped(parts: pd.Series) -> pd.Series:
    """A package of parts: names and texts in turn."""

    def one(items) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in zip(items[::2], items[1::2], strict=True):
                z.writestr(zipfile.ZipInfo(name), text)
        return out.getvalue()

    return parts.map(one)


def package(parts: dict[str, Column]) -> Column:
    return zipped(F.array(*[c for name, text in parts.items() for c in (F.lit(name), text)]))


def escaped(text: Column) -> Column:
    for raw, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    return text


def xml(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def listed(order: list[str], text: Column) -> Column:
    """Texts of a group in the order of these columns, as one."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, text.alias("_text")))), lambda x: x["_text"]), "")


def parsed_back(files: DataFrame, name: str, content: Column, extension: str, *tables: str) -> DataFrame:
    """Files named after column ``name``, parsed."""
    return parse_files(files.select(F.concat(F.col(name).cast("string"), F.lit(f".{extension}")).alias("path"), content.alias("content")), tables=tables)


def numbered(out: DataFrame, name: str) -> DataFrame:
    return out.withColumn(name, F.regexp_extract("doc_id", r"^(\d+)", 1).cast("long")).drop("doc_id")


def read_back(files: DataFrame, name: str, content: Column, extension: str, views: str) -> DataFrame:
    """A view over files named after column ``name``, with that column as a number."""
    return numbered(view(parsed_back(files, name, content, extension, views), views), name)


OFFICE_RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def relationships(*targets: tuple[str, str, str] | Column) -> Column:
    rows = [t if isinstance(t, Column) else F.lit(f'<Relationship Id="{t[0]}" Type="{OFFICE_RELS}/{t[1]}" Target="{t[2]}"/>') for t in targets]
    return F.concat(F.lit('<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'), *rows, F.lit("</Relationships>"))


# Sheets ------------------------------------------------------------------------------------------

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
SUPPLIED = f"""
WITH lines AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(ORDER)}) AS r FROM lineitem)
"""


def supplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier is a workbook, its lines are the rows."""
    return table(spark, sf_dir, "lineitem").withColumn("r", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*ORDER)))


def workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_suppkey, sheet: quantity, price with a format, flag as a shared string, status inline, a logical; the tenth rows are hidden."""
    r = F.col("r")
    cell = lambda column, mark, value: xml(f'<c r="{column}', r, f'"{mark}>', value, "</c>")
    number = lambda c: xml("<v>", F.col(c), "</v>")
    row = xml(
        '<row r="', r, '"', F.when(r % 10 == 0, ' hidden="1"').otherwise(""), ">", cell("A", "", number("l_quantity")), cell("B", ' s="1"', number("l_extendedprice")),
        cell("C", ' t="s"', xml("<v>", F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2), "</v>")),
        cell("D", ' t="inlineStr"', xml("<is><r><t>", F.col("l_linestatus"), "</t></r><r><t>-", F.col("l_linenumber"), "</t></r></is>")),
        cell("E", ' t="b"', F.when(F.col("l_tax") > 0.04, "<v>1</v>").otherwise("<v>0</v>")), "</row>",
    )
    rules = xml(
        '<mergeCells><mergeCell ref="F1:G', F.col("l_suppkey") % 5 + 2, '"/></mergeCells><conditionalFormatting sqref="A1:A', F.max("r"), ' C1:C9"><cfRule type="cellIs" dxfId="3" priority="2" operator="greaterThan"><formula>',
        F.col("l_suppkey"), '</formula></cfRule></conditionalFormatting><rowBreaks><brk id="', F.col("l_suppkey") % 7 + 1, '"/></rowBreaks>',
    )
    columns = xml('<cols><col min="1" max="', F.col("l_suppkey") % 4 + 1, '" width="', F.col("l_suppkey") + 5, '.5"/></cols>')
    sheet = xml('<worksheet xmlns="s">', columns, "<sheetData>", listed(["r"], row), "</sheetData>", rules, "</worksheet>")
    return supplied(spark, sf_dir).groupBy("l_suppkey").agg(sheet.alias("sheet"))


def xlsx_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str, Column, str]:
    content = package({
        "_rels/.rels": relationships(("r1", "officeDocument", "xl/workbook.xml")),
        "xl/workbook.xml": F.lit(f'<workbook xmlns="s" xmlns:r="{OFFICE_RELS}"><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>'),
        "xl/_rels/workbook.xml.rels": relationships(("r1", "worksheet", "worksheets/sheet1.xml"), ("r2", "sharedStrings", "sharedStrings.xml"), ("r3", "styles", "styles.xml")),
        "xl/worksheets/sheet1.xml": F.col("sheet"),
        "xl/sharedStrings.xml": F.lit('<sst xmlns="s"><si><t>A</t></si><si><t>N</t></si><si><t>R</t></si></sst>'),
        "xl/styles.xml": F.lit('<styleSheet xmlns="s"><cellXfs><xf numFmtId="0"/><xf numFmtId="4"/></cellXfs></styleSheet>'),
    })
    return workbooks(spark, sf_dir), "l_suppkey", content, "xlsx"


def xlsx_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_back(*xlsx_files(spark, sf_dir), name)


@query(
    SUPPLIED
    + """SELECT l_suppkey, r, 1 AS c, 'number' AS kind, l_quantity AS num, NULL AS txt, NULL AS flag, 0 AS xf FROM lines
UNION ALL SELECT l_suppkey, r, 2, 'number', l_extendedprice, NULL, NULL, 1 FROM lines
UNION ALL SELECT l_suppkey, r, 3, 'text', NULL, l_returnflag, NULL, 0 FROM lines
UNION ALL SELECT l_suppkey, r, 4, 'text', NULL, l_linestatus || '-' || l_linenumber, NULL, 0 FROM lines
UNION ALL SELECT l_suppkey, r, 5, 'bool', NULL, NULL, l_tax > 0.04, 0 FROM lines"""
)
def xlsx_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of OOXML workbooks: numbers, shared and inline strings, logicals."""
    return xlsx_view(spark, sf_dir, "cells").select("l_suppkey", "r", "c", "kind", "num", "txt", "flag", "xf")


@query(
    """WITH n AS (SELECT l_suppkey, CAST(count(*) AS INTEGER) AS n FROM lineitem GROUP BY 1)
SELECT l_suppkey, 1 AS r1, 1 AS c1, n AS r2, 1 AS c2, 'cellIs' AS kind, 'greaterThan' AS operator, CAST(l_suppkey AS VARCHAR) AS formula, 3 AS dxf FROM n
UNION ALL SELECT l_suppkey, 1, 3, 9, 3, 'cellIs', 'greaterThan', CAST(l_suppkey AS VARCHAR), 3 FROM n"""
)
def xlsx_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional formats of OOXML workbooks: one row for each area."""
    rules = xlsx_view(spark, sf_dir, "cond_rules")
    return rules.select("l_suppkey", "r1", "c1", "r2", "c2", "kind", "operator", F.array_join("formulas", ",").alias("formula"), "dxf")


@query(
    """WITH n AS (SELECT l_suppkey, CAST(count(*) AS INTEGER) AS n FROM lineitem GROUP BY 1)
SELECT l_suppkey, 1 AS r1, 1 AS c1, greatest(n, CAST(l_suppkey % 5 + 2 AS INTEGER)) AS r2, 7 AS c2, n // 10 AS hidden_rows, CAST(l_suppkey % 4 + 1 AS INTEGER) AS wide_columns, l_suppkey + 5.5 AS width, CAST(l_suppkey % 7 + 1 AS INTEGER) AS break_after FROM n"""
)
def xlsx_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Used range with merges, hidden rows, column widths and breaks of OOXML workbooks."""
    books = numbered(parsed_back(*xlsx_files(spark, sf_dir), "sheets", "sheet_rows", "col_specs", "breaks"), "l_suppkey")
    hidden = F.size(F.filter("sheet_rows", lambda r: F.coalesce(r["hidden"], F.lit(False)))).cast("long")
    out = books.select("l_suppkey", hidden.alias("hidden_rows"), "col_specs", "breaks", F.explode("sheets").alias("s"))
    out = out.select("l_suppkey", "s", "hidden_rows", "breaks", F.explode("col_specs").alias("w"))
    out = out.select("l_suppkey", "s", "hidden_rows", "w", F.explode("breaks").alias("b"))
    return out.select("l_suppkey", *[F.col(f"s.{n}").alias(n) for n in ("r1", "c1", "r2", "c2")], "hidden_rows", F.col("w.c_max").alias("wide_columns"), F.col("w.width").alias("width"), F.col("b.after").alias("break_after"))


ODF = 'xmlns:office="o" xmlns:table="t" xmlns:text="x" xmlns:style="s" xmlns:calcext="c"'


def flat(kind: str, body: Column, styles: str = "") -> Column:
    return F.encode(xml(f'<?xml version="1.0"?><office:document {ODF} office:mimetype="application/vnd.oasis.opendocument.{kind}">{styles}<office:body>', body, "</office:body></office:document>"), "UTF-8")


def shopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation is a sheet; a customer's balance and segment repeat by the customer's key, and so does the row."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").withColumns({"wide": F.when(k % 50 == 0, 300).otherwise(k % 3 + 1), "tall": k % 2 + 1})


@query(
    """WITH c AS (SELECT *, CASE WHEN c_custkey % 50 = 0 THEN 300 ELSE c_custkey % 3 + 1 END AS wide, c_custkey % 2 + 1 AS tall FROM customer),
s AS (SELECT *, coalesce(sum(tall) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM c),
e AS (SELECT *, unnest(range(tall)) AS down FROM s)
SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, CAST(above + down + 1 AS INTEGER) AS r, CAST(i + 1 AS INTEGER) AS c, 'shown' AS kind, c_acctbal AS num, CAST(c_custkey AS VARCHAR) AS txt FROM (SELECT *, unnest(range(wide)) AS i FROM e)
UNION ALL SELECT c_nationkey, CAST(above + down + 1 AS INTEGER), CAST(wide + 3 AS INTEGER), 'text', NULL, c_mktsegment FROM e"""
)
def repeat_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of flat OpenDocument sheets: repeated values fill their whole repeat, in repeated rows."""
    number = xml('<table:table-cell table:number-columns-repeated="', F.col("wide"), '" office:value-type="float" office:value="', F.col("c_acctbal"), '"><text:p>', F.col("c_custkey"), "</text:p></table:table-cell>")
    blank, text = '<table:table-cell table:number-columns-repeated="2"/>', xml('<table:table-cell office:value-type="string"><text:p>', escaped(F.col("c_mktsegment")), "</text:p></table:table-cell>")
    row = xml('<table:table-row table:number-rows-repeated="', F.col("tall"), '">', number, blank, text, "</table:table-row>")
    books = shopping(spark, sf_dir).groupBy("c_nationkey").agg(listed(["c_custkey"], row).alias("rows"))
    content = flat("spreadsheet", xml('<office:spreadsheet><table:table table:name="T">', F.col("rows"), "</table:table></office:spreadsheet>"))
    return read_back(books, "c_nationkey", content, "fods", "cells").select("c_nationkey", "r", "c", "kind", "num", "txt")


@query(
    """SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, CAST(c_custkey + 1 AS INTEGER) AS r1,
  CASE c_custkey % 6 WHEN 2 THEN 'expression' WHEN 3 THEN 'beginsWith' WHEN 4 THEN 'cellIs' WHEN 5 THEN 'cellIs' ELSE 'cellIs' END AS kind,
  CASE c_custkey % 6 WHEN 0 THEN 'between' WHEN 1 THEN 'greaterThanOrEqual' WHEN 4 THEN 'notBetween' WHEN 5 THEN 'notEqual' ELSE '' END AS operator,
  CASE c_custkey % 6 WHEN 0 THEN '1|' || c_custkey WHEN 1 THEN c_custkey || '' WHEN 2 THEN 'IF($B' || (c_custkey + 1) || '>3,1,0)' WHEN 4 THEN 'SUM(A1:B2)|$C$1' WHEN 5 THEN '7' ELSE '' END AS formulas,
  CASE c_custkey % 6 WHEN 3 THEN 'a,b' END AS needle
FROM customer"""
)
def odf_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions of OpenDocument sheets as rules, their references in A1 style."""
    k = F.col("c_custkey")
    value = (
        F.when(k % 6 == 0, xml("between(1,", k, ")")).when(k % 6 == 1, xml("cell-content()&gt;=", k)).when(k % 6 == 2, xml("is-true-formula(IF([.$B", k + 1, "]&gt;3;1;0))"))
        .when(k % 6 == 3, F.lit("begins-with(&quot;a,b&quot;)")).when(k % 6 == 4, F.lit("cell-content-is-not-between(SUM([.A1:.B2]),[.$C$1])")).otherwise(F.lit("!=7"))
    )
    rule = xml('<calcext:conditional-format calcext:target-range-address="T.A', k + 1, ":T.B", k + 1, '"><calcext:condition calcext:value="', value, '"/></calcext:conditional-format>')
    books = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(listed(["c_custkey"], rule).alias("rules"))
    content = flat("spreadsheet", xml('<office:spreadsheet><table:table table:name="T"><calcext:conditional-formats>', F.col("rules"), "</calcext:conditional-formats></table:table></office:spreadsheet>"))
    rules = read_back(books, "c_nationkey", content, "fods", "cond_rules")
    return rules.select("c_nationkey", "r1", "kind", F.coalesce("operator", F.lit("")).alias("operator"), F.array_join("formulas", "|").alias("formulas"), F.col("text").alias("needle"))


# Binary workbooks --------------------------------------------------------------------------------

END, FAT_SECTOR, FREE = 0xFFFFFFFE, 0xFFFFFFFD, 0xFFFFFFFF


def compound(name: str, stream: bytes) -> bytes:
    """A compound file of one stream, in sectors of 512 bytes: FAT, directory, stream."""
    stream = stream.ljust(4096, b"\0")  # shorter ones would belong in the short stream
    sectors = -(-len(stream) // 512)
    tables = 1
    while tables * 128 < tables + 1 + sectors:
        tables += 1
    chain = [FAT_SECTOR] * tables + [END] + [tables + 2 + k for k in range(sectors - 1)] + [END]
    fat = struct.pack(f"<{len(chain)}I", *chain).ljust(tables * 512, b"\xff")

    def entry(title: str, kind: int, child: int, start: int, size: int) -> bytes:
        raw = title.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw) if title else 0, kind, 1, FREE, FREE, child) + bytes(36) + struct.pack("<IQ", start, size)

    directory = entry("Root Entry", 5, 1, END, 0) + entry(name, 2, FREE, tables + 1, len(stream)) + entry("", 0, FREE, 0, 0) * 2
    head = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6)
    head += struct.pack("<9I", 0, tables, tables, 0, 4096, END, 0, END, 0) + struct.pack(f"<{tables}I", *range(tables)).ljust(436, b"\xff")
    return head + fat + directory + stream.ljust(sectors * 512, b"\0")


def record(kind: int, body: bytes = b"") -> bytes:
    return struct.pack("<HH", kind, len(body)) + body


def biff(sheet: bytes) -> bytes:
    """A BIFF8 workbook of one sheet, from the sheet's records."""
    start = lambda kind: record(0x0809, struct.pack("<HHHHII", 0x0600, kind, 0, 0, 0, 0))
    bound = lambda at: record(0x0085, struct.pack("<IBBBB", at, 0, 0, 2, 0) + b"S1")
    at = len(start(5) + bound(0) + record(0x000A))
    return compound("Workbook", start(5) + bound(at) + record(0x000A) + start(0x10) + sheet + record(0x000A))


@pandas_udf(BinaryType())
def xls_lines(rows: pd.Series) -> pd.Series:
    """Workbooks of (r, quantity, price, text, flag): packed and full numbers, text, logicals; a rule for each ten rows."""

    def one(items) -> bytes:
        out = []
        for x in items:
            r = x["r"] - 1
            out.append(record(0x027E, struct.pack("<HHHI", r, 0, 0, (int(x["quantity"]) << 2) | 2)))
            out.append(record(0x0203, struct.pack("<HHHd", r, 1, 0, x["price"])))
            text = x["text"].encode("latin-1")
            out.append(record(0x0204, struct.pack("<HHHHB", r, 2, 0, len(text), 0) + text))
            out.append(record(0x0205, struct.pack("<HHHBB", r, 3, 0, int(x["flag"]), 0)))
            if x["r"] % 10 == 0:
                out.append(record(0x01B0, struct.pack("<HHHHHHHHHHH", 1, 0, r, r + 1, 0, 1, 1, r, r + 1, 0, 1)))
                if x["r"] % 20:
                    out.append(record(0x01B1, struct.pack("<BBHH", 1, 6, 3, 0) + bytes(6) + b"\x1e" + struct.pack("<H", x["r"])))
                else:  # a relative reference, a number, greater than
                    out.append(record(0x01B1, struct.pack("<BBHH", 2, 0, 9, 0) + bytes(6) + b"\x4c\0\0\0\xc0\x1e" + struct.pack("<H", x["r"]) + b"\x0d"))
        return biff(b"".join(out))

    return rows.map(one)


def xls_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    row = F.struct("r", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.concat("l_returnflag", "l_linestatus").alias("text"), (F.col("l_tax") > 0.04).alias("flag"))
    books = supplied(spark, sf_dir).groupBy("l_suppkey").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return read_back(books, "l_suppkey", xls_lines("rows"), "xls", name)


@query(
    SUPPLIED
    + """SELECT l_suppkey, r, 1 AS c, 'number' AS kind, l_quantity AS num, NULL AS txt, NULL AS flag FROM lines
UNION ALL SELECT l_suppkey, r, 2, 'number', l_extendedprice, NULL, NULL FROM lines
UNION ALL SELECT l_suppkey, r, 3, 'text', NULL, l_returnflag || l_linestatus, NULL FROM lines
UNION ALL SELECT l_suppkey, r, 4, 'bool', NULL, NULL, l_tax > 0.04 FROM lines"""
)
def xls_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of binary workbooks: packed and full numbers, texts, logicals."""
    return xls_view(spark, sf_dir, "cells").select("l_suppkey", "r", "c", "kind", "num", "txt", "flag")


@query(
    SUPPLIED
    + """SELECT l_suppkey, r AS r1, 1 AS c1, r + 1 AS r2, 2 AS c2, CASE WHEN r % 20 = 0 THEN 'expression' ELSE 'cellIs' END AS kind,
  CASE WHEN r % 20 = 0 THEN '' ELSE 'lessThan' END AS operator, CASE WHEN r % 20 = 0 THEN 'A' || r || '>' || r ELSE r || '' END AS formula FROM lines WHERE r % 10 = 0"""
)
def biff_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional formats of binary workbooks, their formulas decompiled."""
    return xls_view(spark, sf_dir, "cond_rules").select("l_suppkey", "r1", "c1", "r2", "c2", "kind", "operator", F.array_join("formulas", "|").alias("formula"))


# Texts and slides --------------------------------------------------------------------------------

def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with their text on one line."""
    line = F.trim(F.regexp_replace("text", r"[ \t\r\n]+", " "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", line.alias("line"))


LINES = r"WITH t AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) AS line FROM conversations)"


@query(
    LINES + """SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, role AS style_id, CASE WHEN turn % 2 = 1 THEN 'center' END AS align,
  CASE WHEN turn % 3 = 0 THEN 6.0 END AS before, line AS text FROM t"""
)
def docx_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of OOXML texts: style, alignment, spacing, and text without what is deleted or hidden."""
    turn = F.col("turn")
    props = xml('<w:pPr><w:pStyle w:val="', F.col("role"), '"/>', F.when(turn % 2 == 1, '<w:jc w:val="center"/>').otherwise(""), F.when(turn % 3 == 0, '<w:spacing w:before="120"/>').otherwise(""), "</w:pPr>")
    half = (F.length("line") / 2).cast("int")
    run = lambda text: xml('<w:r><w:t xml:space="preserve">', escaped(text), "</w:t></w:r>")
    gone = F.when(turn % 4 == 0, "<w:del><w:r><w:delText>gone</w:delText></w:r></w:del>").when(turn % 4 == 1, "<w:r><w:rPr><w:vanish/></w:rPr><w:t>unseen</w:t></w:r>").otherwise("")
    para = xml("<w:p>", props, run(F.substring("line", F.lit(1), half)), gone, run(F.substring("line", half + 1, F.length("line"))), "</w:p>")
    texts = talks(spark, sf_dir).groupBy("conv_id").agg(listed(["turn"], para).alias("body"))
    content = package({
        "_rels/.rels": relationships(("r1", "officeDocument", "word/document.xml")),
        "word/document.xml": xml('<w:document xmlns:w="w"><w:body>', F.col("body"), "</w:body></w:document>"),
    })
    return read_back(texts, "conv_id", content, "docx", "blocks").select("conv_id", F.col("path")[0].alias("pos"), "style_id", "align", "before", "text")


@query(
    """SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS r, c, span, vmerge, text FROM (
  SELECT o_custkey, o_orderkey, 0 AS c, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS span, CASE o_orderkey % 5 WHEN 1 THEN 'restart' WHEN 2 THEN 'continue' END AS vmerge, o_orderkey || '' AS text FROM orders)
UNION ALL SELECT o_custkey, r, c, 1, NULL, text FROM (
  SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS r, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS c, o_orderpriority || chr(10) || o_orderstatus AS text FROM orders)"""
)
def docx_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of tables in OOXML texts: spans, vertical merges, paragraphs of a cell."""
    k = F.col("o_orderkey")
    cell = lambda props, *texts: xml("<w:tc><w:tcPr>", props, "</w:tcPr>", *[xml("<w:p><w:r><w:t>", t, "</w:t></w:r></w:p>") for t in texts], "</w:tc>")
    span = F.when(k % 3 == 0, '<w:gridSpan w:val="2"/>').otherwise("")
    merge = F.when(k % 5 == 1, '<w:vMerge w:val="restart"/>').when(k % 5 == 2, "<w:vMerge/>").otherwise("")
    row = xml("<w:tr>", cell(F.concat(span, merge), k), cell(F.lit(""), escaped(F.col("o_orderpriority")), F.col("o_orderstatus")), "</w:tr>")
    texts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(listed(["o_orderkey"], row).alias("body"))
    content = package({
        "_rels/.rels": relationships(("r1", "officeDocument", "word/document.xml")),
        "word/document.xml": xml('<w:document xmlns:w="w"><w:body><w:tbl>', F.col("body"), "</w:tbl></w:body></w:document>"),
    })
    return read_back(texts, "o_custkey", content, "docx", "table_cells").select("o_custkey", "r", "c", "span", "vmerge", "text")


@query(LINES + "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS slide, 'slide:' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS story, line AS text FROM t WHERE turn % 3 <> 2")
def pptx_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides that are shown, and their texts without hidden shapes."""
    turn = F.col("turn")
    shape = lambda k, text, mark="": xml(f'<p:sp><p:nvSpPr><p:cNvPr id="{k}" name="s"{mark}/></p:nvSpPr><p:txBody><a:p><a:r><a:t>', text, "</a:t></a:r></a:p></p:txBody></p:sp>")
    slide = xml('<p:sld xmlns:p="p" xmlns:a="a"', F.when(turn % 3 == 2, ' show="0"').otherwise(""), "><p:cSld><p:spTree>", shape(1, escaped(F.col("line"))), shape(2, F.lit("no"), ' hidden="1"'), "</p:spTree></p:cSld></p:sld>")
    part = F.struct("turn", slide.alias("xml"))
    decks = talks(spark, sf_dir).groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("slides"))
    each = lambda use: F.array_join(F.transform("slides", use), "")
    fixed = F.array(
        F.lit("_rels/.rels"), relationships(("r1", "officeDocument", "ppt/presentation.xml")),
        F.lit("ppt/presentation.xml"), xml(f'<p:presentation xmlns:p="p" xmlns:r="{OFFICE_RELS}"><p:sldIdLst>', each(lambda s: xml('<p:sldId id="1" r:id="s', s["turn"], '"/>')), "</p:sldIdLst></p:presentation>"),
        F.lit("ppt/_rels/presentation.xml.rels"), relationships(each(lambda s: xml('<Relationship Id="s', s["turn"], f'" Type="{OFFICE_RELS}/slide" Target="slides/s', s["turn"], '.xml"/>'))),
    )
    parts = F.concat(fixed, F.flatten(F.transform("slides", lambda s: F.array(xml("ppt/slides/s", s["turn"], ".xml"), s["xml"]))))
    blocks = read_back(decks, "conv_id", zipped(parts), "pptx", "blocks")
    return blocks.select("conv_id", F.col("section_idx").alias("slide"), "story", "text")


@query(
    LINES + """SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, CASE WHEN turn = 0 THEN 2 END AS outline, CASE WHEN turn > 0 AND role = 'user' THEN 0 END AS list_level, line || CASE WHEN turn > 0 THEN '   x' ELSE '' END AS text FROM t"""
)
def fodt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of flat OpenDocument texts: headings, list items, collapsed and counted white space."""
    line = escaped(F.col("line"))
    spaced = xml("  ", F.replace(line, F.lit(" "), F.lit("\n  ")), '<text:s text:c="3"/>x ')
    para = xml('<text:p text:style-name="P">', spaced, "</text:p>")
    block = F.when(F.col("turn") == 0, xml('<text:h text:outline-level="3">', line, "</text:h>")).when(F.col("role") == "user", xml("<text:list><text:list-item>", para, "</text:list-item></text:list>")).otherwise(para)
    texts = talks(spark, sf_dir).groupBy("conv_id").agg(listed(["turn"], block).alias("body"))
    blocks = read_back(texts, "conv_id", flat("text", xml("<office:text>", F.col("body"), "</office:text>")), "fodt", "blocks")
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("path")) - 1
    return blocks.select("conv_id", pos.alias("pos"), "outline", "list_level", "text")


@query(
    """WITH p AS (SELECT *, regexp_extract(p_brand, '\\d+') AS n, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part)
SELECT CAST(n AS BIGINT) AS brand, 'heading2' AS style_id, CAST(NULL AS INTEGER) AS list_level, 'Parts of ' || n AS text, 0 AS pos FROM (SELECT DISTINCT n FROM p)
UNION ALL SELECT CAST(n AS BIGINT), 'text', 0, p_name || ' ' || p_type || ' of size ' || p_size, CAST(k AS INTEGER) FROM p"""
)
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings and list items of Markdown texts, their marks resolved."""
    item = xml("- ", F.col("p_name"), " **", F.col("p_type"), "** of `size` ", F.col("p_size"), "\n")
    texts = table(spark, sf_dir, "part").withColumn("brand", F.regexp_extract("p_brand", r"\d+", 0).cast("long")).groupBy("brand").agg(listed(["p_partkey"], item).alias("items"))
    content = F.encode(xml("## Parts of ", F.col("brand"), "\n\n", F.col("items")), "UTF-8")
    blocks = read_back(texts, "brand", content, "md", "blocks")
    pos = F.row_number().over(Window.partitionBy("brand").orderBy("path")) - 1
    return blocks.select("brand", "style_id", "list_level", "text", pos.alias("pos"))


@query(
    """SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN 'fods' WHEN 1 THEN 'fodt' WHEN 2 THEN 'docx' WHEN 3 THEN 'md' WHEN 4 THEN 'xls' ELSE 'csv' END AS format,
  CASE WHEN n_nationkey % 6 = 5 THEN 1 ELSE 0 END AS status, CASE n_nationkey % 6 WHEN 0 THEN 1 WHEN 4 THEN 1 ELSE 0 END AS n_cells, CASE n_nationkey % 6 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 0 END AS n_blocks FROM nation"""
)
def dispatch_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose names say another format of their family: the content decides; what cannot be read is an error row."""
    one = pandas_udf(lambda s: pd.Series([biff(record(0x0203, struct.pack("<HHHd", 0, 0, 0, 1.5)))] * len(s)), "binary")
    name, kind = F.col("n_name"), F.col("n_nationkey") % 6
    docx = package({"_rels/.rels": relationships(("r1", "officeDocument", "word/document.xml")), "word/document.xml": xml('<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>', name, "</w:t></w:r></w:p></w:body></w:document>")})
    cell = xml('<office:spreadsheet><table:table><table:table-row><table:table-cell office:value-type="string"><text:p>', name, "</text:p></table:table-cell></table:table-row></table:table></office:spreadsheet>")
    content = (
        F.when(kind == 0, flat("spreadsheet", cell)).when(kind == 1, flat("text", xml("<office:text><text:p>", name, "</text:p></office:text>")))
        .when(kind == 2, docx).when(kind == 3, F.encode(name, "UTF-8")).when(kind == 4, one(name)).otherwise(F.encode(F.lit("1,2"), "UTF-8"))
    )
    extension = F.element_at(F.array(*map(F.lit, ("ODS", "odt", "doc", "markdown", "xlsx", "csv"))), kind + 1)
    parsed = parse_files(table(spark, sf_dir, "nation").select(F.concat_ws(".", F.col("n_nationkey").cast("string"), extension).alias("path"), content.alias("content")), tables=("cells", "blocks"))
    return parsed.select(F.regexp_extract("doc_id", r"^\d+", 0).cast("int").alias("n_nationkey"), "format", "status", F.size("cells").alias("n_cells"), F.size("blocks").alias("n_blocks"))


@query(
    """SELECT CAST(p_partkey % 50 AS BIGINT) AS deck, CAST(row_number() OVER (PARTITION BY p_partkey % 50 ORDER BY p_partkey) - 1 AS INTEGER) AS idx, p_name AS name, 'pic' AS kind, 10.0 + p_size * 2.0 AS x, 20.0 + p_size * 1.0 AS y, 8.0 AS width, 4.0 AS height, 'ppt/media/image1.png' AS part FROM part"""
)
def pptx_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures on slides in points, through the group around them, with the part that they show."""
    emu = lambda c: (c * 12700).cast("long")
    frame = lambda tag, x, y, w, h: f'<a:{tag}off x="{x}" y="{y}"/><a:{tag}ext cx="{w}" cy="{h}"/>'.replace(":chext", ":chExt").replace(":choff", ":chOff")
    size = F.col("p_size")
    pic = xml('<p:pic><p:nvPicPr><p:cNvPr id="2" name="', escaped(F.col("p_name")), '"/></p:nvPicPr><p:blipFill><a:blip r:embed="i1"/></p:blipFill><p:spPr><a:xfrm><a:off x="', emu(size), '" y="', emu(size), '"/><a:ext cx="50800" cy="50800"/></a:xfrm></p:spPr></p:pic>')
    decks = table(spark, sf_dir, "part").withColumn("deck", F.col("p_partkey") % 50).groupBy("deck").agg(listed(["p_partkey"], pic).alias("pics"))
    group = "<p:grpSp><p:nvGrpSpPr/><p:grpSpPr><a:xfrm>" + frame("", 127000, 254000, 2540000, 1270000) + frame("ch", 0, 0, 1270000, 1270000) + "</a:xfrm></p:grpSpPr>"
    content = package({
        "_rels/.rels": relationships(("r1", "officeDocument", "ppt/presentation.xml")),
        "ppt/presentation.xml": F.lit(f'<p:presentation xmlns:p="p" xmlns:r="{OFFICE_RELS}"><p:sldIdLst><p:sldId id="1" r:id="s1"/></p:sldIdLst></p:presentation>'),
        "ppt/_rels/presentation.xml.rels": relationships(("s1", "slide", "slides/s1.xml")),
        "ppt/slides/s1.xml": xml(f'<p:sld xmlns:p="p" xmlns:a="a" xmlns:r="{OFFICE_RELS}"><p:cSld><p:spTree>{group}', F.col("pics"), "</p:grpSp></p:spTree></p:cSld></p:sld>"),
        "ppt/slides/_rels/s1.xml.rels": relationships(("i1", "image", "../media/image1.png")),
    })
    shapes = read_back(decks, "deck", content, "pptx", "drawings")
    return shapes.select("deck", "idx", "name", "kind", "x", "y", "width", "height", "part")


@query(
    """SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, 'Pictures/' || n_nationkey || '.gif' AS part, 'gif' AS format, CAST(3 + length(n_name) AS BIGINT) AS size, n_name AS label FROM nation WHERE n_nationkey % 4 <> 3"""
)
def odt_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media parts of OpenDocument packages with their bytes; parts that are no image are left out."""
    k = F.col("n_nationkey").cast("string")
    part = F.struct("n_nationkey", xml("Pictures/", k, ".gif").alias("name"), F.when(F.col("n_nationkey") % 4 == 3, F.col("n_name")).otherwise(xml("GIF", F.col("n_name"))).alias("text"))
    texts = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    content = f"<office:document-content {ODF}><office:body><office:text><text:p>x</text:p></office:text></office:body></office:document-content>"
    fixed = F.array(F.lit("mimetype"), F.lit("application/vnd.oasis.opendocument.text"), F.lit("content.xml"), F.lit(content))
    parts = F.concat(fixed, F.flatten(F.transform("parts", lambda p: F.array(p["name"], p["text"]))))
    media = read_back(texts, "n_regionkey", zipped(parts), "odt", "media")
    return media.select("n_regionkey", "part", "format", "size", F.substring(F.decode("data", "UTF-8"), 4, 1000).alias("label"))


@query(
    SUPPLIED + """SELECT l_suppkey, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY r) - 1 AS INTEGER) AS idx, CAST(r AS INTEGER) AS from_r, CAST(l_linenumber AS INTEGER) AS from_c, l_quantity AS x, 2.0 AS width, CASE WHEN l_linenumber % 2 = 0 THEN CAST(r + 1 AS INTEGER) END AS to_r, 'line ' || l_linenumber AS text FROM lines WHERE r % 10 = 1"""
)
def xlsx_drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of sheet drawings: the cell they start in, offset, size or the cell they end in, text."""
    r, c = F.col("r"), F.col("l_linenumber")
    corner = lambda tag, row, col, off: xml(f"<x:{tag}><x:col>", col, "</x:col><x:colOff>", off, "</x:colOff><x:row>", row, f"</x:row><x:rowOff>0</x:rowOff></x:{tag}>")
    ends = F.when(c % 2 == 0, corner("to", r, c, F.lit(0))).otherwise('<x:ext cx="25400" cy="25400"/>')
    anchor = xml("<x:oneCellAnchor>", corner("from", r - 1, c - 1, (F.col("l_quantity") * 12700).cast("long")), ends, "<x:sp><x:txBody><a:p><a:r><a:t>line ", c, "</a:t></a:r></a:p></x:txBody></x:sp></x:oneCellAnchor>")
    books = supplied(spark, sf_dir).where("r % 10 = 1").groupBy("l_suppkey").agg(listed(["r"], anchor).alias("anchors"))
    content = package({
        "_rels/.rels": relationships(("r1", "officeDocument", "xl/workbook.xml")),
        "xl/workbook.xml": F.lit(f'<workbook xmlns="s" xmlns:r="{OFFICE_RELS}"><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>'),
        "xl/_rels/workbook.xml.rels": relationships(("r1", "worksheet", "worksheets/sheet1.xml")),
        "xl/worksheets/sheet1.xml": F.lit('<worksheet xmlns="s"><sheetData/></worksheet>'),
        "xl/worksheets/_rels/sheet1.xml.rels": relationships(("d1", "drawing", "../drawings/drawing1.xml")),
        "xl/drawings/drawing1.xml": xml('<x:wsDr xmlns:x="x" xmlns:a="a">', F.col("anchors"), "</x:wsDr>"),
    })
    drawn = read_back(books, "l_suppkey", content, "xlsx", "drawings")
    return drawn.select("l_suppkey", "idx", "from_r", "from_c", "x", F.coalesce("width", F.lit(2.0)).alias("width"), "to_r", "text")


@query(
    """SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '&L' || s_name || ' && co&R&P of &N' WHEN 1 THEN '&C&A  x' END AS header FROM supplier"""
)
def ods_header_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of OpenDocument sheets as codes: regions, fields, counted spaces; one that is off has none."""
    k = F.col("s_suppkey") % 3
    inner = (
        F.when(k == 0, xml("<style:region-left><text:p>", escaped(F.col("s_name")), " &amp; co</text:p></style:region-left><style:region-right><text:p><text:page-number>1</text:page-number> of <text:page-count/></text:p></style:region-right>"))
        .when(k == 1, '<text:p><text:sheet-name>S</text:sheet-name><text:span><text:s text:c="2"/>x</text:span></text:p>').otherwise("<text:p>off</text:p>")
    )
    header = xml("<style:header", F.when(k == 2, ' style:display="false"').otherwise(""), ">", inner, "</style:header>")
    body = F.lit("<office:spreadsheet><table:table/></office:spreadsheet>")
    content = F.encode(xml(f'<?xml version="1.0"?><office:document {ODF} office:mimetype="application/vnd.oasis.opendocument.spreadsheet"><office:master-styles><style:master-page style:name="Default">', header, "</style:master-page></office:master-styles><office:body>", body, "</office:body></office:document>"), "UTF-8")
    return read_back(table(spark, sf_dir, "supplier"), "s_suppkey", content, "fods", "page_options").select("s_suppkey", "header")
