import builders as B
import pytest
from pyspark.sql import functions as F

from quire.sources import containers, read, sniff, spreadsheets


@pytest.fixture(scope="module")
def parsed(spark):
    files = {
        "a.xlsx": B.xlsx(), "b.docx": B.docx(), "c.pptx": B.pptx(), "d.fods": B.fods(), "e.fodt": B.fodt(), "f.fodp": B.fodp(), "g.xls": B.xls(), "h.doc": B.doc(), "i.md": B.MARKDOWN.encode(),
        "j.ods": B.chart_ods(), "wrong.odt": B.fodt(), "moved.doc": B.docx(),
        "bad.docx": b"PK\3\4garbage", "none.pptx": B.pptx(False), "old.xls": B.xls(0x0500), "locked.xls": B.xls(extra=B.record(0x002F, b"\0\0")), "book.xls": B.xls(name="Book"), "locked.doc": B.doc(0x0100), "x.csv": b"1,2", "cut.fods": B.fods()[:300],
    }
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")
    return read.parse_files(df.repartition(3)).cache()


def rows(parsed, doc, table, *columns):
    return [tuple(r) for r in read.view(parsed.where(F.col("doc_id") == doc), table).select(*columns).collect()]


def test_status(parsed):
    got = {r.doc_id: (r.format, r.status) for r in parsed.select("doc_id", "format", "status").collect()}
    assert {k: v[0] for k, v in got.items() if not v[1]} == {
        "a.xlsx": "xlsx", "b.docx": "docx", "c.pptx": "pptx", "d.fods": "fods", "e.fodt": "fodt", "f.fodp": "fodp", "g.xls": "xls", "h.doc": "doc", "i.md": "md", "j.ods": "ods", "wrong.odt": "fodt", "moved.doc": "docx",
    }
    errors = {r.doc_id: r.error for r in parsed.where("status = 1").collect()}
    assert len(errors) == 8 and "no slide" in errors["none.pptx"] and "password" in errors["locked.xls"] and "password" in errors["locked.doc"] and "older" in errors["book.xls"] and "unsupported" in errors["x.csv"]


def test_xlsx(parsed):
    assert rows(parsed, "a.xlsx", "sheets", "name", "state", "r1", "c1", "r2", "c2") == [("One", "visible", 1, 1, 6, 4), ("Two", "hidden", None, None, None, None)]
    assert rows(parsed, "a.xlsx", "cells", "r", "c", "kind", "num", "txt", "flag", "xf") == [
        (1, 1, "text", None, "shared", None, 0), (1, 2, "number", 1234.5, None, None, 1), (1, 3, "bool", None, None, True, 0), (1, 4, "error", None, "#N/A", None, 0),
        (3, 1, "text", None, "inline", None, 0), (3, 2, "text", None, "text", None, 0), (3, 3, "empty", None, None, None, 0), (3, 4, "empty", None, None, None, 0),
    ]
    assert rows(parsed, "a.xlsx", "xfs", "num_fmt", "align", "wrap") == [("General", None, False), ('0.0"x"', "right", True)]
    assert [r[:9] for r in rows(parsed, "a.xlsx", "cond_rules", "r1", "c1", "r2", "c2", "origin_r", "origin_c", "priority", "kind", "operator")] == [(1, 2, 9, 2, 1, 2, 2, "cellIs", "greaterThan"), (1, 4, 9, 4, 1, 2, 2, "cellIs", "greaterThan")]
    assert rows(parsed, "a.xlsx", "page_options", "paper", "landscape", "scale", "over_then_down", "left", "top", "right", "header", "print_area") == [(9, True, 0.8, True, 72.0, 36.0, 0.7 * 72, "&LTop", "One!$A$1:$D$9")]
    assert rows(parsed, "a.xlsx", "breaks", "axis", "after") == [("row", 4)]
    assert rows(parsed, "a.xlsx", "comments", "r", "c", "author", "text") == [(1, 2, "Ann", "note")]
    assert rows(parsed, "a.xlsx", "sheet_rows", "r", "height", "hidden") == [(1, 30.0, False), (3, None, True)]


def test_docx(parsed):
    texts = rows(parsed, "b.docx", "blocks", "story", "kind", "text", "section_idx")
    assert texts[:3] == [("body", "paragraph", "Heading", 0), ("body", "paragraph", "Page ", 0), ("body", "table", None, 1)]
    assert ("footnote:2", "paragraph", "Foot", 2) in texts
    assert rows(parsed, "b.docx", "table_cells", "r", "c", "span", "vmerge", "text") == [(0, 0, 2, "restart", "a"), (0, 2, 1, None, "b"), (1, 0, 1, "continue", "")]
    assert rows(parsed, "b.docx", "sections", "width", "left", "columns", "header") == [(612.0, 72.0, 1, "Top"), (612.0, 36.0, 2, "Top")]
    assert ("field", "PAGE") in rows(parsed, "b.docx", "inlines", "kind", "text")
    assert rows(parsed, "b.docx", "list_instances", "num_id", "abstract_id", "overrides") == [("3", "5", {0: 4})]
    assert rows(parsed, "b.docx", "media", "format") == [("png",)]


def test_slides(parsed):
    assert rows(parsed, "c.pptx", "sections", "width", "height") == [(720.0, 405.0)]
    assert rows(parsed, "c.pptx", "blocks", "kind", "text") == [("paragraph", "master"), ("paragraph", "layout"), ("paragraph", "First"), ("table", None)]
    assert rows(parsed, "c.pptx", "inlines", "bold", "size")[-1] == (True, 18.0)
    assert rows(parsed, "f.fodp", "blocks", "section_idx", "text") == [(0, "eins"), (1, "zwei")]


def test_opendocument(parsed):
    for doc in ("d.fods", "j.ods"):
        assert rows(parsed, doc, "cells", "r", "c", "kind", "num", "txt")[:5] == [(1, 1, "shown", 2.5, "2,50"), (1, 2, "text", None, "s"), (1, 3, "text", None, "s"), (1, 4, "shown", 1.0, "TRUE"), (1, 5, "shown", 0.0, "1 May")]
        assert rows(parsed, doc, "sheets", "r2", "c2") == [(2, 5)]
        assert rows(parsed, doc, "cond_rules", "r1", "c2", "kind", "operator", "formulas") == [(1, 2, "cellIs", "between", ["1", "$C$1"])]
    assert rows(parsed, "e.fodt", "blocks", "outline", "list_level", "section_idx", "text") == [(1, None, 0, "Ti tle"), (None, None, 0, "a   b\t c d"), (None, 0, 0, "one"), (None, 1, 0, "deep"), (None, None, 1, "next")]


def test_opendocument_values_fill_their_whole_repeat():
    cell = lambda n, value="": f'<table:table-cell table:number-columns-repeated="{n}" {value}/>'
    number = 'office:value-type="float" office:value="2"'
    book = lambda row: f'<office:document {B.OFFICE}><office:body><office:spreadsheet><table:table><table:table-row table:number-rows-repeated="2">{row}</table:table-row></table:table></office:spreadsheet></office:body></office:document>'.encode()
    got = spreadsheets.read_ods(book(cell(300, number) + cell(500) + cell(1, number))).rows
    assert [(x["r"], x["c"], x["num"]) for x in got["cells"]] == [(r, c, 2.0) for r in (1, 2) for c in [*range(1, 301), 801]]
    # The used range counts 256 columns of a repeat; no cell lies beyond the last column.
    got = spreadsheets.read_ods(book(cell(16_000) + cell(16_384, number))).rows
    assert [x["c"] for x in got["cells"] if x["r"] == 1] == list(range(16_001, 16_385)) and got["sheets"][0]["c2"] == 16_256


def test_opendocument_chart(parsed):
    assert rows(parsed, "j.ods", "charts", "kind", "title") == [("bar", "Sales")]
    assert rows(parsed, "j.ods", "chart_points", "series_name", "pos", "category", "value") == [("North", 1, "Q1", 5.0), ("North", 2, "2.5", 7.0), ("North", 3, "3", None), (None, 1, "Q1", 8.0), (None, 2, "2.5", 9.0), (None, 3, "3", None)]


def test_binary(parsed):
    assert rows(parsed, "g.xls", "cells", "r", "c", "kind", "num", "txt", "flag") == [
        (1, 1, "number", 1.5, None, None), (1, 2, "number", 12.34, None, None), (2, 1, "number", 7.0, None, None), (2, 2, "number", -7.0, None, None),
        (3, 1, "text", None, "käsekäsekäse", None), (3, 2, "bool", None, None, True), (3, 3, "number", 1.0, None, None), (3, 4, "text", None, "made", None),
    ]
    assert rows(parsed, "g.xls", "merges", "r1", "c1", "r2", "c2") == [(5, 1, 6, 2)]
    assert rows(parsed, "g.xls", "cond_rules", "r1", "c1", "r2", "c2", "kind", "operator", "formulas") == [(1, 1, 9, 1, "cellIs", "greaterThan", ["10"]), (1, 1, 9, 1, "expression", "", ["A1>5"])]
    assert rows(parsed, "h.doc", "blocks", "kind", "style_id", "align", "before", "text") == [
        ("paragraph", "1", None, None, "First bold"), ("paragraph", "2", "center", 6.0, "Second"), ("table", None, None, None, None),
        ("paragraph", "0", None, None, "cell one"), ("paragraph", "0", None, None, "cell two"), ("paragraph", "0", None, None, "7 end"),
    ]
    assert rows(parsed, "h.doc", "inlines", "text", "bold", "size")[:2] == [("First ", None, None), ("bold", True, 12.0)]
    assert rows(parsed, "h.doc", "table_cells", "r", "c", "text") == [(0, 0, "cell one"), (0, 1, "cell two")]


def test_markdown(parsed):
    got = rows(parsed, "i.md", "blocks", "style_id", "list_level", "text")
    assert got == [
        ("heading1", None, "Title with marks"), ("heading1", None, "Setext"), ("text", None, "Some bold both text, code, gone and a link.\nSecond line."),
        ("text", 0, "three"), ("text", 0, "four"), ("text", 1, "inner"), ("text", 1, "☑ done"), ("quote", None, "quoted\ntext"), ("code", None, "code  block"), ("code", None, "indented"), (None, None, None), ("html", None, "html block"), ("rule", None, ""),
    ]
    assert rows(parsed, "i.md", "table_cells", "r", "c", "text") == [(0, 0, "a"), (0, 1, "b"), (1, 0, "1"), (1, 1, "2 | 3")]
    assert ("both", True, True) in rows(parsed, "i.md", "inlines", "text", "bold", "italic")
    assert rows(parsed, "i.md", "list_levels", "level", "start", "format") == [(0, 3, "decimal"), (1, 1, "bullet")]


def test_source_text(parsed):
    got = {r.doc_id: r.text for r in read.source_text(parsed.where("status = 0")).collect()}
    assert got["a.xlsx"].split("\n")[:3] == ["shared", "1234.5", "true"] and "Heading" in got["b.docx"]


def test_compound_streams():
    big, small = b"x" * 5000, b"short"
    for cutoff in (0, 4096):
        files = containers.Compound(B.compound({"A": big, "B": small}, cutoff))
        assert files.stream("A") == big and files.stream("B") == small and files.stream("C") is None


def test_sniff(spark):
    heads = {
        "xlsx": B.xlsx(), "docx": B.docx(), "pptx": B.pptx(), "fods": B.fods(), "xls": B.xls(), "doc": B.doc(), None: b"text",
        "odt": B.package({"mimetype": "application/vnd.oasis.opendocument.text"}).replace(b"\x08\x00", b"\x00\x00") + b"application/vnd.oasis.opendocument.text",
    }
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in heads.items()], "want string, content binary")
    assert all(r.want == r.got for r in df.select("want", sniff.detect_format(F.col("content")).alias("got")).collect())
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452000000100000000A") + b"rest"
    one = spark.createDataFrame([(bytearray(png),)], "c binary")
    assert one.select(sniff.image_format(F.col("c")), sniff.png_size(F.col("c"))).first()[:] == ("png", (16, 10))
    text = spark.createDataFrame([("aGV sbG8=junk",), ("=",), ("data:image/png;base64,aGk",), ("data:text,aGk",)], "t string")
    got = text.select(sniff.base64_bytes(F.col("t")).alias("a"), sniff.data_uri(F.col("t")).alias("b")).collect()
    assert bytes(got[0].a) == b"hello" and got[1].a is None and bytes(got[2].b) == b"hi" and got[3].b is None
    assert sniff.formats(spark).count() == 24


def test_files_on_disk(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.md").write_text("# One")
    (tmp_path / "in" / "deep" / "b.xlsx").write_bytes(B.xlsx())
    assert sorted(r.format for r in read.read_documents(spark, f"{tmp_path}/in").collect()) == ["md", "xlsx"]
    from quire.streaming import ingest

    q = ingest.write_available(ingest.stream_documents(spark, f"{tmp_path}/in").select("doc_id", "format", "status"), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_docx_drawings_lines_and_hidden_cells():
    from quire.sources import texts

    body = """<w:body><w:p><w:r><w:drawing><wp:anchor><wp:positionH><wp:posOffset>127000</wp:posOffset></wp:positionH><wp:extent cx="254000" cy="127000"/><wp:docPr name="pic"/><a:blip r:embed="i"/></wp:anchor></w:drawing></w:r>
      <w:r><w:pict><v:shape id="s" style="width: 36pt;height:1in; margin-left:4px"><v:imagedata r:id="i"/></v:shape></w:pict></w:r></w:p>
      <w:tbl><w:tblPr><w:tblBorders><w:top w:val="single"/><w:insideV w:val="nil"/></w:tblBorders></w:tblPr><w:tr><w:tc><w:tcPr><w:tcBorders><w:start w:val="double"/><w:bottom w:val="none"/></w:tcBorders></w:tcPr>
      <w:p><w:pPr><w:rPr><w:vanish/></w:rPr></w:pPr><w:r><w:rPr><w:vanish/></w:rPr><w:t>unseen</w:t></w:r></w:p><w:p><w:pPr><w:rPr><w:vanish/></w:rPr></w:pPr><w:r><w:t>seen</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body>"""
    pack = B.package({
        "_rels/.rels": B.rels(r1=("officeDocument", "word/document.xml", "")), "word/_rels/document.xml.rels": B.rels(i=("image", "media/a.png", "")),
        "word/document.xml": f'<w:document {B.W} xmlns:wp="wp" xmlns:a="a" xmlns:v="v">{body}</w:document>',
    })
    got = texts.read_docx(pack).rows
    assert [(d["kind"], d["name"], d["x"], d["y"], d["width"], d["height"], d["part"]) for d in got["drawings"]] == [("anchor", "pic", 10.0, None, 20.0, 10.0, "word/media/a.png"), ("vml", "s", 3.0, None, 36.0, 72.0, "word/media/a.png")]
    assert [(t["top"], t["inside_v"], t["left"]) for t in got["table_lines"]] == [("single", "none", None)]
    cell = got["table_cells"][0]
    assert (cell["left"], cell["bottom"], cell["top"], cell["text"]) == ("double", "none", None, "seen")
    assert [b["text"] for b in got["blocks"] if b["kind"] == "paragraph"] == ["", "seen"] and all(x["text"] != "unseen" for x in got["inlines"])


def test_sinks(parsed, spark, tmp_path):
    from quire.sources import sinks

    sinks.write_views(parsed, f"{tmp_path}/views", ["cells", "media"])
    assert spark.read.parquet(f"{tmp_path}/views/cells").count() == read.view(parsed, "cells").count()
    assert spark.read.parquet(f"{tmp_path}/views/documents").count() == parsed.count()
    sinks.write_report(parsed.select("doc_id", "error"), f"{tmp_path}/report")
    assert {"doc_id", "error"} == set(spark.read.json(f"{tmp_path}/report").columns)
    with pytest.raises(ValueError, match="nosuch"):
        sinks.write_views(parsed, f"{tmp_path}/x", ["nosuch"])
