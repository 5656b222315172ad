"""Fonts, fills, borders and differential formats of the three sheet formats, without Spark."""

import struct

import builders as B
import pytest

from quire.sources import sheet_styles, spreadsheets
from quire.sources.parsed import Parsed
from quire.sources.xmltree import parse

STYLES = """<styleSheet xmlns="s"><numFmts><numFmt numFmtId="164" formatCode="0.0"/></numFmts>
  <fonts><font><sz val="10"/><name val="Arial"/></font><font><b/><i val="0"/><u/><strike/><sz val="14"/><color theme="4" tint="0.5"/></font></fonts>
  <fills><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FFFF0000"/></patternFill></fill><fill><patternFill patternType="gray125"><fgColor indexed="8"/></patternFill></fill></fills>
  <borders><border/><border><left style="thin"><color indexed="10"/></left><top style="none"/><bottom style="double"/></border></borders>
  <cellXfs><xf/><xf numFmtId="164" fontId="1" fillId="1" borderId="1"><alignment horizontal="centerContinuous" vertical="distributed" wrapText="1" indent="2"/></xf><xf fontId="99" fillId="2"/></cellXfs>
  <dxfs><dxf><font><b/><color rgb="00FF00"/></font><fill><patternFill><bgColor theme="1"/></patternFill></fill></dxf><dxf><numFmt formatCode="0%"/></dxf></dxfs></styleSheet>"""
THEME = '<a:theme xmlns:a="a"><a:themeElements><a:clrScheme><a:dk1><a:sysClr val="windowText" lastClr="111111"/></a:dk1><a:accent1><a:srgbClr val="000080"/></a:accent1></a:clrScheme></a:themeElements></a:theme>'


def test_xlsx_styles():
    out = Parsed()
    formatted = sheet_styles.read_xlsx_styles(parse(STYLES.encode()), parse(THEME.encode()), out)
    plain, rich, gray = out.rows["xfs"]
    assert formatted == [False, True, True]
    assert (plain["font"], plain["size"], plain["bold"], plain["color"], plain["fill"], plain["valign"], plain["borders"]) == ("Arial", 10.0, None, "#000000", None, "bottom", [])
    assert (rich["bold"], rich["italic"], rich["underline"], rich["strike"], rich["size"], rich["font"]) == (True, False, True, True, 14.0, "Calibri")
    assert (rich["num_fmt"], rich["align"], rich["valign"], rich["wrap"], rich["indent"], rich["fill"]) == ("0.0", "center", "center", True, 18.0, "#ff0000")
    assert rich["color"] == "#4040ff"  # lightness 0.25 to 0.625
    assert rich["borders"] == [{"side": "bottom", "style": "double", "color": None}, {"side": "left", "style": "thin", "color": "#ff0000"}]
    assert gray["fill"] == "#808080" and gray["size"] == 14.0  # half way to white; fonts beyond the last are the last
    first, second = out.rows["dxfs"]
    assert (first["bold"], first["color"], first["fill"], first["size"], first["num_fmt"]) == (True, "#00ff00", "#111111", None, None)
    assert (second["num_fmt"], second["fill"], second["bold"]) == ("0%", None, None)
    assert sheet_styles.read_xlsx_styles(None, None, Parsed()) == []


@pytest.mark.parametrize(("colour", "amount", "want"), [("#000000", 0.5, "#808080"), ("#ffffff", -0.25, "#bfbfbf"), ("#800000", 0.0, "#800000"), (None, 0.5, None), ("#ff0000", 1.0, "#ffffff")])
def test_tints(colour, amount, want):
    assert sheet_styles.tinted(colour, amount) == want


def test_used_range_counts_styled_cells():
    sheet = '<worksheet xmlns="s"><sheetData><row r="1"><c r="B1"><v>1</v></c><c r="C1" s="2"/></row><row r="7"><c r="A7" s="1"/><c r="H7" s="0"/></row></sheetData></worksheet>'
    book = B.package({
        "_rels/.rels": B.rels(r1=("officeDocument", "xl/workbook.xml", "")),
        "xl/workbook.xml": f'<workbook xmlns="s" xmlns:r="{B.REL}"><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": B.rels(r1=("worksheet", "worksheets/sheet1.xml", ""), r4=("styles", "styles.xml", ""), r5=("theme", "theme/theme1.xml", "")),
        "xl/worksheets/sheet1.xml": sheet, "xl/styles.xml": STYLES, "xl/theme/theme1.xml": THEME,
    })
    got = spreadsheets.read_xlsx(book).rows
    assert [got["sheets"][0][n] for n in ("r1", "c1", "r2", "c2")] == [1, 1, 7, 3]
    assert len(got["dxfs"]) == 2


def test_binary_styles():
    styles = sheet_styles.BiffStyles()
    name = lambda t: struct.pack("<BB", len(t), 0) + t.encode("latin-1")
    for k in range(5):  # there is no font 4, so number 5 is the fifth
        styles.take(0x0031, struct.pack("<HHHHHBBBB", 200 + 20 * k, 0x0A if k == 4 else 0, 8, 700 if k == 4 else 400, 0, k == 4, 0, 0, 0) + name(f"F{k}"))
    styles.take(0x0092, struct.pack("<H", 2) + bytes([1, 2, 3, 0, 4, 5, 6, 0]))
    sides = 1 | 6 << 12 | 9 << 16  # left thin in colour 9, bottom double
    styles.take(0x00E0, struct.pack("<HHHBBHIIH", 5, 2, 0, 2 | 8 | 1 << 4, 0, 3, sides, 1 << 26, 9 | 64 << 7))
    styles.take(0x00E0, struct.pack("<HHH", 0, 9, 0))
    out = Parsed()
    assert styles.fill(out, {2: "0.00", 9: "0%"}) == [True, False]
    rich, plain = out.rows["xfs"]
    assert (rich["font"], rich["size"], rich["bold"], rich["italic"], rich["strike"], rich["underline"], rich["color"]) == ("F4", 14.0, True, True, True, True, "#010203")
    assert (rich["num_fmt"], rich["align"], rich["valign"], rich["wrap"], rich["indent"], rich["fill"]) == ("0.00", "center", "center", True, 27.0, "#040506")
    assert rich["borders"] == [{"side": "bottom", "style": "double", "color": "#000000"}, {"side": "left", "style": "thin", "color": "#040506"}]
    assert (plain["font"], plain["num_fmt"], plain["fill"], plain["borders"]) == ("F0", "0%", None, [])


def test_opendocument_styles():
    cell = '<style:style style:name="{}" style:family="table-cell" {}>{}</style:style>'
    styles = cell.format("base", "", '<style:table-cell-properties fo:border="1pt solid #FF0000" fo:background-color="#00FF00"/><style:text-properties fo:font-weight="bold" fo:font-size="12pt"/>')
    styles += cell.format("child", 'style:parent-style-name="base"', '<style:table-cell-properties fo:border-left="none" fo:wrap-option="wrap"/><style:paragraph-properties fo:text-align="end"/><style:text-properties fo:font-weight="normal"/>')
    rows = '<table:table-row><table:table-cell table:style-name="child" office:value-type="float" office:value="1"/><table:table-cell table:style-name="base" table:number-columns-repeated="16000"/></table:table-row><table:table-row table:number-rows-repeated="9"><table:table-cell/></table:table-row>'
    book = f'<office:document {B.OFFICE}><office:automatic-styles>{styles}</office:automatic-styles><office:body><office:spreadsheet><table:table>{rows}</table:table></office:spreadsheet></office:body></office:document>'
    got = spreadsheets.read_ods(book.encode()).rows
    assert [(x["c"], x["kind"], x["xf"]) for x in got["cells"]][:2] == [(1, "shown", 2), (2, "empty", 1)] and len(got["cells"]) == 257
    assert [got["sheets"][0][n] for n in ("r1", "c1", "r2", "c2")] == [1, 1, 1, 257]
    plain, base, child = got["xfs"]
    assert (plain["fill"], plain["borders"]) == (None, [])
    assert (base["fill"], base["bold"], base["size"], len(base["borders"]), base["borders"][0]) == ("#00ff00", True, 12.0, 4, {"side": "top", "style": "thin", "color": "#ff0000"})
    assert (child["fill"], child["bold"], child["size"], child["align"], child["wrap"], [b["side"] for b in child["borders"]]) == ("#00ff00", False, 12.0, "right", True, ["top", "right", "bottom"])
