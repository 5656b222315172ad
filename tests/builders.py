"""Small files of every format, built from text and bytes."""

import io
import struct
import zipfile

REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data, zipfile.ZIP_STORED if name == "mimetype" else None)
    return out.getvalue()


def rels(**targets):
    rows = "".join(f'<Relationship Id="{k}" Type="{REL}/{kind}" Target="{path}"{mode}/>' for k, (kind, path, mode) in targets.items())
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rows}</Relationships>'


def xlsx():
    sheet = """<worksheet xmlns="s"><cols><col min="2" max="3" width="20" hidden="1"/></cols><sheetData>
      <row r="1" ht="30"><c r="A1" t="s"><v>0</v></c><c r="B1" s="1"><v>1234.5</v></c><c r="C1" t="b"><v>1</v></c><c r="D1" t="e"><v>#N/A</v></c></row>
      <row r="3" hidden="1"><c r="A3" t="inlineStr"><is><r><t>in</t></r><r><t>line</t></r></is></c><c t="str"><v>text</v></c><c r="C3" t="d"><v>2020-01-01</v></c><c r="D3" t="s"><v>9</v></c></row>
      </sheetData><mergeCells><mergeCell ref="A5:B6"/></mergeCells>
      <conditionalFormatting sqref="B1:B9 D1:D9"><cfRule type="cellIs" dxfId="0" priority="2" operator="greaterThan"><formula>1000</formula></cfRule><cfRule type="dataBar" priority="1"/></conditionalFormatting>
      <pageMargins left="1" top="0.5"/><pageSetup paperSize="9" orientation="landscape" scale="80" pageOrder="overThenDown"/><headerFooter><oddHeader>&amp;LTop</oddHeader></headerFooter><rowBreaks><brk id="4"/></rowBreaks></worksheet>"""
    return package({
        "_rels/.rels": rels(r1=("officeDocument", "xl/workbook.xml", "")),
        "xl/workbook.xml": f'<workbook xmlns="s" xmlns:r="{REL}"><sheets><sheet name="One" sheetId="1" r:id="r1"/><sheet name="Two" sheetId="2" state="hidden" r:id="r2"/></sheets><definedNames><definedName name="_xlnm.Print_Area" localSheetId="0">One!$A$1:$D$9</definedName></definedNames></workbook>',
        "xl/_rels/workbook.xml.rels": rels(r1=("worksheet", "worksheets/sheet1.xml", ""), r2=("worksheet", "worksheets/sheet2.xml", ""), r3=("sharedStrings", "sharedStrings.xml", ""), r4=("styles", "styles.xml", ""), r5=("hyperlink", "http://x", ' TargetMode="External"')),
        "xl/worksheets/sheet1.xml": sheet,
        "xl/worksheets/sheet2.xml": "not xml at all",
        "xl/worksheets/_rels/sheet1.xml.rels": rels(c=("comments", "../comments1.xml", "")),
        "xl/comments1.xml": '<comments xmlns="s"><authors><author>Ann</author></authors><commentList><comment ref="B1" authorId="0"><text><t>note</t></text></comment></commentList></comments>',
        "xl/sharedStrings.xml": '<sst xmlns="s"><si><r><t>sha</t></r><r><t>red</t></r><rPh><t>no</t></rPh></si></sst>',
        "xl/styles.xml": '<styleSheet xmlns="s"><numFmts><numFmt numFmtId="164" formatCode="0.0&quot;x&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"><alignment horizontal="right" wrapText="1"/></xf></cellXfs></styleSheet>',
    })


W = 'xmlns:w="w" xmlns:r="' + REL + '"'


def docx():
    body = """<w:body>
      <w:p><w:pPr><w:pStyle w:val="H1"/><w:spacing w:before="240"/></w:pPr><w:r><w:rPr><w:b/><w:sz w:val="28"/></w:rPr><w:t>Head</w:t></w:r><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:ins><w:r><w:t>ing</w:t></w:r></w:ins></w:p>
      <w:p><w:pPr><w:numPr><w:ilvl w:val="1"/><w:numId w:val="3"/></w:numPr><w:sectPr><w:pgSz w:w="12240" w:h="15840"/><w:headerReference w:type="default" r:id="h1"/></w:sectPr></w:pPr><w:r><w:t xml:space="preserve">Page </w:t></w:r>
        <w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText> PAGE </w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>7</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r><w:r><w:rPr><w:vanish/></w:rPr><w:t>hidden</w:t></w:r></w:p>
      <w:sdt><w:sdtContent><w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc></w:tr></w:tbl></w:sdtContent></w:sdt>
      <w:sectPr><w:pgMar w:left="720"/><w:cols w:num="2" w:space="360"/></w:sectPr></w:body>"""
    return package({
        "_rels/.rels": rels(r1=("officeDocument", "word/document.xml", "")),
        "word/document.xml": f"<w:document {W}>{body}</w:document>",
        "word/_rels/document.xml.rels": rels(h1=("header", "header1.xml", ""), s=("styles", "styles.xml", ""), n=("numbering", "numbering.xml", ""), f=("footnotes", "footnotes.xml", ""), i=("image", "media/a.png", "")),
        "word/header1.xml": f"<w:hdr {W}><w:p><w:r><w:t>Top</w:t></w:r></w:p></w:hdr>",
        "word/styles.xml": f'<w:styles {W}><w:style w:type="paragraph" w:styleId="N" w:default="1"><w:name w:val="Normal"/><w:rPr><w:sz w:val="22"/></w:rPr></w:style><w:style w:type="paragraph" w:styleId="H1"><w:basedOn w:val="N"/><w:rPr><w:b/></w:rPr></w:style></w:styles>',
        "word/numbering.xml": f'<w:numbering {W}><w:abstractNum w:abstractNumId="5"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl></w:abstractNum><w:num w:numId="3"><w:abstractNumId w:val="5"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="4"/></w:lvlOverride></w:num></w:numbering>',
        "word/footnotes.xml": f'<w:footnotes {W}><w:footnote w:type="separator" w:id="0"><w:p/></w:footnote><w:footnote w:id="2"><w:p><w:r><w:t>Foot</w:t></w:r></w:p></w:footnote></w:footnotes>',
        "word/media/a.png": b"\x89PNG\r\n",
    })


def pptx(shown=True):
    slide = lambda text, show="": f"""<p:sld xmlns:p="p" xmlns:a="a" {show}><p:cSld><p:spTree>
      <p:sp><p:nvSpPr><p:cNvPr id="1" name="t"/></p:nvSpPr><p:txBody><a:p><a:r><a:rPr b="1" sz="1800"/><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>
      <p:sp><p:nvSpPr><p:cNvPr id="2" name="h" hidden="1"/></p:nvSpPr><p:txBody><a:p><a:r><a:t>no</a:t></a:r></a:p></p:txBody></p:sp>
      <p:graphicFrame><a:tbl><a:tr><a:tc gridSpan="2"><a:txBody><a:p><a:r><a:t>x</a:t></a:r></a:p></a:txBody></a:tc><a:tc hMerge="1"/></a:tr></a:tbl></p:graphicFrame></p:spTree></p:cSld></p:sld>"""  # noqa: E731
    layer = lambda t: f"""<p:x xmlns:p="p" xmlns:a="a"><p:cSld><p:spTree><p:sp><p:nvSpPr><p:cNvPr id="1"/><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>click</a:t></a:r></a:p></p:txBody></p:sp>
      <p:sp><p:nvSpPr><p:cNvPr id="2"/><p:nvPr/></p:nvSpPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp></p:spTree></p:cSld></p:x>"""  # noqa: E731
    return package({
        "_rels/.rels": rels(r1=("officeDocument", "ppt/presentation.xml", "")),
        "ppt/presentation.xml": f'<p:presentation xmlns:p="p" xmlns:r="{REL}"><p:sldIdLst><p:sldId id="1" r:id="a"/><p:sldId id="2" r:id="b"/></p:sldIdLst><p:sldSz cx="9144000" cy="5143500"/></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(a=("slide", "slides/slide2.xml", ""), b=("slide", "slides/slide1.xml", "")),
        "ppt/slides/slide2.xml": slide("First", "" if shown else 'show="0"'),
        "ppt/slides/slide1.xml": slide("Hidden", 'show="0"'),
        "ppt/slides/_rels/slide2.xml.rels": rels(l=("slideLayout", "../slideLayouts/l.xml", "")),
        "ppt/slideLayouts/l.xml": layer("layout"), "ppt/slideLayouts/_rels/l.xml.rels": rels(m=("slideMaster", "../slideMasters/m.xml", "")), "ppt/slideMasters/m.xml": layer("master"),
    })


OFFICE = 'xmlns:office="o" xmlns:table="t" xmlns:text="x" xmlns:style="s" xmlns:calcext="c" xmlns:draw="d" xmlns:fo="f"'


def fods():
    return f"""<?xml version="1.0"?><office:document {OFFICE} office:mimetype="application/vnd.oasis.opendocument.spreadsheet"><office:body><office:spreadsheet><table:table table:name="T">
      <table:table-column table:number-columns-repeated="3"/><table:table-row table:number-rows-repeated="2"><table:table-cell office:value-type="float" office:value="2.5"><text:p>2,50</text:p></table:table-cell>
      <table:table-cell table:number-columns-repeated="2" office:value-type="string"><text:p>s</text:p></table:table-cell><table:table-cell office:value-type="boolean" office:boolean-value="true"><text:p>TRUE</text:p></table:table-cell>
      <table:table-cell office:value-type="date"><text:p>1 May</text:p></table:table-cell><table:table-cell table:number-columns-repeated="16383"/></table:table-row><table:table-row table:number-rows-repeated="1048000"><table:table-cell/></table:table-row>
      <calcext:conditional-formats><calcext:conditional-format calcext:target-range-address="T.A1:T.B2"><calcext:condition calcext:value="between(1,[.$C$1])"/></calcext:conditional-format></calcext:conditional-formats>
      </table:table></office:spreadsheet></office:body></office:document>""".encode()


def fodt():
    return f"""<office:document {OFFICE} office:mimetype="application/vnd.oasis.opendocument.text"><office:automatic-styles><style:style style:name="P2" style:family="paragraph" style:parent-style-name="P1" style:master-page-name="Wide"/></office:automatic-styles>
      <office:body><office:text><text:h text:outline-level="2">Ti  tle</text:h><text:p>a<text:s text:c="3"/>b<text:tab/><text:span> c </text:span> d</text:p><text:list text:style-name="L"><text:list-item><text:p>one</text:p><text:list><text:list-item><text:p>deep</text:p></text:list-item></text:list></text:list-item></text:list>
      <text:p text:style-name="P2">next</text:p></office:text></office:body></office:document>""".encode()


def fodp():
    page = lambda t: f'<draw:page><draw:frame><draw:text-box><text:p>{t}</text:p></draw:text-box></draw:frame></draw:page>'
    return f'<office:document {OFFICE} office:mimetype="application/vnd.oasis.opendocument.presentation"><office:body><office:presentation>{page("eins")}{page("zwei")}</office:presentation></office:body></office:document>'.encode()


def chart_ods():
    chart = f"""<office:document-content {OFFICE} xmlns:chart="h" xmlns:svg="v"><office:automatic-styles><style:style style:name="ch1"><style:chart-properties chart:vertical="true"/></style:style></office:automatic-styles>
      <office:body><office:chart><chart:chart chart:class="chart:bar"><chart:title><text:p>Sales</text:p></chart:title><chart:plot-area chart:style-name="ch1">
      <chart:axis chart:dimension="x"><chart:categories table:cell-range-address="local-table.$A$2:.$A$3"/></chart:axis>
      <chart:series chart:values-cell-range-address="local-table.$B$2:.$B$4" chart:label-cell-address="local-table.$B$1"/><chart:series chart:values-cell-range-address="One.C2:One.C3"/></chart:plot-area>
      <table:table><table:table-header-rows><table:table-row><table:table-cell><text:p/></table:table-cell><table:table-cell><text:p>North</text:p></table:table-cell></table:table-row></table:table-header-rows>
      <table:table-rows><table:table-row><table:table-cell><text:p>Q1</text:p></table:table-cell><table:table-cell office:value="5"><text:p>5</text:p></table:table-cell><table:table-cell office:value="8"><draw:g><svg:desc>One.C2:One.C3</svg:desc></draw:g></table:table-cell></table:table-row>
      <table:table-row><table:table-cell office:value="2.5"/><table:table-cell office:value="7"/><table:table-cell office:value="9"/></table:table-row></table:table-rows></table:table></chart:chart></office:chart></office:body></office:document-content>"""
    return package({"mimetype": "application/vnd.oasis.opendocument.spreadsheet", "content.xml": fods(), "Object 1/content.xml": chart})


def compound(streams, cutoff=0):
    """A compound file of 512-byte sectors; streams below ``cutoff`` go to the short stream."""
    sectors, fat = [], []

    def put(data):
        start, n = len(sectors), max(1, -(-len(data) // 512))
        for k in range(n):
            sectors.append(data[512 * k : 512 * k + 512].ljust(512, b"\0"))
            fat.append(start + k + 1 if k < n - 1 else 0xFFFFFFFE)
        return start

    mini, mini_fat, rows = b"", [], []
    for name, data in streams.items():
        if len(data) < cutoff:
            start, n = len(mini_fat), max(1, -(-len(data) // 64))
            mini += data.ljust(64 * n, b"\0")
            mini_fat += [start + k + 1 if k < n - 1 else 0xFFFFFFFE for k in range(n)]
        else:
            start = put(data)
        rows.append((name, 2, start, len(data)))
    root = put(mini) if mini else 0xFFFFFFFE
    small = put(struct.pack(f"<{len(mini_fat)}I", *mini_fat).ljust(512, b"\xff")) if mini else 0xFFFFFFFE
    entries = b""
    for name, kind, start, size in [("Root Entry", 5, root, len(mini)), *rows]:
        raw = name.encode("utf-16-le") + b"\0\0"
        entries += raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<IQ", start, size)
    first_dir = put(entries.ljust(-(-len(entries) // 512) * 512, b"\0"))
    table = len(sectors)
    fat.append(0xFFFFFFFD)
    sectors.append(struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff"))
    head = bytes.fromhex("D0CF11E0A1B11AE1") + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6
    head += struct.pack("<IIIIIIIII", 0, 1, first_dir, 0, cutoff, small, 1 if mini else 0, 0xFFFFFFFE, 0)
    return head + struct.pack("<109I", table, *[0xFFFFFFFF] * 108) + b"".join(sectors)


def record(kind, body=b""):
    return struct.pack("<HH", kind, len(body)) + body


def xls(version=0x0600, extra=b"", name="Workbook"):
    text = lambda t: struct.pack("<HB", len(t), 0) + t.encode("latin-1")
    wide = "käse" * 3
    sst = struct.pack("<II", 2, 2) + text("plain") + struct.pack("<HB", len(wide), 0) + wide[:5].encode("latin-1")
    cells = b"".join([
        record(0x0809, struct.pack("<HHHHII", 0x0600, 0x10, 0, 0, 0, 0)),
        record(0x0203, struct.pack("<HHHd", 0, 0, 0, 1.5)),
        record(0x027E, struct.pack("<HHHI", 0, 1, 0, (1234 << 2) | 3)),
        record(0x00BD, struct.pack("<HHHIHIH", 1, 0, 0, (7 << 2) | 2, 0, ((-7 << 2) | 2) & 0xFFFFFFFF, 1)),
        record(0x00FD, struct.pack("<HHHI", 2, 0, 0, 1)),
        record(0x0205, struct.pack("<HHHBB", 2, 1, 0, 1, 0)),
        record(0x0006, struct.pack("<HHH", 2, 2, 0) + b"\x01\0\x01\0\0\0\xff\xff" + b"\0" * 8),
        record(0x0006, struct.pack("<HHH", 2, 3, 0) + b"\0\0\0\0\0\0\xff\xff" + b"\0" * 8),
        record(0x0207, text("made")),
        record(0x00E5, struct.pack("<HHHHH", 1, 4, 5, 0, 1)),
        record(0x01B0, struct.pack("<HHHHHHHHHHH", 2, 1, 0, 8, 0, 0, 1, 0, 8, 0, 0)),
        record(0x01B1, struct.pack("<BBHH", 1, 5, 3, 0) + b"\0" * 6 + b"\x1e\x0a\0"),
        record(0x01B1, struct.pack("<BBHH", 2, 0, 9, 0) + b"\0" * 6 + b"\x4c\0\0\0\xc0" + b"\x1e\x05\0" + b"\x0d"),
        record(0x000A),
    ])
    bound = lambda at: record(0x0085, struct.pack("<IBB", at, 0, 0) + struct.pack("<BB", 2, 0) + b"S1")
    head = record(0x0809, struct.pack("<HHHHII", version, 5, 0, 0, 0, 0)) + extra + record(0x00FC, sst) + record(0x003C, b"\x01" + wide[5:].encode("utf-16-le"))
    size = len(head) + len(bound(0)) + 4
    return compound({name: head + bound(size) + record(0x000A) + cells}, cutoff=4096)


def doc(flags=0):
    """Narrow and wide pieces; the words 'bold' in bold 12, the second paragraph centred, a table."""
    text = "First bold\rSecond\rcell one\x07cell two\x07\x07\x13 PAGE \x147\x15 end\r"
    cut = 14
    narrow, wide = text[:cut], text[cut:]
    main = bytearray(0x0400)
    struct.pack_into("<HH", main, 0, 0xA5EC, 0x00C1)
    struct.pack_into("<H", main, 0x0A, 0x0200 | flags)
    struct.pack_into("<I", main, 0x4C, len(text))
    at_narrow, at_wide = 0x0400, 0x0400 + cut
    place = lambda cp: at_narrow + cp if cp < cut else at_wide + 2 * (cp - cut)
    main += narrow.encode("cp1252") + wide.encode("utf-16-le")
    main += b"\0" * (-len(main) % 512)

    def page(edges, items, width):
        raw, at, rows = bytearray(512), 510, b""
        for item in items:
            at = (at - len(item)) & ~1 if item else at
            if item:
                raw[at : at + len(item)] = item
            rows += bytes([at // 2 if item else 0]).ljust(width, b"\0")
        head = struct.pack(f"<{len(edges)}I", *edges) + rows
        raw[: len(head)] = head
        raw[511] = len(items)
        return bytes(raw)

    chpx = struct.pack("<HBHH", 0x0835, 1, 0x4A43, 24)
    chars = page([place(0), place(6), place(10), place(len(text))], [b"", bytes([len(chpx)]) + chpx, b""], 1)
    papx = lambda style, codes: (lambda b: bytes([(len(b) + 2) // 2]) + b + b"\0" * (1 - len(b) % 2))(struct.pack("<H", style) + codes)
    cell, last = struct.pack("<HB", 0x2416, 1), struct.pack("<HBHB", 0x2416, 1, 0x2417, 1)
    marks = [0, 11, 18, text.index("\x07\x07") + 1, text.index("\x07\x07") + 2, len(text)]
    paras = page([place(c) for c in marks], [papx(1, b""), papx(2, struct.pack("<HBHH", 0x2403, 1, 0xA413, 120)), papx(0, cell), papx(0, last), papx(0, b"")], 13)
    first = len(main) // 512
    main += chars + paras
    plc = struct.pack("<III", 0, cut, len(text)) + struct.pack("<HIH", 0, (at_narrow * 2) | 0x40000000, 0) + struct.pack("<HIH", 0, at_wide, 0)
    clx = b"\x01" + struct.pack("<H", 2) + b"\0\0" + b"\x02" + struct.pack("<I", len(plc)) + plc
    bins = [struct.pack("<III", 0, 1 << 20, first + k) for k in (0, 1)]
    struct.pack_into("<II", main, 0x01A2, 0, len(clx))
    struct.pack_into("<II", main, 0x00FA, len(clx), 12)
    struct.pack_into("<II", main, 0x0102, len(clx) + 12, 12)
    return compound({"WordDocument": bytes(main), "1Table": clx + b"".join(bins)})


MARKDOWN = """# Title with *marks*

Setext
======

Some **bold _both_** text, `code`, ~~gone~~ and [a link](http://x).
Second line.

3. three
4. four
   - inner
   - [x] done

> quoted
> text

```py
code  block
```

    indented

| a | b |
|---|:-:|
| 1 | 2 \\| 3 |

<div>html
<b>block</b></div>

***
"""
