"""Spreadsheet readers: OOXML workbooks, BIFF8 workbooks, OpenDocument sheets."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from quire.functions.formula import column_number
from quire.functions.numfmt import BUILTIN
from quire.operators.condfmt import odf_condition
from quire.sources.biff_formula import COMPARISONS, decompile
from quire.sources.containers import Compound, Package, biff_records
from quire.sources.drawings import read_sheet_drawings
from quire.sources.parsed import Parsed
from quire.sources.sheet_styles import BiffStyles, read_odf_styles, read_xlsx_styles
from quire.sources.xmltree import Node, number, on, parse, whole

MAX_ROW, MAX_COL = 1_048_576, 16_384
#: Beyond any row or column.
MOST = 1 << 62
#: Caps of a repeated cell's columns in the used range, and of repeated rows.
USED_REPEAT, ROW_REPEAT = 256, 4096


def cell_place(ref: str) -> tuple[int, int] | None:
    m = re.fullmatch(r"\$?([A-Za-z]{1,3})\$?([0-9]{1,7})", ref.rpartition("!")[2])
    if not m or not int(m[2]):
        return None
    return int(m[2]), column_number(m[1])


def area(ref: str) -> tuple[int, int, int, int] | None:
    a, _, b = ref.rpartition("!")[2].partition(":")
    p, q = cell_place(a), cell_place(b or a)
    if not p or not q:
        return None
    return min(p[0], q[0]), min(p[1], q[1]), max(p[0], q[0]), max(p[1], q[1])


# OOXML -------------------------------------------------------------------------------------------

def _runs(node: Node) -> str:
    """Text of a shared or inline string: its runs, without phonetic hints."""
    if node.child("r") is None:
        return "".join(t.text() for t in node.children("t"))
    return "".join(t.text() for r in node.children("r") for t in r.children("t"))


def _cell(c: Node, strings: list[str]) -> tuple[str, float | None, str | None, bool | None]:
    """(kind, num, txt, flag). Only cached values are read; a date cell (t="d") is empty."""
    kind, v = c.get("t", "n"), c.child("v")
    raw = v.text() if v is not None else None
    if kind == "s":
        k = whole(raw)
        return ("text", None, strings[k], None) if k is not None and 0 <= k < len(strings) else ("empty", None, None, None)
    if kind == "inlineStr":
        inline = c.child("is")
        return ("text", None, _runs(inline), None) if inline is not None else ("empty", None, None, None)
    if raw is None:
        return "empty", None, None, None
    if kind == "str":
        return "text", None, raw, None
    if kind == "b":
        return "bool", None, None, raw.strip() in ("1", "true")
    if kind == "e":
        return "error", None, raw, None
    got = number(raw.strip())
    return ("number", got, None, None) if got is not None and kind == "n" else ("empty", None, None, None)


class _Used:
    """The used range: cells with content or with a fill or border of their format, and merges."""

    def __init__(self, formatted: list[bool]) -> None:
        self.formatted, self.r1, self.c1, self.r2, self.c2 = formatted, MOST, MOST, -MOST, -MOST

    @property
    def box(self) -> dict:
        return {"r1": self.r1, "c1": self.c1, "r2": self.r2, "c2": self.c2} if self.r1 != MOST else {}

    def place(self, r: int, c: int) -> None:
        if r < self.r1:
            self.r1 = r
        if r > self.r2:
            self.r2 = r
        if c < self.c1:
            self.c1 = c
        if c > self.c2:
            self.c2 = c

    def cell(self, r: int, c: int, kind: str, xf: int | None) -> None:
        look = self.formatted
        if kind != "empty" or (look and look[xf if xf is not None and 0 <= xf < len(look) else 0]):
            self.place(r, c)


def _print_setup(root: Node, out: Parsed, k: int) -> None:
    """Margins are inches in the file, points here; a fit of 0 pages means any number."""
    setup, margins, heads = root.child("pageSetup"), root.child("pageMargins"), root.child("headerFooter")
    fit = root.child("sheetPr", "pageSetUpPr")
    get = lambda node, name, default=None: default if node is None else node.get(name, default)
    inches = lambda name, default: 72.0 * (number(get(margins, name)) if number(get(margins, name)) is not None else default)
    said = lambda name: heads.child(name).text() if heads is not None and heads.child(name) is not None else None
    out.add(
        "page_options", sheet_idx=k, paper=whole(get(setup, "paperSize"), 1), landscape=get(setup, "orientation") == "landscape", scale=(number(get(setup, "scale")) or 100.0) / 100.0,
        fit_to_page=bool(on(get(fit, "fitToPage"), False)), fit_width=whole(get(setup, "fitToWidth"), 1), fit_height=whole(get(setup, "fitToHeight"), 1), over_then_down=get(setup, "pageOrder") == "overThenDown",
        top=inches("top", 0.75), right=inches("right", 0.7), bottom=inches("bottom", 0.75), left=inches("left", 0.7), header_margin=inches("header", 0.3), footer_margin=inches("footer", 0.3),
        header=said("oddHeader"), footer=said("oddFooter"),
    )
    for axis, name in (("row", "rowBreaks"), ("col", "colBreaks")):
        for b in root.child(name).children("brk") if root.child(name) else ():
            out.add("breaks", sheet_idx=k, axis=axis, after=whole(b.get("id"), 0))


def _sheet(root: Node, out: Parsed, k: int, strings: list[str], formatted: list[bool]) -> dict:
    """Rows, cells, merges, columns and rules of one sheet; its used range."""
    used = _Used(formatted)
    filled = out.wants("cells", "sheets")
    row_no = 0
    for row in root.child("sheetData").stream("row") if root.child("sheetData") and out.wants("cells", "sheets", "sheet_rows") else ():
        row_no = whole(row.get("r"), row_no + 1)
        height = number(row.get("ht"))
        hidden = on(row.get("hidden"), False)
        if height is not None or hidden:
            out.add("sheet_rows", sheet_idx=k, r=row_no, height=height, hidden=hidden)
        col_no = 0
        for c in row.children("c") if filled else ():
            place = cell_place(c.get("r", ""))
            col_no = place[1] if place else col_no + 1
            kind, num, txt, flag = _cell(c, strings)
            xf = whole(c.get("s"), 0)
            out.add("cells", sheet_idx=k, r=row_no, c=col_no, kind=kind, num=num, txt=txt, flag=flag, xf=xf)
            used.cell(row_no, col_no, kind, xf)
    for n, m in enumerate(root.child("mergeCells").children("mergeCell") if root.child("mergeCells") else ()):
        if box := area(m.get("ref", "")):
            out.add("merges", sheet_idx=k, ordinal=n, r1=box[0], c1=box[1], r2=box[2], c2=box[3])
            used.place(box[2], box[3])
    for n, col in enumerate(root.child("cols").children("col") if root.child("cols") else ()):
        out.add("col_specs", sheet_idx=k, ordinal=n, c_min=whole(col.get("min"), 1), c_max=whole(col.get("max"), 1), width=number(col.get("width")), hidden=on(col.get("hidden"), False))
    _print_setup(root, out, k)
    ordinal = 0
    for block in root.children("conditionalFormatting"):
        boxes = [b for b in map(area, (block.get("sqref") or "").split()) if b]
        for rule in block.children("cfRule"):
            if rule.get("dxfId") is None:
                continue
            for box in boxes:
                out.add(
                    "cond_rules", sheet_idx=k, ordinal=ordinal, r1=box[0], c1=box[1], r2=box[2], c2=box[3], origin_r=boxes[0][0], origin_c=boxes[0][1],
                    priority=whole(rule.get("priority"), 0), kind=rule.get("type", ""), operator=rule.get("operator", ""),
                    formulas=[f.text() for f in rule.children("formula")], text=rule.get("text"), dxf=whole(rule.get("dxfId"), 0),
                )
                ordinal += 1
    return used.box


#: Tables whose rows stay as they are added.
FLOWING = ("cells", "cond_rules")


def read_xlsx(content: bytes) -> Parsed:
    """Visible sheets of a workbook."""
    pack, out = Package(content), Parsed(flowing=FLOWING)
    main = next(iter(pack.related("", "officeDocument")), "xl/workbook.xml")
    book = parse(pack.part(main) or b"")
    rels = pack.relationships(main)
    areas = {whole(n.get("localSheetId"), -1): n.text() for n in (book.child("definedNames").children("definedName") if book.child("definedNames") else ()) if n.get("name") == "_xlnm.Print_Area"}
    part = lambda kind: next((pack.part(p) for k, p in rels.values() if k == kind), None)
    raw = part("sharedStrings")
    strings = [_runs(si) for si in parse(raw).children("si")] if raw else []
    raw = part("styles")
    theme = part("theme")
    formatted = read_xlsx_styles(parse(raw) if raw else None, parse(theme) if theme else None, out)
    for k, sheet in enumerate(book.child("sheets").children("sheet") if book.child("sheets") else ()):
        state = sheet.get("state", "visible")
        row = out.add("sheets", sheet_idx=k, name=sheet.get("name"), state=state)
        rel = rels.get(sheet.full("}id") or "")
        data = pack.part(rel[1]) if rel and rel[0] == "worksheet" and state == "visible" else None
        if data is None:
            continue
        root = parse(data)
        look = root.child("sheetFormatPr")
        if look is not None:
            row.update(default_row_height=number(look.get("defaultRowHeight")), default_col_width=number(look.get("defaultColWidth")))
        row.update(_sheet(root, out, k, strings, formatted))
        out.rows["page_options"][-1]["print_area"] = areas.get(k)
        read_sheet_drawings(pack, rel[1], k, out)
        for path in pack.related(rel[1], "comments"):
            notes = parse(pack.part(path) or b"<x/>")
            authors = [a.text() for a in notes.child("authors").children("author")] if notes.child("authors") else []
            for c in notes.child("commentList").children("comment") if notes.child("commentList") else ():
                place, who, body = cell_place(c.get("ref", "")), whole(c.get("authorId"), -1), c.child("text")
                if place:
                    out.add("comments", sheet_idx=k, r=place[0], c=place[1], author=authors[who] if 0 <= who < len(authors) else None, text=_runs(body) if body else "")
    return out


# OpenDocument ------------------------------------------------------------------------------------

def _odf_value(c: Node) -> tuple[str, float | None, str | None, bool | None]:
    """Numbers keep the text they are shown as; logicals and dates are shown numbers."""
    shown = "\n".join(p.text() for p in c.children("p"))
    kind = c.full("}value-type") or c.get("value-type")
    if kind in ("float", "percentage", "currency"):
        return "shown", number(c.get("value")) or 0.0, shown, None
    if kind == "boolean":
        return "shown", 1.0 if c.get("boolean-value") == "true" else 0.0, shown, None
    if kind in ("date", "time"):
        return "shown", 0.0, shown, None
    return ("text", None, shown, None) if shown else ("empty", None, None, None)


def _odf_rows(node: Node) -> Iterator[Node]:
    """Rows one at a time; each is emptied when the next is asked for."""
    for c in node.stream("table-row", "table-rows", "table-header-rows", "table-row-group"):
        if c.name == "table-row":
            yield c
        else:
            yield from _odf_rows(c)


def _odf_columns(node: Node) -> list[Node]:
    out = []
    for c in node.kids:
        if c.name == "table-column":
            out.append(c)
        elif c.name in ("table-columns", "table-header-columns", "table-column-group"):
            out += _odf_columns(c)
    return out


def odf_sheet(table: Node, out: Parsed, k: int, styles: dict[str, int], formatted: list[bool]) -> dict:
    used, merged = _Used(formatted), 0
    at = 1
    for n, col in enumerate(_odf_columns(table)):
        times = whole(col.get("number-columns-repeated"), 1)
        out.add("col_specs", sheet_idx=k, ordinal=n, c_min=at, c_max=min(at + times - 1, MAX_COL), hidden=col.get("visibility") in ("collapse", "filter"))
        at += times
    r = 1
    for row in _odf_rows(table):
        times = whole(row.get("number-rows-repeated"), 1)
        cells, c = [], 1
        for cell in row.children("table-cell", "covered-table-cell"):
            repeat = whole(cell.get("number-columns-repeated"), 1)
            kind, num, txt, flag = _odf_value(cell)
            xf = styles.get(cell.get("style-name") or "", 0)
            if kind != "empty" or formatted[xf]:
                # Empty cells are only kept for their look, as far as the used range counts them.
                most = min(repeat, MAX_COL - c + 1) if kind != "empty" else min(repeat, MAX_COL - c + 1, USED_REPEAT)
                cells += [(c + i, kind, num, txt, flag, xf, i < USED_REPEAT) for i in range(most)]
            rows, cols = whole(cell.get("number-rows-spanned"), 1), whole(cell.get("number-columns-spanned"), 1)
            if rows > 1 or cols > 1:
                out.add("merges", sheet_idx=k, ordinal=merged, r1=r, c1=c, r2=r + rows - 1, c2=c + cols - 1)
                used.place(r + rows - 1, c + cols - 1)
                merged += 1
            c += repeat
        hidden = row.get("visibility") in ("collapse", "filter")
        for i in range(min(times, ROW_REPEAT) if cells or hidden else 0):
            if hidden:
                out.add("sheet_rows", sheet_idx=k, r=r + i, hidden=True)
            for col, kind, num, txt, flag, xf, counts in cells:
                out.add("cells", sheet_idx=k, r=r + i, c=col, kind=kind, num=num, txt=txt, flag=flag, xf=xf)
                if counts:
                    used.cell(r + i, col, kind, xf)
        r += times
    ordinal = 0
    for block in (n for n in table.walk() if n.name == "conditional-format"):
        boxes = [b for b in (area(re.sub(r"(^|:)[^:]*?\.(?=\$?[A-Z])", r"\1", a)) for a in (block.get("target-range-address") or "").split()) if b]
        for rank, rule in enumerate(block.children("condition")):
            found = odf_condition(rule.get("value", ""))
            for box in boxes if found else ():
                kind, operator, formulas, text = found
                out.add(
                    "cond_rules", sheet_idx=k, ordinal=ordinal, r1=box[0], c1=box[1], r2=box[2], c2=box[3], origin_r=boxes[0][0], origin_c=boxes[0][1],
                    priority=rank, kind=kind, operator=operator, formulas=list(formulas), text=text, dxf=ordinal,
                )
                ordinal += 1
    return used.box


def _field_codes(node) -> str:
    """Text of a header paragraph with codes for its fields."""
    fixed = {"sheet-name": "&A", "page-number": "&P", "page-count": "&N", "tab": " "}
    out = (node.text or "").replace("&", "&&")
    for kid in node:
        name = kid.tag.rpartition("}")[2]
        if name == "s":
            out += " " * int(next((v for k, v in kid.attrib.items() if k.endswith("}c")), "1"))
        else:
            out += fixed.get(name) or _field_codes(kid)
        out += (kid.tail or "").replace("&", "&&")
    return out


def odf_header_code(node: Node | None) -> str | None:
    """A header or footer as codes: regions left, center and right, or all of it in the center; null
    if it is off or shows nothing."""
    if node is None or node.get("display") == "false":
        return None
    text = lambda n: "\n".join(_field_codes(p.el) for p in n.children("p"))
    regions = [(code, node.child(f"region-{name}")) for code, name in (("&L", "left"), ("&C", "center"), ("&R", "right"))]
    parts = [(code, text(n)) for code, n in regions if n is not None] or [("&C", text(node))]
    return "".join(code + t for code, t in parts) if any(t.strip() for _, t in parts) else None


def _odf_headers(root: Node) -> dict[str, tuple[str | None, str | None]]:
    """Header and footer codes of each master page."""
    return {n.get("name", ""): (odf_header_code(n.child("header")), odf_header_code(n.child("footer"))) for n in root.walk() if n.name == "master-page"}


def read_ods(content: bytes) -> Parsed:
    """Shown tables of an OpenDocument sheet, packed or flat."""
    out = Parsed(flowing=FLOWING)
    root = parse(content) if content[:2] != b"PK" else parse(Package(content).part("content.xml") or b"")
    looks = Package(content).part("styles.xml") if content[:2] == b"PK" else None
    headers = _odf_headers(parse(looks) if looks else root)
    masters = {n.get("name"): n.get("master-page-name") for n in root.walk() if n.name == "style" and n.get("family") == "table"}
    hidden = set()
    for style in (n for n in root.walk() if n.name == "style" and n.get("family") == "table"):
        look = style.child("table-properties")
        if look is not None and look.get("display") == "false":
            hidden.add(style.get("name"))
    body = root.find("spreadsheet")
    styles, formatted = read_odf_styles(root, out)
    for k, table in enumerate(body.children("table") if body else ()):
        state = "hidden" if table.get("style-name") in hidden else "visible"
        row = out.add("sheets", sheet_idx=k, name=table.get("name"), state=state)
        if state == "visible":
            row.update(odf_sheet(table, out, k, styles, formatted))
            header, footer = headers.get(masters.get(table.get("style-name")) or "Default", (None, None))
            out.add("page_options", sheet_idx=k, header=header, footer=footer)
    return out


# BIFF8 -------------------------------------------------------------------------------------------

def rk_number(raw: int) -> float:
    """A packed number: two flags, for hundredths and for integers."""
    if raw & 2:
        value = float((raw >> 2) - (1 << 30 if raw & 0x80000000 else 0))
    else:
        value = struct.unpack("<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32))[0]
    return value / 100 if raw & 1 else value


class _Strings:
    """Unicode strings of a record that may go on in CONTINUE parts."""

    def __init__(self, parts: list[bytes]) -> None:
        self.parts, self.k, self.at = parts, 0, 0

    def _room(self) -> int:
        while self.k < len(self.parts) and self.at >= len(self.parts[self.k]):
            self.k, self.at = self.k + 1, 0
        if self.k >= len(self.parts):
            raise ValueError("a string is cut short")
        return len(self.parts[self.k]) - self.at

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            got = min(n - len(out), self._room())
            out += self.parts[self.k][self.at : self.at + got]
            self.at += got
        return out

    def text(self, wide_count: bool = True) -> str:
        n = struct.unpack("<H", self.take(2))[0] if wide_count else self.take(1)[0]
        flags = self.take(1)[0]
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out, wide = "", flags & 1
        while n:
            before = self.k
            room = self._room()
            if self.k != before and self.at == 0:  # the rest starts with its own width flag
                wide = self.take(1)[0] & 1
                room = self._room()
            got = min(n, room // (2 if wide else 1))
            if not got:
                raise ValueError("a string is cut inside a character")
            out += self.take(got * (2 if wide else 1)).decode("utf-16-le" if wide else "latin-1", "replace")
            n -= got
        self.take(4 * runs + extra)
        return out


def read_xls(content: bytes) -> Parsed:
    """A BIFF8 workbook; older and protected ones are refused."""
    files, out = Compound(content), Parsed(flowing=FLOWING)
    stream = files.stream("Workbook")
    if stream is None:
        raise ValueError("an older workbook" if files.stream("Book") is not None else "no workbook stream")
    records = list(biff_records(stream))
    strings: list[str] = []
    codes, styles, sheets = dict(BUILTIN), BiffStyles(), []
    for kind, at, parts in records:
        body = parts[0]
        if kind == 0x0809 and at == 0 and struct.unpack_from("<H", body)[0] != 0x0600:
            raise ValueError("not a BIFF8 workbook")
        if kind == 0x002F:
            raise ValueError("the workbook is protected by a password")
        if kind == 0x00FC:
            reader = _Strings(parts)
            _, unique = struct.unpack("<II", reader.take(8))
            strings = [reader.text() for _ in range(unique)]
        elif kind == 0x041E:
            codes[struct.unpack_from("<H", body)[0]] = _Strings([body[2:]]).text()
        elif kind in BiffStyles.KINDS:
            styles.take(kind, body)
        elif kind == 0x0085:
            pos, state, sort = struct.unpack_from("<IBB", body)
            sheets.append((pos, ("visible", "hidden", "veryHidden")[min(state & 3, 2)], sort, _Strings([body[6:]]).text(False)))
    formatted = styles.fill(out, codes)
    for k, (pos, state, sort, name) in enumerate(sheets):
        row = out.add("sheets", sheet_idx=k, name=name, state=state)
        if state == "visible" and sort == 0:
            row.update(_xls_sheet([r for r in records if r[1] >= pos], out, k, strings, formatted))
    return out


def _xls_sheet(records: list, out: Parsed, k: int, strings: list[str], formatted: list[bool]) -> dict:
    used, merged, depth = _Used(formatted), 0, 0
    waiting: dict | None = None
    boxes: list[tuple[int, int, int, int]] = []

    def put(r: int, c: int, xf: int, kind: str, num=None, txt=None, flag=None) -> dict:
        used.cell(r + 1, c + 1, kind, xf)
        return out.add("cells", sheet_idx=k, r=r + 1, c=c + 1, kind=kind, num=num, txt=txt, flag=flag, xf=xf)

    for kind, _, parts in records:
        b = parts[0]
        if kind == 0x0809:
            depth += 1
        elif kind == 0x000A:
            depth -= 1
            if not depth:
                break
        elif depth != 1:
            continue
        elif kind == 0x0203:
            r, c, xf, v = struct.unpack_from("<HHHd", b)
            put(r, c, xf, "number", v)
        elif kind == 0x027E:
            r, c, xf, raw = struct.unpack_from("<HHHI", b)
            put(r, c, xf, "number", rk_number(raw))
        elif kind == 0x00BD:
            r, c = struct.unpack_from("<HH", b)
            for i in range((len(b) - 6) // 6):
                xf, raw = struct.unpack_from("<HI", b, 4 + 6 * i)
                put(r, c + i, xf, "number", rk_number(raw))
        elif kind == 0x00FD:
            r, c, xf, i = struct.unpack_from("<HHHI", b)
            put(r, c, xf, "text" if i < len(strings) else "empty", txt=strings[i] if i < len(strings) else None)
        elif kind in (0x0204, 0x00D6):
            r, c, xf = struct.unpack_from("<HHH", b)
            put(r, c, xf, "text", txt=_Strings([b[6:]]).text())
        elif kind == 0x0201:
            put(*struct.unpack_from("<HHH", b), "empty")
        elif kind == 0x00BE:
            r, c = struct.unpack_from("<HH", b)
            for i in range((len(b) - 6) // 2):
                put(r, c + i, struct.unpack_from("<H", b, 4 + 2 * i)[0], "empty")
        elif kind == 0x0205:
            r, c, xf, v, error = struct.unpack_from("<HHHBB", b)
            put(r, c, xf, *(("error",) if error else ("bool", None, None, bool(v))))
        elif kind == 0x0006:
            r, c, xf = struct.unpack_from("<HHH", b)
            raw = b[6:14]
            if raw[6:8] != b"\xff\xff":
                put(r, c, xf, "number", struct.unpack("<d", raw)[0])
            elif raw[0] == 0:
                waiting = put(r, c, xf, "empty")
            elif raw[0] == 1:  # a logical result is a number
                put(r, c, xf, "number", float(raw[2]))
            else:
                put(r, c, xf, "error" if raw[0] == 2 else "empty")
        elif kind == 0x0207 and waiting is not None:
            waiting.update(kind="text", txt=_Strings(parts).text())
            used.place(waiting["r"], waiting["c"])
            waiting = None
        elif kind == 0x00E5:
            for i in range(struct.unpack_from("<H", b)[0]):
                r1, r2, c1, c2 = struct.unpack_from("<HHHH", b, 2 + 8 * i)
                out.add("merges", sheet_idx=k, ordinal=merged, r1=r1 + 1, c1=c1 + 1, r2=r2 + 1, c2=c2 + 1)
                used.place(r2 + 1, c2 + 1)
                merged += 1
        elif kind == 0x01B0:  # where the rules behind it apply
            n = struct.unpack_from("<H", b, 12)[0]
            refs = [struct.unpack_from("<HHHH", b, 14 + 8 * i) for i in range(n)]
            boxes = [(r1 + 1, c1 + 1, r2 + 1, c2 + 1) for r1, r2, c1, c2 in refs]
        elif kind == 0x01B1 and boxes:
            sort, operator, n1, n2 = struct.unpack_from("<BBHH", b)
            end = len(b) - n2
            formulas = [f for f in (decompile(raw, boxes[0][:2]) for raw in (b[end - n1 : end], b[end:]) if raw) if f is not None]
            for box in boxes if formulas and sort in (1, 2) else ():
                ordinal = out.count("cond_rules")
                out.add(
                    "cond_rules", sheet_idx=k, ordinal=ordinal, r1=box[0], c1=box[1], r2=box[2], c2=box[3], origin_r=boxes[0][0], origin_c=boxes[0][1], priority=ordinal,
                    kind="cellIs" if sort == 1 else "expression", operator=COMPARISONS[operator] if sort == 1 and operator < len(COMPARISONS) else "", formulas=formulas, dxf=ordinal,
                )
        elif kind == 0x007D:
            c1, c2, width, _, options = struct.unpack_from("<HHHHH", b)
            out.add("col_specs", sheet_idx=k, ordinal=len(out.rows["col_specs"]), c_min=c1 + 1, c_max=c2 + 1, width=width / 256, hidden=bool(options & 1))
        elif kind == 0x0208:
            r, _, _, height, _, _, options = struct.unpack_from("<HHHHHHH", b)
            if options & 0x20 or not height & 0x8000:
                out.add("sheet_rows", sheet_idx=k, r=r + 1, height=(height & 0x7FFF) / 20, hidden=bool(options & 0x20))
    return used.box
