"""Text readers: OOXML and OpenDocument texts and slides, Markdown."""

from __future__ import annotations

import re

from quire.sources.containers import Package
from quire.sources.drawings import read_slide_shapes
from quire.sources.parsed import Parsed
from quire.sources.sheet_styles import read_odf_styles
from quire.sources.spreadsheets import odf_sheet
from quire.sources.xmltree import Node, number, on, parse, whole

THROUGH = ("ins", "moveTo", "customXml", "smartTag", "sdt", "sdtContent", "hyperlink", "dir", "bdo", "fldSimple")
#: The page that a document without page settings has.
LETTER = {"width": 612.0, "height": 792.0, "top": 72.0, "right": 72.0, "bottom": 72.0, "left": 72.0}


#: Fields that stand for a number of the page; of others the stored text is shown.
COMPUTED = ("PAGE", "NUMPAGES", "SECTIONPAGES")


def field_word(code: str) -> str:
    """The keyword of a field's code."""
    return (code.partition(":")[2].split() or [""])[0].upper()


def twips(text: str | None) -> float | None:
    v = number(text)
    return None if v is None else v / 20


def emu(text: str | None) -> float | None:
    v = number(text)
    return None if v is None else v / 12700


# DOCX --------------------------------------------------------------------------------------------

def _word_run_props(r: Node | None) -> dict:
    if r is None:
        return {}
    size, color = number(r.val("sz")), r.val("color")
    under = r.child("u")
    switch = lambda name: None if r.child(name) is None else on(r.val(name), True)
    return {
        "style_id": r.val("rStyle"), "bold": switch("b"), "italic": switch("i"), "strike": switch("strike"), "hidden": switch("vanish"),
        "underline": None if under is None else under.get("val", "single") != "none", "size": None if size is None else size / 2,
        "color": None if color in (None, "auto") else f"#{color.lower()}",
    }


def _word_para_props(p: Node | None) -> dict:
    if p is None:
        return {}
    space, num = p.child("spacing"), p.child("numPr")
    mark = p.child("rPr")
    return {
        "style_id": p.val("pStyle"), "outline": whole(p.val("outlineLvl")), "align": p.val("jc"),
        "num_id": num.val("numId") if num else None, "list_level": whole(num.val("ilvl"), 0) if num else None,
        "before": twips(space.get("before")) if space else None, "after": twips(space.get("after")) if space else None,
        "mark_deleted": bool(mark and mark.child("del") is not None),
    }


#: Names of the sides of tables and cells; left and right also go by start and end.
LINES = {"top": ("top",), "right": ("right", "end"), "bottom": ("bottom",), "left": ("left", "start"), "inside_h": ("insideH",), "inside_v": ("insideV",)}


def border_style(node: Node | None, *names: str) -> str | None:
    """The style of a side; ``none`` if it says that there is no line, null if it says nothing."""
    side = next((c for c in node.kids if c.name in names), None) if node is not None else None
    return None if side is None else {"nil": "none"}.get(side.get("val", "none"), side.get("val", "none"))


def points(text: str | None) -> float | None:
    """A length with its unit; a bare number is pixels of 0.75 points."""
    from quire.functions.scalars import POINTS

    m = re.fullmatch(r"([+-]?[0-9.]+)\s*([a-z]*)", text or "")
    value = number(m[1]) if m else None
    return value * POINTS.get(m[2] or "px", 1.0) if value is not None else None


class _Docx:
    def __init__(self, content: bytes) -> None:
        self.pack, self.out = Package(content), Parsed()
        self.main = next(iter(self.pack.related("", "officeDocument")), "word/document.xml")
        self.rels = self.pack.relationships(self.main)
        self.section = 0
        self.slots: dict[str, str] = {}
        self.cells = 0  # table cells around the block that is read

    def part(self, kind: str) -> Node | None:
        path = next((p for k, p in self.rels.values() if k == kind), None)
        raw = self.pack.part(path) if path else None
        return parse(raw) if raw else None

    def read(self) -> Parsed:
        body = parse(self.pack.part(self.main) or b"").child("body")
        if body is None:
            raise ValueError("no document body")
        self.styles(self.part("styles"))
        self.numbering(self.part("numbering"))
        settings = self.part("settings")
        self.out.default_tab = (twips(settings.val("defaultTabStop")) if settings else None) or 36.0
        self.blocks(body, "body", ())
        self.page(body.child("sectPr"))
        for kind in ("footnotes", "endnotes"):
            notes = self.part(kind)
            for note in notes.kids if notes else ():
                if note.get("type") not in ("separator", "continuationSeparator", "continuationNotice"):
                    self.blocks(note, f"{kind[:-1]}:{note.get('id')}", ())
        for path in (p for k, p in self.rels.values() if k == "chart"):
            if raw := self.pack.part(path):
                read_chart(parse(raw), path, self.out)
        return self.out

    def page(self, s: Node | None) -> None:
        """Close a section; header and footer slots that it leaves out stay as before."""
        size, margin, cols, numbers = (s.child(n) if s else None for n in ("pgSz", "pgMar", "cols", "pgNumType"))
        got = dict(LETTER)
        if size is not None:
            got.update({k: v for k, v in (("width", twips(size.get("w"))), ("height", twips(size.get("h")))) if v is not None})
        if margin is not None:
            got.update({k: abs(v) for k in ("top", "right", "bottom", "left") if (v := twips(margin.get(k))) is not None})
        for ref in s.children("headerReference", "footerReference") if s else ():
            rel = self.rels.get(ref.full("}id") or "")
            raw = self.pack.part(rel[1]) if rel else None
            if raw is not None:
                self.slots[f"{ref.name[:6]}_{ref.get('type', 'default')}"] = "\n".join("".join(t.text() for t in p.walk() if t.name == "t") for p in parse(raw).walk() if p.name == "p")
        self.out.add(
            "sections", section_idx=self.section, **got, columns=whole(cols.get("num"), 1) if cols else 1, column_gap=twips(cols.get("space")) if cols else None,
            title_page=bool(s and s.child("titlePg") is not None and on(s.val("titlePg"), True)), page_start=whole(numbers.get("start")) if numbers else None,
            page_format=numbers.get("fmt") if numbers else None, header=self.slots.get("header_default"), footer=self.slots.get("footer_default"),
        )
        self.section += 1

    def blocks(self, node: Node, story: str, path: tuple[int, ...], k: int = 0) -> int:
        for c in node.kids:
            if c.name == "p":
                self.paragraph(c, story, (*path, k))
                k += 1
            elif c.name == "tbl":
                self.table(c, story, (*path, k))
                k += 1
            elif c.name in THROUGH:
                k = self.blocks(c, story, path, k)
        return k

    def paragraph(self, p: Node, story: str, path: tuple[int, ...]) -> None:
        props = p.child("pPr")
        first = [len(self.out.rows[t]) for t in ("blocks", "inlines")]
        row = self.out.add("blocks", story=story, path=list(path), section_idx=self.section, kind="paragraph", **_word_para_props(props))
        fields: list[str] = []
        texts: list[str] = []
        self.runs(p, path, texts, fields, [0], None)
        row["text"] = "".join(texts)
        mark = props.child("rPr") if props is not None else None
        if self.cells and mark is not None and on(mark.val("vanish", "1"), True) and mark.child("vanish") is not None and not row["text"].strip():
            # A cell's paragraph with a hidden mark and nothing to show is not there.
            del self.out.rows["blocks"][first[0] :], self.out.rows["inlines"][first[1] :]
            return
        if story == "body" and props is not None and props.child("sectPr") is not None:
            self.page(props.child("sectPr"))

    def runs(self, node: Node, path: tuple[int, ...], texts: list[str], fields: list[str], pos: list[int], link: str | None) -> None:
        """Inlines of a paragraph. ``fields`` is the stack of open fields: their parts so far."""
        for c in node.kids:
            if c.name in THROUGH:
                self.runs(c, path, texts, fields, pos, self.link(c) if c.name == "hyperlink" else link)
            elif c.name == "r":
                props = _word_run_props(c.child("rPr"))
                for t in c.kids:
                    self.inline(t, props, path, texts, fields, pos, link)

    def link(self, node: Node) -> str | None:
        return node.get("anchor") or node.full("}id")

    def inline(self, t: Node, props: dict, path: tuple[int, ...], texts: list[str], fields: list[str], pos: list[int], link: str | None) -> None:
        kind = text = None
        if t.name == "fldChar":
            what = t.get("fldCharType")
            if what == "begin":
                fields.append("code:")
            elif what == "separate" and fields and field_word(fields[-1]) not in COMPUTED:
                fields[-1] = "shown:" + fields[-1].partition(":")[2]
            elif what == "end" and fields and (word := field_word(fields.pop())) in COMPUTED:
                kind, text = "field", word
        elif t.name == "instrText" and fields:
            fields[-1] += t.text()
        elif any(f.startswith("code:") for f in fields):
            return
        elif t.name == "t":
            kind, text = "text", t.text()
        elif t.name in ("tab", "ptab"):
            kind, text = "tab", "\t"
        elif t.name in ("br", "cr"):
            kind, text = ("page_break", "") if t.get("type") == "page" else ("line_break", "\n")
        elif t.name == "noBreakHyphen":
            kind, text = "text", "‑"
        elif t.name in ("footnoteReference", "endnoteReference"):
            kind, text = "note", f"{t.name[:-9]}:{t.get('id')}"
        elif t.name in ("drawing", "pict", "object"):
            kind, text = "drawing", ""
            self.drawing(t)
        if kind is None:
            return
        self.out.add("inlines", path=list(path), pos=pos[0], kind=kind, text=text, link=link, **props)
        pos[0] += 1
        if kind in ("text", "tab", "line_break") and not props.get("hidden"):
            texts.append(text)

    def drawing(self, node: Node) -> None:
        """A drawing's kind, place and size in points, and the part that it shows."""
        if node.name == "drawing":
            for frame in node.children("inline", "anchor"):
                size, about, blip = frame.child("extent"), frame.child("docPr"), frame.find("blip")
                place = [n.child("posOffset") if n is not None else None for n in (frame.child("positionH"), frame.child("positionV"))]
                rel = self.rels.get((blip.full("}embed") or "") if blip is not None else "")
                self.out.add(
                    "drawings", section_idx=self.section, idx=len(self.out.rows["drawings"]), kind=frame.name, name=about.get("name") if about is not None else None, part=rel[1] if rel else None,
                    **{k: emu(p.text().strip()) if p is not None else None for k, p in zip("xy", place, strict=True)}, width=emu(size.get("cx")) if size is not None else None, height=emu(size.get("cy")) if size is not None else None,
                )
            return
        for shape in (n for n in node.walk() if n.name in ("shape", "rect", "roundrect", "oval", "line")):
            style = dict(p.split(":", 1) for p in (shape.get("style") or "").split(";") if ":" in p)
            style = {k.strip(): v.strip() for k, v in style.items()}
            data = shape.find("imagedata")
            rel = self.rels.get((data.full("}id") or "") if data is not None else "")
            sizes = {k: points(style.get(n)) for k, n in (("x", "margin-left"), ("y", "margin-top"), ("width", "width"), ("height", "height"))}
            self.out.add("drawings", section_idx=self.section, idx=len(self.out.rows["drawings"]), kind="vml", name=shape.get("id"), part=rel[1] if rel else None, **sizes)

    def table(self, tbl: Node, story: str, path: tuple[int, ...]) -> None:
        lines = tbl.child("tblPr", "tblBorders")
        if lines is not None:
            self.out.add("table_lines", table_path=list(path), **{k: border_style(lines, *n) for k, n in LINES.items()})
        self.out.add("blocks", story=story, path=list(path), section_idx=self.section, kind="table", style_id=(tbl.child("tblPr").val("tblStyle") if tbl.child("tblPr") else None))
        for r, tr in enumerate(n for n in tbl.kids if n.name == "tr"):
            c = whole(tr.child("trPr").val("gridBefore"), 0) if tr.child("trPr") else 0
            for tc in _through(tr, "tc"):
                look = tc.child("tcPr")
                span = whole(look.val("gridSpan"), 1) if look else 1
                merge = look.child("vMerge") if look else None
                shade = look.child("shd") if look else None
                lines = look.child("tcBorders") if look else None
                cell = self.out.add(
                    "table_cells", table_path=list(path), r=r, c=c, span=span, vmerge=None if merge is None else merge.get("val", "continue"),
                    shading=shade.get("fill") if shade else None, **{k: border_style(lines, *LINES[k]) for k in ("top", "right", "bottom", "left")},
                )
                first = len(self.out.rows["blocks"])
                self.cells += 1
                self.blocks(tc, story, (*path, r, c))
                self.cells -= 1
                cell["text"] = "\n".join(b["text"] or "" for b in self.out.rows["blocks"][first:] if b["kind"] == "paragraph")
                c += span

    def styles(self, root: Node | None) -> None:
        for s in root.children("style") if root else ():
            run, para = _word_run_props(s.child("rPr")), _word_para_props(s.child("pPr"))
            self.out.add(
                "styles", style_id=s.get("styleId"), parent_id=s.val("basedOn"), kind=s.get("type"), name=s.val("name"), is_default=on(s.get("default"), False),
                **{k: run.get(k) for k in ("bold", "italic", "size", "color")}, **{k: para.get(k) for k in ("align", "before", "after", "num_id", "list_level")},
            )

    def numbering(self, root: Node | None) -> None:
        for a in root.children("abstractNum") if root else ():
            for level in a.children("lvl"):
                self.out.add(
                    "list_levels", abstract_id=a.get("abstractNumId"), level=whole(level.get("ilvl"), 0), start=whole(level.val("start"), 1),
                    format=level.val("numFmt", "decimal"), text=level.val("lvlText", ""), legal=level.child("isLgl") is not None and on(level.val("isLgl"), True),
                )
        for n in root.children("num") if root else ():
            given = {whole(o.get("ilvl"), 0): whole(o.val("startOverride")) for o in n.children("lvlOverride") if o.child("startOverride") is not None}
            self.out.add("list_instances", num_id=n.get("numId"), abstract_id=n.val("abstractNumId"), overrides=given)


def _through(node: Node, name: str) -> list[Node]:
    out = []
    for c in node.kids:
        if c.name == name:
            out.append(c)
        elif c.name in THROUGH:
            out += _through(c, name)
    return out


def read_docx(content: bytes) -> Parsed:
    return _Docx(content).read()


# Charts ------------------------------------------------------------------------------------------

CHARTS = {"barChart": "column", "lineChart": "line", "pieChart": "pie", "areaChart": "area", "doughnutChart": "pie", "bar3DChart": "column", "pie3DChart": "pie", "line3DChart": "line", "area3DChart": "area"}


def _cache(node: Node | None) -> tuple[dict[int, str], int]:
    points, size = {}, 0
    for n in node.walk() if node else ():
        if n.name == "ptCount":
            size = max(size, whole(n.get("val"), 0))
        elif n.name == "pt" and n.child("v") is not None:
            points[whole(n.get("idx"), 0)] = n.child("v").text()
    return points, max([size, *(k + 1 for k in points)])


def read_chart(root: Node, chart_id: str, out: Parsed) -> None:
    """The first plot group that is known; gaps in its caches are null, missing categories numbers."""
    group = next((n for n in root.walk() if n.name in CHARTS), None)
    if group is None:
        return
    kind = CHARTS[group.name]
    if kind == "column" and group.val("barDir") == "bar":
        kind = "bar"
    series = group.children("ser")
    names = ["".join(_cache(s.child("tx"))[0].values()) or (s.child("tx").text() if s.child("tx") else "") for s in series]
    title = root.find("title")
    said = "".join(t.text() for t in title.walk() if t.name == "t") if title else ""
    deleted = root.find("autoTitleDeleted")
    auto = names[0] if len(names) == 1 and not (deleted is not None and on(deleted.get("val"), True)) else None
    out.add("charts", chart_id=chart_id, kind=kind, title=said or auto)
    cats, n_cats = _cache(series[0].child("cat")) if series else ({}, 0)
    size = max([n_cats, *(_cache(s.child("val"))[1] for s in series)])
    for k, s in enumerate(series):
        values, _ = _cache(s.child("val"))
        for pos in range(size):
            out.add("chart_points", chart_id=chart_id, series_idx=k, series_name=names[k], pos=pos + 1, category=cats.get(pos, str(pos + 1)), value=number(values.get(pos)))


# PPTX --------------------------------------------------------------------------------------------

def _slide_paragraphs(body: Node, out: Parsed, slide: int, shape: int, at: int) -> int:
    for p in body.children("p"):
        look = p.child("pPr")
        text = "".join(t.text() if t.name == "t" else "\n" for t in p.walk() if t.name in ("t", "br"))
        number_form = look.child("buAutoNum") if look else None
        row = out.add(
            "blocks", story=f"slide:{slide}", path=[slide, shape, at], section_idx=slide, kind="paragraph", list_level=whole(look.get("lvl"), 0) if look else 0,
            align=look.get("algn") if look else None, num_id=number_form.get("type") if number_form else None, text=text,
        )
        for pos, r in enumerate(p.children("r", "fld")):
            props = r.child("rPr")
            size = number(props.get("sz")) if props else None
            out.add(
                "inlines", path=row["path"], pos=pos, kind="text" if r.name == "r" else "field", text="".join(t.text() for t in r.children("t")),
                bold=on(props.get("b")) if props else None, italic=on(props.get("i")) if props else None, size=None if size is None else size / 100,
            )
        at += 1
    return at


def _slide_shapes(tree: Node, out: Parsed, pack: Package, rels: dict, slide: int, shape: int = 0, own: bool = True) -> int:
    """Shapes of a tree from number ``shape`` on; of a master or layout (not ``own``) only those
    that are no placeholders."""
    for s in tree.kids:
        if not own and s.child("nvSpPr", "nvPr", "ph") is not None:
            continue
        if s.name == "AlternateContent":
            chosen = s.child("Choice") or s.child("Fallback")
            shape = _slide_shapes(chosen, out, pack, rels, slide, shape, own) if chosen else shape
            continue
        about = next((n for n in s.walk() if n.name == "cNvPr"), None)
        if about is not None and on(about.get("hidden"), False):
            continue
        if s.name == "grpSp":
            shape = _slide_shapes(s, out, pack, rels, slide, shape, own)
        elif s.name in ("sp", "cxnSp", "pic") and s.child("txBody") is not None:
            _slide_paragraphs(s.child("txBody"), out, slide, shape, 0)
            shape += 1
        elif s.name == "graphicFrame":
            table, chart = s.find("tbl"), s.find("chart")
            if table is not None:
                path = [slide, shape]
                out.add("blocks", story=f"slide:{slide}", path=path, section_idx=slide, kind="table")
                for r, tr in enumerate(table.children("tr")):
                    c = 0
                    for tc in tr.children("tc"):
                        if not on(tc.get("hMerge"), False):
                            merge = "restart" if whole(tc.get("rowSpan"), 1) > 1 else "continue" if on(tc.get("vMerge"), False) else None
                            text = "\n".join("".join(t.text() for t in p.walk() if t.name == "t") for p in tc.walk() if p.name == "p")
                            out.add("table_cells", table_path=path, r=r, c=c, span=whole(tc.get("gridSpan"), 1), vmerge=merge, text=text)
                        c += 1
                shape += 1
            elif chart is not None and (rel := rels.get(chart.full("}id") or "")) and (raw := pack.part(rel[1])):
                read_chart(parse(raw), rel[1], out)
    return shape


def read_pptx(content: bytes) -> Parsed:
    """Slides that are shown, in order; a file without any is an error."""
    pack, out = Package(content), Parsed()
    main = next(iter(pack.related("", "officeDocument")), "ppt/presentation.xml")
    root, rels = parse(pack.part(main) or b""), pack.relationships(main)
    size = root.child("sldSz")
    page = {**LETTER, "top": 0.0, "right": 0.0, "bottom": 0.0, "left": 0.0}
    if size is not None:
        page.update(width=emu(size.get("cx")), height=emu(size.get("cy")))
    shown = 0
    for ref in root.child("sldIdLst").children("sldId") if root.child("sldIdLst") else ():
        rel = rels.get(ref.full("}id") or "")
        raw = pack.part(rel[1]) if rel else None
        if raw is None:
            continue
        slide = parse(raw)
        if not on(slide.get("show"), True):
            continue
        out.add("sections", section_idx=shown, **page, columns=1, title_page=False)
        # Shapes of the master lie lowest, then the layout's, then the slide's.
        layers, at, node = [(slide, rel[1])], rel[1], slide
        for kind in ("slideLayout", "slideMaster"):
            if not on(node.get("showMasterSp"), True):
                break
            at = next(iter(pack.related(at, kind)), "")
            data = pack.part(at)
            if data is None:
                break
            node = parse(data)
            layers.append((node, at))
        shape = 0
        if slide.child("cSld", "spTree") is not None:
            read_slide_shapes(slide.child("cSld", "spTree"), shown, pack.relationships(rel[1]), out)
        for node, at in reversed(layers):
            tree = node.child("cSld", "spTree")
            if tree is not None:
                shape = _slide_shapes(tree, out, pack, pack.relationships(at), shown, shape, node is slide)
        shown += 1
    if not shown:
        raise ValueError("no slide is shown")
    return out


# OpenDocument text and slides --------------------------------------------------------------------

def _odf_text(node: Node) -> str:
    """Text of a paragraph: white space collapses, s, tab and line-break elements count."""
    parts: list[str] = []

    def go(el) -> None:
        name = el.tag.rpartition("}")[2] if isinstance(el.tag, str) else ""
        if name == "s":
            parts.append("\0" * int(next((v for k, v in el.attrib.items() if k.endswith("}c")), "1")))
        elif name == "tab":
            parts.append("\t")
        elif name == "line-break":
            parts.append("\n")
        elif name not in ("note", "annotation", "frame", "custom-shape"):
            parts.append(re.sub(r"[ \t\r\n]+", " ", el.text or ""))
            for c in el:
                go(c)
                parts.append(re.sub(r"[ \t\r\n]+", " ", c.tail or ""))

    go(node.el)
    return re.sub(" {2,}", " ", "".join(parts)).strip(" ").replace("\0", " ")


def _odf_blocks(node: Node, out: Parsed, story: str, section: int, path: tuple[int, ...], k: int, lists: tuple[str, int] | None) -> int:
    for c in node.kids:
        if c.name in ("p", "h"):
            out.add(
                "blocks", story=story, path=[*path, k], section_idx=section, kind="paragraph", style_id=c.get("style-name"), text=_odf_text(c),
                outline=whole(c.get("outline-level"), 1) - 1 if c.name == "h" else None, num_id=lists[0] if lists else None, list_level=lists[1] if lists else None,
            )
            k += 1
        elif c.name == "list":
            name = c.get("style-name") or (lists[0] if lists else "")
            for item in c.children("list-item", "list-header"):
                k = _odf_blocks(item, out, story, section, path, k, (name, lists[1] + 1 if lists else 0))
        elif c.name == "table":
            out.add("blocks", story=story, path=[*path, k], section_idx=section, kind="table", style_id=c.get("style-name"))
            rows = [r for r in c.walk() if r.name == "table-row"]
            for r, row in enumerate(rows):
                col = 0
                for cell in row.children("table-cell", "covered-table-cell"):
                    span = whole(cell.get("number-columns-spanned"), 1)
                    if cell.name == "table-cell":
                        tall = whole(cell.get("number-rows-spanned"), 1) > 1
                        text = "\n".join(_odf_text(p) for p in cell.children("p", "h"))
                        out.add("table_cells", table_path=[*path, k], r=r, c=col, span=span, vmerge="restart" if tall else None, text=text)
                    col += whole(cell.get("number-columns-repeated"), 1)
            k += 1
        elif c.name in ("section", "index-body", "table-of-content", "text-box", "frame", "custom-shape", "g"):
            k = _odf_blocks(c, out, story, section, path, k, lists)
    return k


def _odf_styles(root: Node, out: Parsed) -> None:
    for s in (n for n in root.walk() if n.name == "style" and n.get("name")):
        text, para = s.child("text-properties"), s.child("paragraph-properties")
        size = re.fullmatch(r"([0-9.]+)pt", (text.get("font-size") or "") if text else "")
        out.add(
            "styles", style_id=s.get("name"), parent_id=s.get("parent-style-name"), kind=s.get("family"), name=s.get("display-name") or s.get("name"), is_default=False,
            bold=(text.get("font-weight") == "bold" if text and text.get("font-weight") else None), italic=(text.get("font-style") == "italic" if text and text.get("font-style") else None),
            size=float(size[1]) if size else None, color=text.get("color") if text else None, align=para.get("text-align") if para else None,
        )


def _odf_roots(content: bytes) -> tuple[Node, list[Node]]:
    if content[:2] != b"PK":
        root = parse(content)
        return root, [root]
    pack = Package(content)
    main = parse(pack.part("content.xml") or b"")
    extra = pack.part("styles.xml")
    return main, [main, *([parse(extra)] if extra else [])]


def _odf_page(roots: list[Node]) -> dict:
    from quire.functions.scalars import POINTS

    def points(text: str | None) -> float | None:
        m = re.fullmatch(r"([+-]?[0-9.]+)([a-z]+)", text or "")
        return float(m[1]) * POINTS[m[2]] if m and m[2] in POINTS else None

    page = dict(LETTER)
    look = next((n for r in roots for n in r.walk() if n.name == "page-layout-properties"), None)
    if look is not None:
        for key, name in (("width", "page-width"), ("height", "page-height"), ("top", "margin-top"), ("right", "margin-right"), ("bottom", "margin-bottom"), ("left", "margin-left")):
            if (v := points(look.get(name))) is not None:
                page[key] = v
    return page


def read_odt(content: bytes) -> Parsed:
    """A text; a paragraph whose style names another master page starts a section."""
    out = Parsed(default_tab=36.0)
    root, roots = _odf_roots(content)
    body = root.find("text") if root.find("body") is None else root.find("body").child("text")
    if body is None:
        raise ValueError("no text body")
    for r in roots:
        _odf_styles(r, out)
    masters = {s.get("name"): s.get("master-page-name") for r in roots for s in r.walk() if s.name == "style" and s.get("master-page-name")}
    section, k = 0, 0
    for c in body.kids:
        if c.name in ("p", "h") and masters.get(c.get("style-name")) and k:
            section += 1
        holder = Node(c.el)
        holder.kids = [c]
        k = _odf_blocks(holder, out, "body", section, (), k, None)
    for n in range(section + 1):
        out.add("sections", section_idx=n, **_odf_page(roots), columns=1, title_page=False)
    return out


def read_odp(content: bytes) -> Parsed:
    """Slides of a presentation: each drawing page is a section."""
    out = Parsed()
    root, roots = _odf_roots(content)
    body = root.find("presentation")
    pages = body.children("page") if body else []
    styles = read_odf_styles(root, out)
    for k, page in enumerate(pages):
        out.add("sections", section_idx=k, **_odf_page(roots), columns=1, title_page=False)
        _odf_blocks(page, out, f"slide:{k}", k, (k,), 0, None)
        for table in (t for t in page.walk() if t.name == "table"):
            odf_sheet(table, out, k, *styles)
    return out


# Markdown ----------------------------------------------------------------------------------------

_LIST = re.compile(r"( {0,3})([-+*]|([0-9]{1,9})[.)])( +|$)(.*)")


class _Markdown:
    """A subset: headings of both kinds, lists with tasks, quotes, fences, indented code, tables,
    rules, HTML blocks; strong, emphasis, code, strike and links inside."""

    def __init__(self, out: Parsed) -> None:
        self.out, self.k, self.lists = out, 0, 0

    def block(self, kind: str, text: str, **more) -> None:
        row = self.out.add("blocks", story="body", path=[self.k], section_idx=0, kind="paragraph", style_id=kind, text=None, **more)
        self.k += 1
        if kind in ("code", "rule"):
            row["text"] = text
            return
        parts = inline_marks(text)
        row["text"] = "".join(p["text"] for p in parts)
        for pos, p in enumerate(parts):
            self.out.add("inlines", path=row["path"], pos=pos, kind="text", **p)

    def lines(self, lines: list[str], quote: bool = False, level: int | None = None, num_id: str | None = None) -> None:
        para: list[str] = []
        more = {"list_level": level, "num_id": num_id}
        name = "quote" if quote else "text"

        def close() -> None:
            if para:
                self.block(name, "\n".join(x.strip() for x in para), **more)
                para.clear()

        at = 0
        while at < len(lines):
            line = lines[at].expandtabs(4)
            bare = line.strip()
            if not bare:
                close()
            elif m := re.match(r" {0,3}(`{3,}|~{3,})(.*)", line):
                close()
                end = next((k for k in range(at + 1, len(lines)) if re.match(rf" {{0,3}}{re.escape(m[1])}{re.escape(m[1][0])}*\s*$", lines[k])), len(lines))
                self.block("code", "\n".join(lines[at + 1 : end]), **more)
                at = end
            elif m := re.match(r" {0,3}(#{1,6})(?:\s+(.*?))?(?:\s+#+)?\s*$", line):
                close()
                self.block(f"heading{len(m[1])}", m[2] or "", outline=len(m[1]) - 1, **more)
            elif para and re.match(r" {0,3}(=+|-+)\s*$", line):
                depth = 0 if bare[0] == "=" else 1
                text = "\n".join(x.strip() for x in para)
                para.clear()
                self.block(f"heading{depth + 1}", text, outline=depth, **more)
            elif re.match(r" {0,3}([-*_])(?:\s*\1){2,}\s*$", line):
                close()
                self.block("rule", "", **more)
            elif line.startswith("    ") and not para:
                end = at
                while end < len(lines) and (lines[end].startswith("    ") or not lines[end].strip()):
                    end += 1
                self.block("code", "\n".join(x[4:] for x in lines[at:end]).rstrip("\n"), **more)
                at = end - 1
            elif re.match(r" {0,3}>", line):
                close()
                end = at
                while end < len(lines) and lines[end].strip() and (re.match(r" {0,3}>", lines[end]) or not _LIST.match(lines[end])):
                    end += 1
                self.lines([re.sub(r"^ {0,3}> ?", "", x) for x in lines[at:end]], True, level, num_id)
                at = end - 1
            elif (m := _LIST.match(line)) and not (para and m[3] and m[3] != "1"):
                close()
                at = self.list(lines, at, -1 if level is None else level, quote)
            elif at + 1 < len(lines) and "|" in line and re.match(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$", lines[at + 1]) and not para:
                close()
                at = self.table(lines, at)
            elif re.match(r" {0,3}<(?:[A-Za-z/!?])", line) and not para:
                end = next((k for k in range(at, len(lines)) if not lines[k].strip()), len(lines))
                text = re.sub(r"\s+", " ", re.sub(r"(?s)<[^>]*(?:>|$)", "", "\n".join(lines[at:end]))).strip()
                if text:
                    self.block("html", text, **more)
                at = end - 1
            else:
                para.append(line)
            at += 1
        close()

    def list(self, lines: list[str], at: int, level: int, quote: bool) -> int:
        """Items of one list from line ``at``; the last line that belongs to it."""
        self.lists += 1
        first = _LIST.match(lines[at])
        mine = f"list{self.lists}"
        self.out.add("list_levels", abstract_id=mine, level=level + 1, start=int(first[3]) if first[3] else 1, format="decimal" if first[3] else "bullet", text="%1." if first[3] else "•", legal=False)
        while at < len(lines) and (m := _LIST.match(lines[at])) and bool(m[3]) == bool(first[3]):
            indent = len(m[1]) + len(m[2]) + (min(len(m[4]), 4) or 1)
            body, end = [m[5]], at + 1
            while end < len(lines) and (not lines[end].strip() or lines[end].startswith(" " * indent) or (body[-1] and lines[end].strip() and not _LIST.match(lines[end]) and not re.match(r" {0,3}(#|>|```)", lines[end]))):
                body.append(lines[end][indent:] if lines[end].startswith(" " * indent) else lines[end].strip())
                end += 1
            while body and not body[-1].strip():
                body.pop()
            if body and (task := re.match(r"\[([ xX])\] (.*)", body[0])):
                body[0] = ("☑ " if task[1] in "xX" else "☐ ") + task[2]
            self.lines(body or [""], quote, level + 1, mine)
            at = end
        return at - 1

    def table(self, lines: list[str], at: int) -> int:
        path = [self.k]
        self.k += 1
        self.out.add("blocks", story="body", path=path, section_idx=0, kind="table")
        split = lambda x: [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", re.sub(r"^\s*\||(?<!\\)\|\s*$", "", x))]
        head = split(lines[at])
        rows, end = [head], at + 2
        while end < len(lines) and "|" in lines[end] and lines[end].strip():
            rows.append((split(lines[end]) + [""] * len(head))[: len(head)])
            end += 1
        for r, row in enumerate(rows):
            for c, text in enumerate(row):
                self.out.add("table_cells", table_path=path, r=r, c=c, span=1, text="".join(p["text"] for p in inline_marks(text)))
        return end - 1


_INLINE = re.compile(
    r"(?P<esc>\\[!-/:-@\[-`{-~])|(?P<code>`+)(?P<body>.+?)(?<!`)(?P=code)(?!`)|!\[(?P<alt>[^\]]*)\]\((?P<src>[^)\s]*)[^)]*\)|\[(?P<label>[^\]]*)\]\((?P<to>[^)\s]*)[^)]*\)"
    r"|<(?P<auto>[a-z][a-z0-9+.-]*:[^>\s]*)>|(?P<strong>\*\*|__)(?=\S)|(?P<strike>~~)|(?P<em>[*_])",
    re.S,
)


def inline_marks(text: str) -> list[dict]:
    """Stretches of a paragraph with their marks."""
    state = {"bold": False, "italic": False, "strike": False}
    out: list[dict] = []

    def put(t: str, **more) -> None:
        if t:
            out.append({"text": t, **{k: v or None for k, v in state.items()}, **more})

    at = 0
    for m in _INLINE.finditer(text):
        if m.start() < at:
            continue
        put(text[at : m.start()])
        at = m.end()
        if m["esc"]:
            put(m["esc"][1])
        elif m["code"]:
            put(m["body"].strip(), style_id="code")
        elif m["src"] is not None:
            put(m["alt"], link=m["src"], style_id="image")
        elif m["to"] is not None:
            put("".join(p["text"] for p in inline_marks(m["label"])), link=m["to"])
        elif m["auto"]:
            put(m["auto"], link=m["auto"])
        else:
            key = "bold" if m["strong"] else "strike" if m["strike"] else "italic"
            mark = m[0]
            inner = key == "italic" and mark == "_" and m.start() and text[m.start() - 1].isalnum() and text[m.end() : m.end() + 1].isalnum()
            if inner or (not state[key] and mark not in text[m.end() :]):
                put(mark)
            else:
                state[key] = not state[key]
    put(text[at:])
    return out


def read_markdown(content: bytes) -> Parsed:
    out = Parsed(default_tab=36.0, flowing=("blocks", "inlines"))
    out.add("sections", section_idx=0, **LETTER, columns=1, title_page=False)
    text = content.decode("utf-8", "replace").removeprefix("﻿")
    _Markdown(out).lines(text.replace("\r\n", "\n").replace("\r", "\n").split("\n"))
    return out
