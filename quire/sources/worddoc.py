"""Word 97 documents: the piece table, formatted pages of runs, property codes, tables, notes."""

from __future__ import annotations

import bisect
import re
import struct
from collections.abc import Iterator

from quire.sources.containers import Compound
from quire.sources.parsed import Parsed

#: Places of tables in the file's head (offset and size, 32 bits each).
STYLES, CHARACTERS, PARAGRAPHS, SECTIONS, PIECES = 0xA2, 0xFA, 0x102, 0xCA, 0x1A2
#: Property codes that are read.
CHAR_CODES = {0x0835: "bold", 0x0836: "italic", 0x0837: "strike", 0x083C: "hidden", 0x2A3E: "underline", 0x4A43: "size", 0x6870: "color"}
PARA_CODES = {0x2403: "align", 0x2461: "align", 0xA413: "before", 0xA414: "after", 0x260A: "list_level", 0x460B: "num_id", 0x2640: "outline", 0x2416: "in_table", 0x2417: "row_end"}
ALIGN = ("left", "center", "right", "both")


def codes(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """(code, operand) of a list of property changes."""
    at = 0
    while at + 2 <= len(raw):
        (code,) = struct.unpack_from("<H", raw, at)
        at += 2
        kind = code >> 13
        if code == 0xD608:  # a table's definition has a 16-bit length, one too large
            size, at = struct.unpack_from("<H", raw, at)[0] - 1, at + 2
        elif kind == 6:
            size, at = raw[at] if at < len(raw) else 0, at + 1
        else:
            size = (1, 1, 2, 4, 2, 2, 0, 3)[kind]
        yield code, raw[at : at + size]
        at += size


def toggled(operand: int, base: bool | None) -> bool | None:
    """A switch: off, on, as the style has it, or its opposite."""
    return {0: False, 1: True, 129: not base}.get(operand, base)


def char_props(raw: bytes, base: dict | None = None) -> dict:
    base, out = base or {}, dict(base or {})
    for code, v in codes(raw):
        name = CHAR_CODES.get(code)
        if name in ("bold", "italic", "strike", "hidden") and v:
            out[name] = toggled(v[0], base.get(name))
        elif name == "underline" and v:
            out[name] = v[0] not in (0, 5)
        elif name == "size" and len(v) == 2:
            out[name] = struct.unpack("<H", v)[0] / 2
        elif name == "color" and len(v) == 4 and v[3] != 0xFF:
            out[name] = f"#{v[:3].hex()}"
    return out


def para_props(raw: bytes) -> dict:
    out: dict = {}
    for code, v in codes(raw):
        name = PARA_CODES.get(code)
        if name is None or not v:
            continue
        n = int.from_bytes(v, "little")
        if name == "align":
            out[name] = ALIGN[n] if n < len(ALIGN) else None
        elif name in ("before", "after"):
            out[name] = n / 20
        elif name in ("in_table", "row_end"):
            out[name] = bool(n)
        elif name == "num_id":
            out[name] = str(n) if n else None
        elif name == "outline":
            out[name] = n if n < 9 else None
        else:
            out[name] = n
    return out


class Runs:
    """Formatting by file offset: starts in order, each with its end and bytes."""

    def __init__(self, main: bytes, table: bytes, at: int, paragraphs: bool) -> None:
        start, size = struct.unpack_from("<II", main, at)
        plc = table[start : start + size]
        n = (size - 4) // 8
        self.runs: list[tuple[int, int, bytes]] = []
        for (page,) in struct.iter_unpack("<I", plc[4 * (n + 1) : 4 * (n + 1) + 4 * n]) if size >= 12 else ():
            body = main[512 * (page & 0x3FFFFF) :][:512]
            if len(body) == 512:
                self.runs += self._page(body, paragraphs)
        self.runs.sort()
        self.starts = [r[0] for r in self.runs]

    @staticmethod
    def _page(body: bytes, paragraphs: bool) -> Iterator[tuple[int, int, bytes]]:
        n = body[511]
        edges = struct.unpack_from(f"<{n + 1}I", body)
        width = 13 if paragraphs else 1
        for k in range(n):
            at = 2 * body[4 * (n + 1) + width * k]
            raw = b""
            if at:
                size = body[at]
                if not paragraphs:
                    raw = body[at + 1 : at + 1 + size]
                elif size:
                    raw = body[at + 1 : at + 2 * size]
                else:
                    raw = body[at + 2 : at + 2 + 2 * body[at + 1]]
            yield edges[k], edges[k + 1], raw

    def find(self, at: int) -> tuple[int, bytes]:
        """(end of the run that holds the offset, its bytes)."""
        k = bisect.bisect_right(self.starts, at) - 1
        if k >= 0 and self.runs[k][1] > at:
            return self.runs[k][1], self.runs[k][2]
        return (self.starts[k + 1] if k + 1 < len(self.starts) else 1 << 62), b""


def pieces(main: bytes, table: bytes) -> list[tuple[int, int, int, int]]:
    """(first character, behind the last, file offset, bytes a character)."""
    at, size = struct.unpack_from("<II", main, PIECES)
    clx, pos = table[at : at + size], 0
    while pos < len(clx) and clx[pos] == 1:
        pos += 3 + struct.unpack_from("<H", clx, pos + 1)[0]
    if pos >= len(clx) or clx[pos] != 2:
        raise ValueError("no piece table")
    n = (struct.unpack_from("<I", clx, pos + 1)[0] - 4) // 12
    body = clx[pos + 5 :]
    places = struct.unpack_from(f"<{n + 1}I", body)
    out = []
    for k in range(n):
        fc = struct.unpack_from("<I", body, 4 * (n + 1) + 8 * k + 2)[0]
        narrow = bool(fc & 0x40000000)
        out.append((places[k], places[k + 1], (fc & 0x3FFFFFFF) // 2 if narrow else fc, 1 if narrow else 2))
    return out


class _Doc:
    def __init__(self, content: bytes) -> None:
        files = Compound(content)
        main = files.stream("WordDocument")
        if main is None or len(main) < 0x1AA or struct.unpack_from("<H", main)[0] != 0xA5EC:
            raise ValueError("no Word document")
        if struct.unpack_from("<H", main, 2)[0] < 0x00C1:
            raise ValueError("an older Word document")
        flags = struct.unpack_from("<H", main, 0x0A)[0]
        if flags & 0x0100:
            raise ValueError("the document is protected by a password")
        table = files.stream("1Table" if flags & 0x0200 else "0Table")
        if table is None:
            raise ValueError("no table stream")
        self.out, self.pieces = Parsed(default_tab=36.0), pieces(main, table)
        self.chars, self.paras = Runs(main, table, CHARACTERS, False), Runs(main, table, PARAGRAPHS, True)
        self.text = "".join(main[f : f + (b - a) * w].decode("cp1252" if w == 1 else "utf-16-le", "replace").ljust(b - a)[: b - a] for a, b, f, w in self.pieces)
        main_size, notes_size = struct.unpack_from("<II", main, 0x4C)
        self.stories = [("body", 0, main_size), ("footnotes", main_size, main_size + notes_size)]

    def offset(self, cp: int) -> tuple[int, int, int]:
        """(file offset, bytes a character, characters left in the piece)."""
        k = bisect.bisect_right([p[0] for p in self.pieces], cp) - 1
        a, b, f, w = self.pieces[k]
        return f + (cp - a) * w, w, b - cp

    def read(self) -> Parsed:
        for story, a, b in self.stories:
            self.story(story, a, min(b, len(self.text)))
        self.out.add("sections", section_idx=0, width=612.0, height=792.0, top=72.0, right=72.0, bottom=72.0, left=72.0, columns=1, title_page=False)
        return self.out

    def story(self, story: str, a: int, b: int) -> None:
        """Paragraphs up to their marks; those of a table make its cells."""
        k, rows, cells, held, at = 0, 0, [], [], a
        path: list[int] | None = None
        for m in re.finditer("[\r\x07]", self.text[a:b]):
            end = a + m.start()
            place = self.offset(end)[0]
            raw = self.paras.find(place)[1]
            props = para_props(raw[2:])
            style = str(struct.unpack_from("<H", raw)[0]) if len(raw) >= 2 else None
            inside, last = props.pop("in_table", False), props.pop("row_end", False)
            if inside or last:
                if path is None:
                    path, rows = [k], 0
                    self.out.add("blocks", story=story, path=path, section_idx=0, kind="table")
                    k += 1
                if last:
                    for c, text in enumerate(cells):
                        self.out.add("table_cells", table_path=path, r=rows, c=c, span=1, text=text)
                    rows, cells, held = rows + 1, [], []
                else:
                    held.append(self.paragraph(story, [*path, rows, len(cells), len(held)], at, end, style, props))
                    if m[0] == "\x07":
                        cells.append("\n".join(held))
                        held = []
            else:
                path = None
                self.paragraph(story, [k], at, end, style, props)
                k += 1
            at = end + 1
        if at < b:
            self.paragraph(story, [k], at, b, None, {})

    def paragraph(self, story: str, path: list[int], a: int, b: int, style: str | None, props: dict) -> str:
        row = self.out.add("blocks", story=story, path=path, section_idx=0, kind="paragraph", style_id=style, **props)
        shown, pos, fields = "", 0, []
        for text, look in self.segments(a, b):
            for part in re.split("([\x13\x14\x15])", text):
                if part == "\x13":
                    fields.append("")
                elif part == "\x14" and fields:
                    fields[-1] = None
                elif part == "\x15" and fields:
                    fields.pop()
                elif fields and fields[-1] is not None:
                    fields[-1] += part
                elif part := re.sub("[\x00-\x08\x0c\x0e-\x1f]", "", part).replace("\x0b", "\n"):
                    self.out.add("inlines", path=path, pos=pos, kind="text", text=part, **look)
                    pos += 1
                    shown += "" if look.get("hidden") else part
        row["text"] = shown
        return shown

    def segments(self, a: int, b: int) -> Iterator[tuple[str, dict]]:
        """Stretches of equal formatting; neighbours with equal properties are one."""
        held, look = "", None
        while a < b:
            place, width, left = self.offset(a)
            end, raw = self.chars.find(place)
            n = max(1, min(b - a, left, (end - place + width - 1) // width))
            now = char_props(raw)
            if look is not None and now != look:
                yield held, look
                held = ""
            held, look, a = held + self.text[a : a + n], now, a + n
        if look is not None:
            yield held, look


def read_doc(content: bytes) -> Parsed:
    """Body and footnotes of a Word 97 document. Protected and older files are refused."""
    return _Doc(content).read()
