"""Cell styles of sheets: fonts, fills, borders and alignment by format index, and differential formats."""

from __future__ import annotations

import colorsys
import re
import struct

from quire.functions.numfmt import BUILTIN
from quire.functions.scalars import PALETTE, POINTS
from quire.sources.parsed import Parsed
from quire.sources.xmltree import Node, number, on, whole

#: Theme colours in the order of their numbers.
THEME = ("lt1", "dk1", "lt2", "dk2", "accent1", "accent2", "accent3", "accent4", "accent5", "accent6", "hlink", "folHlink")
#: Border styles of binary workbooks by number.
LINES = (
    None, "thin", "medium", "dashed", "dotted", "thick", "double", "hair", "mediumDashed", "dashDot", "mediumDashDot", "dashDotDot", "mediumDashDotDot", "slantDashDot",
)
SIDES = ("top", "right", "bottom", "left")
BASE_FONT = {"font": "Calibri", "size": 11.0, "color": "#000000"}


def tinted(hexed: str | None, amount: float) -> str | None:
    """A colour with its lightness moved towards white (above 0) or black (below)."""
    if hexed is None or not amount:
        return hexed
    h, light, s = colorsys.rgb_to_hls(*(int(hexed[k : k + 2], 16) / 255 for k in (1, 3, 5)))
    light = light * (1 + amount) if amount < 0 else light * (1 - amount) + amount
    return "#" + "".join(f"{min(255, max(0, int(v * 255 + 0.5))):02x}" for v in colorsys.hls_to_rgb(h, light, s))


def indexed(k: int) -> str | None:
    return {64: "#000000", 65: "#ffffff"}.get(k, f"#{PALETTE[k].lower()}" if 0 <= k < len(PALETTE) else None)


# OOXML -------------------------------------------------------------------------------------------

def theme_colours(root: Node | None) -> dict[str, str]:
    scheme = root.find("clrScheme") if root is not None else None
    out = {}
    for entry in scheme.kids if scheme is not None else ():
        for kid in entry.kids:
            value = kid.get("lastClr") if kid.name == "sysClr" else kid.get("val")
            if re.fullmatch("[0-9A-Fa-f]{6}", value or ""):
                out[entry.name] = f"#{value.lower()}"
    return out


def _colour(node: Node | None, theme: dict[str, str]) -> str | None:
    if node is None:
        return None
    if (rgb := node.get("rgb")) is not None:
        base = f"#{rgb[-6:].lower()}" if re.fullmatch("([0-9A-Fa-f]{2})?[0-9A-Fa-f]{6}", rgb) else None
    elif (k := whole(node.get("theme"))) is not None:
        base = theme.get(THEME[k], ("#ffffff", "#000000")[k % 2]) if 0 <= k < len(THEME) else None
    else:
        base = indexed(whole(node.get("indexed"), -1))
    return tinted(base, number(node.get("tint")) or 0.0)


def _font(node: Node | None, theme: dict[str, str], base: dict) -> dict:
    out = dict(base)
    for c in node.kids if node is not None else ():
        if c.name == "sz":
            out["size"] = number(c.get("val"))
        elif c.name in ("name", "rFont"):
            out["font"] = c.get("val")
        elif c.name in ("b", "i", "strike"):
            out[{"b": "bold", "i": "italic", "strike": "strike"}[c.name]] = on(c.get("val"), True)
        elif c.name == "u":
            out["underline"] = c.get("val") != "none"
        elif c.name == "color":
            out["color"] = _colour(c, theme) or out.get("color")
    return out


def _pattern_fill(fill: Node, theme: dict[str, str]) -> str | None:
    pattern = fill.child("patternFill")
    kind = pattern.get("patternType", "none") if pattern is not None else "none"
    if kind == "none":
        return None
    front, back = (_colour(pattern.child(n), theme) for n in ("fgColor", "bgColor"))
    return (front or back) if kind == "solid" else tinted(front, 0.5) or back


def _borders(node: Node, theme: dict[str, str]) -> list[dict]:
    sides = [(side, node.child(side)) for side in SIDES]
    return [{"side": side, "style": n.get("style"), "color": _colour(n.child("color"), theme)} for side, n in sides if n is not None and n.get("style", "none") != "none"]


#: Alignments that stand for others.
ALIGN = {"center": "center", "centerContinuous": "center", "right": "right", "left": "left", "justify": "justify", "distributed": "justify"}
VALIGN = {"top": "top", "center": "center", "justify": "center", "distributed": "center"}


def read_xlsx_styles(root: Node | None, theme_root: Node | None, out: Parsed) -> list[bool]:
    """Fill ``xfs`` and ``dxfs``; whether each format has a fill or a border."""
    if root is None:
        return []
    theme = theme_colours(theme_root)
    part = lambda name, kid: root.child(name).children(kid) if root.child(name) is not None else []
    fonts = [_font(f, theme, BASE_FONT) for f in part("fonts", "font")] or [BASE_FONT]
    fills = [_pattern_fill(f, theme) for f in part("fills", "fill")]
    borders = [_borders(b, theme) for b in part("borders", "border")]
    codes = BUILTIN | {whole(f.get("numFmtId"), -1): f.get("formatCode", "General") for f in part("numFmts", "numFmt")}
    formatted = []
    for k, xf in enumerate(part("cellXfs", "xf")):
        at = lambda name, xf=xf: whole(xf.get(name), 0)
        look = xf.child("alignment")
        get = look.get if look is not None else lambda name: None
        fill = fills[at("fillId")] if at("fillId") < len(fills) else None
        lines = borders[at("borderId")] if at("borderId") < len(borders) else []
        out.add(
            "xfs", idx=k, num_fmt=codes.get(at("numFmtId"), "General"), align=ALIGN.get(get("horizontal")), valign=VALIGN.get(get("vertical"), "bottom"),
            wrap=bool(on(get("wrapText"), False)), indent=9.0 * (number(get("indent")) or 0.0), fill=fill, borders=lines, **fonts[min(at("fontId"), len(fonts) - 1)],
        )
        formatted.append(fill is not None or bool(lines))
    for k, dxf in enumerate(part("dxfs", "dxf")):
        code, pattern = dxf.child("numFmt"), dxf.child("fill", "patternFill")
        fill = (_colour(pattern.child("bgColor"), theme) or _colour(pattern.child("fgColor"), theme)) if pattern is not None else None
        out.add("dxfs", idx=k, num_fmt=code.get("formatCode") if code is not None else None, fill=fill, **_font(dxf.child("font"), theme, {}))
    return formatted


# BIFF8 -------------------------------------------------------------------------------------------

class BiffStyles:
    """Fonts, formats and the palette of a binary workbook, collected from its records."""

    KINDS = (0x0031, 0x0092, 0x00E0)

    def __init__(self) -> None:
        self.fonts: list[tuple] = []
        self.formats: list[bytes] = []
        self.palette: dict[int, str] = {}

    def take(self, kind: int, body: bytes) -> None:
        if kind == 0x0031:
            height, flags, colour, weight, _, underline = struct.unpack_from("<HHHHHB", body)
            n, wide = body[14], body[15] & 1
            name = body[16 : 16 + n * (1 + wide)].decode("utf-16-le" if wide else "latin-1", "replace")
            self.fonts.append((name, height / 20, weight >= 600, bool(flags & 2), bool(flags & 8), underline != 0, colour))
        elif kind == 0x0092:
            for k in range(struct.unpack_from("<H", body)[0]):
                self.palette[8 + k] = "#" + body[2 + 4 * k : 5 + 4 * k].hex()
        else:
            self.formats.append(body)

    def colour(self, k: int) -> str | None:
        return self.palette.get(k) or indexed(k)

    def fill(self, out: Parsed, codes: dict[int, str]) -> list[bool]:
        """Fill ``xfs``; whether each format has a fill or a border."""
        formatted = []
        for k, body in enumerate(self.formats):
            font_at, code = struct.unpack_from("<HH", body)
            values: dict = {}
            font_at -= font_at > 4  # there is no font 4
            if font_at < len(self.fonts):
                name, size, bold, italic, strike, underline, colour = self.fonts[font_at]
                values = {"font": name, "size": size, "bold": bold, "italic": italic, "strike": strike, "underline": underline, "color": self.colour(colour) or "#000000"}
            fill, lines, look, indent = None, [], 0, 0
            if len(body) >= 20:
                look, _, more = body[6], body[7], body[8]
                indent = more & 15
                sides, bottom, ground = struct.unpack_from("<IIH", body, 10)
                parts = {
                    "top": (sides >> 8 & 15, bottom & 127), "right": (sides >> 4 & 15, sides >> 23 & 127),
                    "bottom": (sides >> 12 & 15, bottom >> 7 & 127), "left": (sides & 15, sides >> 16 & 127),
                }
                lines = [{"side": s, "style": LINES[n] if n < len(LINES) else "thin", "color": self.colour(c)} for s, (n, c) in parts.items() if n]
                pattern = bottom >> 26 & 63
                front, back = self.colour(ground & 127), self.colour(ground >> 7 & 127)
                fill = None if not pattern else (front or back) if pattern == 1 else tinted(front, 0.5) or back
            out.add(
                "xfs", idx=k, num_fmt=codes.get(code, "General"), align={1: "left", 2: "center", 3: "right", 5: "justify", 6: "center", 7: "justify"}.get(look & 7),
                valign={0: "top", 1: "center", 3: "center", 4: "center"}.get(look >> 4 & 7, "bottom"), wrap=bool(look & 8), indent=9.0 * indent, fill=fill, borders=lines, **values,
            )
            formatted.append(fill is not None or bool(lines))
        return formatted


# OpenDocument ------------------------------------------------------------------------------------

def _points(text: str | None) -> float | None:
    m = re.fullmatch(r"\s*([0-9.]+)\s*([a-z]+)\s*", text or "")
    value = number(m[1]) if m else None
    return value * POINTS[m[2]] if value is not None and m[2] in POINTS else None


def _odf_border(text: str | None) -> tuple[str, str | None] | None:
    """(style, colour) of ``0.06pt solid #000000``; none is no border."""
    parts = (text or "none").split()
    if "none" in parts or "hidden" in parts:
        return None
    style = next((p for p in parts if p in ("solid", "double", "dashed", "dotted")), "solid")
    return {"solid": "thin"}.get(style, style), next((p.lower() for p in parts if re.fullmatch("#[0-9A-Fa-f]{6}", p)), None)


def read_odf_styles(root: Node, out: Parsed) -> tuple[dict[str, int], list[bool]]:
    """Fill ``xfs`` from the cell styles; (index by name, whether each has a fill or a border)."""
    nodes = {n.get("name"): n for n in root.walk() if n.name == "style" and n.get("family") == "table-cell" and n.get("name")}
    index, formatted = {}, [False]
    out.add("xfs", idx=0, num_fmt="General", valign="bottom", wrap=False, indent=0.0, borders=[])
    for name in nodes:
        chain, at = [], name
        while at in nodes and len(chain) < 32:
            chain.append(nodes[at])
            at = nodes[at].get("parent-style-name")
        cell: dict[str, str] = {}
        text: dict[str, str] = {}
        para: dict[str, str] = {}
        for style in reversed(chain):  # from the root: what a style sets replaces what it inherits
            for kind, held in (("table-cell-properties", cell), ("text-properties", text), ("paragraph-properties", para)):
                if (props := style.child(kind)) is not None:
                    if kind == "table-cell-properties" and "border" in props.attrs:
                        for side in SIDES:
                            held.pop(f"border-{side}", None)
                    held.update(props.attrs)
        lines = []
        for side in SIDES:
            if found := _odf_border(cell.get(f"border-{side}", cell.get("border"))):
                lines.append({"side": side, "style": found[0], "color": found[1]})
        ground = (cell.get("background-color") or "").lower()
        fill = ground if re.fullmatch("#[0-9a-f]{6}", ground) else None
        out.add(
            "xfs", idx=len(formatted), num_fmt="General", align={"start": "left", "end": "right"}.get(para.get("text-align"), ALIGN.get(para.get("text-align"))),
            valign={"top": "top", "middle": "center"}.get(cell.get("vertical-align"), "bottom"), wrap=cell.get("wrap-option") == "wrap", indent=_points(para.get("margin-left")) or 0.0,
            fill=fill, borders=lines, font=text.get("font-name") or text.get("font-family"), size=_points(text.get("font-size")), bold=text["font-weight"] in ("bold", "700", "800", "900") if "font-weight" in text else None,
            italic=text["font-style"] in ("italic", "oblique") if "font-style" in text else None, underline=text["text-underline-style"] != "none" if "text-underline-style" in text else None,
            strike=text["text-line-through-style"] != "none" if "text-line-through-style" in text else None, color=text.get("color"),
        )
        index[name] = len(formatted)
        formatted.append(fill is not None or bool(lines))
    return index, formatted
