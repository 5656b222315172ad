"""Drawings and pictures of packages as rows: anchors on sheets, shapes on slides, media parts."""

from __future__ import annotations

from quire.sources.containers import Package
from quire.sources.parsed import Parsed
from quire.sources.sniff import jpeg_dimensions
from quire.sources.xmltree import Node, number, on, parse, whole

SHAPES = ("sp", "pic", "cxnSp", "graphicFrame")


def image_kind(data: bytes) -> str | None:
    for magic, kind in ((b"\x89PNG", "png"), (b"\xff\xd8", "jpeg"), (b"GIF", "gif")):
        if data.startswith(magic):
            return kind
    return "svg" if b"<" in data[:512] and b"<svg" in data[:2048] else None


def pixel_size(data: bytes, kind: str) -> tuple[int | None, int | None]:
    if kind == "png" and len(data) >= 24:
        return int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    return (jpeg_dimensions(data) if kind == "jpeg" else None) or (None, None)


def read_media(content: bytes, out: Parsed) -> None:
    """Parts that a relationship calls an image, or that lie in an OpenDocument's Pictures folder,
    if their bytes are those of an image."""
    if content[:2] != b"PK":
        return
    pack = Package(content)
    found = {name for name in pack.names if name.startswith("Pictures/")}
    for name in pack.names:
        folder, _, file = name.rpartition("/")
        if file.endswith(".rels") and (folder == "_rels" or folder.endswith("/_rels")):
            owner = f"{folder[: -len('_rels')]}{file[: -len('.rels')]}"
            found.update(path for kind, path in pack.relationships(owner).values() if kind == "image")
    for name in sorted(found, key=part_order):
        data = pack.part(name)
        if data and (kind := image_kind(data)):
            width, height = pixel_size(data, kind)
            out.add("media", part=name, format=kind, size=len(data), width=width, height=height, data=data)


def part_order(name: str) -> tuple[str, int, str]:
    """Parts of one stem by their number, so that image10 follows image9."""
    stem, dot, extension = name.partition(".")
    digits = len(stem) - len(stem.rstrip("0123456789"))
    return stem[: len(stem) - digits], int(stem[len(stem) - digits :] or -1), dot + extension


def _points(text: str | None) -> float:
    return (number(text) or 0.0) / 12700.0


def _target(shape: Node, rels: dict[str, tuple[str, str]]) -> str | None:
    """The part of a picture or chart."""
    blip = shape.find("blip")
    key = (blip.full("}embed") or blip.get("embed")) if blip is not None else None
    if key is None and (chart := shape.find("chart")) is not None:
        key = chart.full("}id") or chart.get("id")
    return rels[key][1] if key in rels else None


def _words(shape: Node) -> str | None:
    body = shape.child("txBody")
    return "\n".join("".join(t.text() for t in p.walk() if t.name == "t") for p in body.children("p")) if body is not None else None


def read_sheet_drawings(pack: Package, sheet_part: str, sheet_idx: int, out: Parsed) -> None:
    """Anchors of a sheet's drawings: from and to cells (1-based) with offsets, or a place and a size."""
    for path in pack.related(sheet_part, "drawing"):
        raw = pack.part(path)
        rels = pack.relationships(path)
        for anchor in parse(raw).kids if raw else ():
            shape = next((k for k in anchor.kids if k.name in SHAPES), None)
            start, place, end, size = (anchor.child(n) for n in ("from", "pos", "to", "ext"))
            if shape is None or (start is None and place is None) or (end is None and size is None):
                continue
            cell = lambda node, name: whole(node.child(name).text().strip(), 0) + 1 if node is not None and node.child(name) is not None else None
            off = lambda node, name: _points(node.child(name).text().strip()) if node is not None and node.child(name) is not None else 0.0
            out.add(
                "drawings", sheet_idx=sheet_idx, idx=len(out.rows["drawings"]), kind=shape.name, name=(shape.find("cNvPr") or shape).get("name"), part=_target(shape, rels), text=_words(shape),
                from_r=cell(start, "row"), from_c=cell(start, "col"), x=off(start, "colOff") if start is not None else _points(place.get("x")), y=off(start, "rowOff") if start is not None else _points(place.get("y")),
                to_r=cell(end, "row"), to_c=cell(end, "col"), to_x=off(end, "colOff") if end is not None else None, to_y=off(end, "rowOff") if end is not None else None,
                width=_points(size.get("cx")) if end is None else None, height=_points(size.get("cy")) if end is None else None,
            )


Box = tuple[float, float, float, float]


def _box(frame: Node | None, names: tuple[str, str] = ("off", "ext")) -> Box | None:
    if frame is None or frame.child(names[0]) is None or frame.child(names[1]) is None:
        return None
    at, size = frame.child(names[0]), frame.child(names[1])
    return _points(at.get("x")), _points(at.get("y")), _points(size.get("cx")), _points(size.get("cy"))


def read_slide_shapes(tree: Node, slide: int, rels: dict[str, tuple[str, str]], out: Parsed, move: tuple[float, float, float, float] = (1.0, 0.0, 1.0, 0.0)) -> None:
    """Shapes of a slide in points; ``move`` (scale and shift across, scale and shift down) is that of
    the groups around. Shapes without a frame of their own have none here: layouts give it."""
    sx, dx, sy, dy = move
    for shape in tree.kids:
        if shape.name == "AlternateContent":
            chosen = shape.child("Choice") or shape.child("Fallback")
            if chosen is not None:
                read_slide_shapes(chosen, slide, rels, out, move)
            continue
        about = next((n for n in shape.walk() if n.name == "cNvPr"), None)
        if about is not None and on(about.get("hidden"), False):
            continue
        if shape.name == "grpSp":
            frame = shape.child("grpSpPr", "xfrm")
            outer, inner = _box(frame), _box(frame, ("chOff", "chExt"))
            within = move
            if outer and inner:
                gx, gy = outer[2] / inner[2] if inner[2] else 1.0, outer[3] / inner[3] if inner[3] else 1.0
                within = (sx * gx, dx + sx * (outer[0] - inner[0] * gx), sy * gy, dy + sy * (outer[1] - inner[1] * gy))
            read_slide_shapes(shape, slide, rels, out, within)
        elif shape.name in SHAPES:
            box = _box(shape.child("spPr", "xfrm") or shape.child("xfrm"))
            x, y, width, height = (sx * box[0] + dx, sy * box[1] + dy, sx * box[2], sy * box[3]) if box else (None,) * 4
            out.add(
                "drawings", section_idx=slide, idx=len(out.rows["drawings"]), kind=shape.name, name=about.get("name") if about is not None else None, part=_target(shape, rels), text=_words(shape),
                x=x, y=y, width=width, height=height,
            )


