"""OpenDocument charts: series and categories as ranges of the chart's own table."""

from __future__ import annotations

import re

from quire.functions.numfmt import general_text
from quire.sources.containers import Package
from quire.sources.parsed import Parsed
from quire.sources.spreadsheets import area
from quire.sources.xmltree import Node, number, parse, whole

#: Kinds by chart class; bars lie or stand by the plot's style.
KINDS = {"bar": "column", "line": "line", "scatter": "line", "radar": "line", "filled-radar": "line", "stock": "line", "circle": "pie", "ring": "pie", "area": "area"}
#: Fixed value: the most columns that a repeated cell stands for.
REPEAT = 256


class _Grid:
    """The local table: cells as (number, text); ``marks`` says where a foreign range starts in it."""

    def __init__(self, table: Node | None) -> None:
        self.rows: list[list[tuple[float | None, str]]] = []
        self.marks: dict[str, tuple[int, int]] = {}
        if table is not None:
            self._read(table)

    def _read(self, node: Node) -> None:
        for c in node.kids:
            if c.name in ("table-header-rows", "table-rows", "table-row-group"):
                self._read(c)
            elif c.name == "table-row":
                row: list[tuple[float | None, str]] = []
                for cell in c.children("table-cell"):
                    said = cell.child("g", "desc")
                    for name in said.text().split() if said is not None else ():
                        self.marks[name] = (len(self.rows), len(row))
                    value = (number(cell.get("value")), " ".join(p.text() for p in cell.children("p")))
                    row += [value] * min(whole(cell.get("number-columns-repeated"), 1), REPEAT)
                self.rows.append(row)

    def cells(self, address: str | None) -> list[tuple[float | None, str]]:
        """Cells of a range: down the local table, or from its mark on, down or across."""
        name = (address or "").split(" ")[0]
        box = area(re.sub(r"(^|:)[^:]*?\.(?=\$?[A-Za-z])", r"\1", name))
        if box is None:
            return []
        r1, c1, r2, c2 = box
        n, start, down = (r2 - r1 + 1) * (c2 - c1 + 1), (r1 - 1, c1 - 1), True
        if not name.startswith("local-table") and name in self.marks:
            start, down = self.marks[name], c1 == c2
        out = []
        for k in range(n):
            r, c = (start[0] + k, start[1]) if down else (start[0], start[1] + k)
            out.append(self.rows[r][c] if r < len(self.rows) and c < len(self.rows[r]) else (None, ""))
        return out


def read_odf_chart(root: Node, chart_id: str, out: Parsed) -> None:
    chart = root.find("chart") if root.find("body") is None else root.find("body").child("chart", "chart")
    plot = chart.child("plot-area") if chart is not None else None
    kind = KINDS.get((chart.get("class") or "").removeprefix("chart:")) if chart is not None else None
    if plot is None or kind is None:
        return
    style = next((s for s in root.walk() if s.name == "style" and s.get("name") == plot.get("style-name")), None)
    if kind == "column" and style is not None and style.child("chart-properties") is not None and style.child("chart-properties").get("vertical") == "true":
        kind = "bar"
    grid = _Grid(chart.child("table"))
    categories: list[str] = []
    for axis in plot.children("axis"):
        if axis.get("dimension") == "x" and axis.child("categories") is not None:
            categories = [t or ("" if v is None else general_text(v)) for v, t in grid.cells(axis.child("categories").get("cell-range-address"))]
    series = []
    for s in plot.children("series"):
        label = grid.cells(s.get("label-cell-address"))
        series.append((label[0][1] or None if label else None, [v for v, _ in grid.cells(s.get("values-cell-range-address"))]))
    if not series:
        return
    size = max([len(categories), *(len(v) for _, v in series)])
    categories += [str(k + 1) for k in range(len(categories), size)]
    title = chart.child("title")
    out.add("charts", chart_id=chart_id, kind=kind, title=" ".join(p.text() for p in title.children("p")) or None if title is not None else None)
    for k, (name, values) in enumerate(series):
        for pos in range(size):
            out.add("chart_points", chart_id=chart_id, series_idx=k, series_name=name, pos=pos + 1, category=categories[pos], value=values[pos] if pos < len(values) else None)


def read_package_charts(content: bytes, out: Parsed) -> None:
    """Charts embedded in a packed document, by name."""
    if content[:2] != b"PK":
        return
    pack = Package(content)
    for name in sorted(n for n in pack.names if re.fullmatch(r"(?:[^/]+/)+content\.xml", n)):
        root = parse(pack.part(name) or b"<x/>")
        if any(n.name == "plot-area" for n in root.walk()):
            read_odf_chart(root, name, out)
