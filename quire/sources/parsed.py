"""The normalized tables that readers fill, and their Spark schema."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field

PAGE = "width double, height double, top double, right double, bottom double, left double"
FONT = "font string, size double, bold boolean, italic boolean, underline boolean, strike boolean, color string, fill string"
TABLES: dict[str, str] = {
    "sections": f"section_idx int, {PAGE}, columns int, column_gap double, title_page boolean, page_start long, page_format string, header string, footer string",
    "blocks": "story string, path array<int>, section_idx int, kind string, style_id string, outline int, num_id string, list_level int, align string, before double, after double, mark_deleted boolean, text string",
    "inlines": "path array<int>, pos int, kind string, text string, style_id string, bold boolean, italic boolean, underline boolean, strike boolean, size double, color string, hidden boolean, link string",
    "table_cells": "table_path array<int>, r int, c int, span int, vmerge string, shading string, text string, top string, right string, bottom string, left string",
    "table_lines": "table_path array<int>, top string, right string, bottom string, left string, inside_h string, inside_v string",
    "styles": "style_id string, parent_id string, kind string, name string, is_default boolean, bold boolean, italic boolean, size double, color string, align string, before double, after double, num_id string, list_level int",
    "list_levels": "abstract_id string, level int, start long, format string, text string, legal boolean",
    "list_instances": "num_id string, abstract_id string, overrides map<int, long>",
    "sheets": "sheet_idx int, name string, state string, default_row_height double, default_col_width double, r1 int, c1 int, r2 int, c2 int",
    "page_options": "sheet_idx int, paper int, landscape boolean, scale double, fit_to_page boolean, fit_width int, fit_height int, over_then_down boolean, top double, right double, bottom double, left double, header_margin double, footer_margin double, header string, footer string, print_area string",
    "breaks": "sheet_idx int, axis string, after int",
    "sheet_rows": "sheet_idx int, r int, height double, hidden boolean",
    "col_specs": "sheet_idx int, ordinal int, c_min int, c_max int, width double, hidden boolean",
    "cells": "sheet_idx int, r int, c int, kind string, num double, txt string, flag boolean, xf int",
    "merges": "sheet_idx int, ordinal int, r1 int, c1 int, r2 int, c2 int",
    "cond_rules": "sheet_idx int, ordinal int, r1 int, c1 int, r2 int, c2 int, origin_r int, origin_c int, priority long, kind string, operator string, formulas array<string>, text string, dxf int",
    "xfs": f"idx int, num_fmt string, align string, valign string, wrap boolean, indent double, {FONT}, borders array<struct<side: string, style: string, color: string>>",
    "dxfs": f"idx int, num_fmt string, {FONT}",
    "comments": "sheet_idx int, r int, c int, author string, text string",
    "charts": "chart_id string, kind string, title string",
    "chart_points": "chart_id string, series_idx int, series_name string, pos int, category string, value double",
    "media": "part string, format string, size long, width int, height int, data binary",
    "drawings": "section_idx int, sheet_idx int, idx int, kind string, name string, x double, y double, width double, height double, from_r int, from_c int, to_r int, to_c int, to_x double, to_y double, part string, text string",
}


def _fields(ddl: str) -> list[str]:
    out, depth, word = [], 0, ""
    for c in ddl + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(word.split()[0])
            word = ""
        else:
            word += c
    return out


FIELDS = {name: _fields(ddl) for name, ddl in TABLES.items()}


def _struct(ddl: str) -> str:
    out, depth, word = [], 0, ""
    for c in ddl + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = word.strip().split(" ", 1)
            out.append(f"{name}: {kind}")
            word = ""
        else:
            word += c
    return ", ".join(out)


def schema_of(tables: Iterable[str] = TABLES) -> str:
    """The Spark schema of parsed documents with these tables."""
    return ", ".join(["doc_id string, format string, status int, error string, default_tab double", *(f"{name} array<struct<{_struct(TABLES[name])}>>" for name in tables)])


SCHEMA = schema_of()


#: What readers need of their own rows to fill other tables.
NEEDED = {"table_cells": ("blocks",)}
#: Rows that are packed at once, of tables whose rows a reader does not look at again.
PACKED_ROWS = 8192


@dataclass(frozen=True)
class Wanted:
    """The tables that a caller will read; ``pack`` turns rows of the one into what takes less room."""

    tables: frozenset[str]
    pack: Callable[[str, list[dict]], object] | None = None


_WANTED: ContextVar[Wanted | None] = ContextVar("wanted", default=None)


@contextmanager
def wanting(wanted: Wanted | None) -> Iterator[None]:
    token = _WANTED.set(wanted)
    try:
        yield
    finally:
        _WANTED.reset(token)


@dataclass
class Parsed:
    """Rows of one document. ``add`` fills columns that are not named with null.

    Under ``wanting``, rows of other tables are not kept. Readers name in ``flowing`` the tables whose
    rows they change no more once the next ones come: they are packed on the way.
    """

    default_tab: float | None = None
    rows: dict[str, list[dict]] = field(default_factory=lambda: {t: [] for t in TABLES})
    packed: dict[str, list] = field(default_factory=dict)
    flowing: tuple[str, ...] = ()
    wanted: Wanted | None = field(default_factory=_WANTED.get)

    def __post_init__(self) -> None:
        self.packs = frozenset(self.flowing) & self.wanted.tables if self.wanted is not None and self.wanted.pack else frozenset()
        self.kept = None if self.wanted is None else {"page_options"}.union(self.wanted.tables, *(NEEDED.get(t, ()) for t in self.wanted.tables))

    def wants(self, *tables: str) -> bool:
        return self.wanted is None or not self.wanted.tables.isdisjoint(tables)

    def count(self, table: str) -> int:
        return len(self.rows[table]) + sum(map(len, self.packed.get(table, ())))

    def add(self, table: str, **values) -> dict:
        if self.kept is not None and table not in self.kept:
            return values
        if table in self.packs and len(self.rows[table]) >= 2 * PACKED_ROWS:
            self.packed.setdefault(table, []).append(self.wanted.pack(table, self.rows[table][:PACKED_ROWS]))
            del self.rows[table][:PACKED_ROWS]
        row = dict.fromkeys(FIELDS[table])
        known = len(row)
        row.update(values)
        if len(row) != known:
            raise KeyError(f"{table} has no {values.keys() - set(FIELDS[table])}")
        self.rows[table].append(row)
        return row
