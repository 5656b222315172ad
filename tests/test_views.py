"""Views straight from the parse stage: one table, its rows in batches, the same as from whole documents."""

import builders as B
import pytest

from quire.sources import read
from quire.sources.parsed import PACKED_ROWS, TABLES, Wanted

FILES = {
    "a.xlsx": B.xlsx(), "b.docx": B.docx(), "c.pptx": B.pptx(), "d.fods": B.fods(), "e.fodt": B.fodt(), "f.fodp": B.fodp(), "g.xls": B.xls(), "h.doc": B.doc(), "i.md": B.MARKDOWN.encode(), "j.ods": B.chart_ods(),
    "bad.docx": b"PK\3\4garbage", "cut.fods": B.fods()[:300],
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in FILES.items()], "path string, content binary")


@pytest.fixture(scope="module")
def whole(files):
    return read.parse_files(files).cache()


@pytest.mark.parametrize("name", list(TABLES))
def test_view_equals_whole_documents(files, whole, name):
    straight = read.view(read.parse_files(files), name)
    assert "Generate" not in straight._jdf.queryExecution().executedPlan().toString()
    held = read.view(whole, name)
    assert straight.schema == held.schema
    assert sorted(map(str, straight.collect())) == sorted(map(str, held.collect()))


def test_some_tables_of_whole_documents(files, whole):
    some = read.parse_files(files, tables=("table_cells", "sheets"))
    assert some.columns == ["doc_id", "format", "status", "error", "default_tab", "table_cells", "sheets"]
    assert sorted(map(str, some.collect())) == sorted(map(str, whole.select(*some.columns).collect()))


def test_other_tables_are_not_kept():
    _, _, parsed = read.parse_one("xlsx", FILES["a.xlsx"], wanted=Wanted(frozenset(["cond_rules"])))
    assert parsed.rows["cond_rules"] and not parsed.rows["cells"] and not parsed.rows["xfs"]


@pytest.mark.parametrize("kind, table", [("fods", "cells"), ("md", "blocks")])
def test_rows_of_a_large_document_are_packed_on_the_way(kind, table):
    n = 5 * PACKED_ROWS + 3
    if kind == "fods":
        content = f'<office:document {B.OFFICE} office:mimetype="x.spreadsheet"><office:body><office:spreadsheet><table:table>' + '<table:table-row><table:table-cell office:value-type="float" office:value="1"/></table:table-row>' * n + "</table:table></office:spreadsheet></office:body></office:document>"
    else:
        content = "- x\n" * n
    seen = []
    status, error, parsed = read.parse_one(kind, content.encode(), wanted=Wanted(frozenset([table]), lambda _, rows: seen.append(len(rows)) or rows))
    assert (status, error) == (0, None) and parsed.count(table) == n
    assert seen == [PACKED_ROWS] * 4 and len(parsed.rows[table]) < 2 * PACKED_ROWS
    if kind == "fods":
        assert [r["r"] for part in (*parsed.packed[table], parsed.rows[table]) for r in part] == list(range(1, n + 1))
