"""Every query with SQL against DuckDB, and the entry module without its optional parts."""

import glob
import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("QUIRE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
PLAIN = sorted(set(entry.oracle_sql()) & set().union(*(m.QUERIES for m in (entry.sheets, entry.documents, entry.readers, entry.values))))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(v):
    v = v.item() if hasattr(v, "item") else v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.12g}")
    return v


def sorted_rows(rows, order):
    return sorted(([plain(r[k]) for k in order] for r in rows), key=str)


@pytest.mark.parametrize("name", PLAIN)
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    found = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted_rows(df.collect(), sorted(columns)) == sorted_rows([dict(zip(columns, r, strict=True)) for r in found.fetchall()], sorted(columns))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_the_optional_parts(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    os.makedirs(tmp_path / "quire")
    for name in os.listdir(f"{root}/quire"):
        if name != "llm" and not name.startswith("__pycache__"):
            os.symlink(f"{root}/quire/{name}", tmp_path / "quire" / name)
    os.symlink(f"{root}/__spark_entry__.py", tmp_path / "__spark_entry__.py")
    code = "import sys; sys.path = [p for p in sys.path if p not in ('', %r)]; sys.path.insert(0, %r); import importlib.util as u; s = u.spec_from_file_location('__spark_entry__', %r); m = u.module_from_spec(s); s.loader.exec_module(m); print(len(m.queries()), [q for q in m.queries() if q.startswith('op') or q == 'pipeline'])"
    out = subprocess.run([sys.executable, "-c", code % (root, str(tmp_path), str(tmp_path / "__spark_entry__.py"))], capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}, cwd=tmp_path)
    assert out.stdout.strip().endswith("[]"), out.stderr
