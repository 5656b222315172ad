"""What leaves the engine: views as Parquet by table, pages and reports as JSON lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from quire.sources.parsed import TABLES
from quire.sources.read import view


def write_views(parsed: DataFrame, folder: str, tables: Sequence[str] = tuple(TABLES), mode: str = "error") -> None:
    """Each table of parsed documents below ``folder``, and the documents with their status."""
    unknown = set(tables) - set(TABLES)
    if unknown:
        raise ValueError(f"no such tables: {sorted(unknown)}")
    parsed.select("doc_id", "format", "status", "error", "default_tab").write.mode(mode).parquet(f"{folder}/documents")
    for name in tables:
        view(parsed, name).write.mode(mode).parquet(f"{folder}/{name}")


def write_report(rows: DataFrame, path: str, mode: str = "error") -> None:
    """Pages or report rows as JSON lines; nulls are written, so that every line has every field."""
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)
