"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table of the token counts of frequent pre-tokens, of at most
``table_size`` entries of at most ``longest`` characters (a fixed bound, whatever the corpus).
Tier two is each worker's own cache: a pre-token that the table lacks is encoded once by the
library and remembered, in two generations of ``cache_size`` entries. Counts are sums over
pre-tokens, so the corpus's pre-tokens are never shuffled: the count is one scan and one map.

The table is drawn from a sample of about ``table_docs`` documents; only theirs are grouped. It
only decides what is looked up where: whatever it holds, every count is the library's. Texts with
characters outside the fast pattern's range, or with special strings, are counted by the library
itself.

Defined cases: null and empty texts have 0 bytes and 0 tokens; very long texts are cut where no
pre-token can span and read to the end; repeated rows are counted each; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import mapped, worker_state
from quire.llm.pretokens import PATTERN, Cache, Coder, pieces

class _Lengths:
    """Counts the tokens of texts: the frequent table, then what this worker has encoded."""

    def __init__(self, path: str, table: dict[str, int], most: int) -> None:
        self.coder = Coder(path)
        self.lengths = Cache(lambda piece: len(self.coder.pre_token(piece)), table, most)

    def count(self, text: str) -> int:
        total = 0
        for part in pieces(text):
            if self.coder.plain(part):
                total += sum(map(self.lengths.__getitem__, PATTERN.findall(part)))
            else:
                total += len(self.coder.whole(part))
        return total


def frequent_table(documents: DataFrame, path: str, *, text: str = "text", table_docs: int = 2000, table_size: int = 32768, longest: int = 48) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens of a sample of about ``table_docs`` documents."""
    share = min(1.0, table_docs / max(1, documents.count()))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        coder = Coder(path)
        for batch in batches:
            for value in batch.column(0):
                for part in pieces(value.as_py() or ""):
                    if coder.plain(part):
                        seen.update(x for x in PATTERN.findall(part) if len(x) <= longest)
        kept = list(seen)
        tokens = [len(coder.pre_token(x)) for x in kept]
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array([seen[x] for x in kept], pa.int64()), pa.array(tokens, pa.int64())], names=["piece", "seen", "n"])

    sample = documents.selectExpr(f"`{text}` text").sample(False, share, 17)
    found = mapped(sample, counted, "piece string, seen long, n long").groupBy("piece", "n").agg(F.sum("seen").alias("seen"))
    rows = found.orderBy(F.desc("seen"), "piece").limit(table_size).collect()
    return {r["piece"]: r["n"] for r in rows}


def token_counts(
    documents: DataFrame,
    path: str,
    *,
    limit: int = 1024,
    doc_id: str = "doc_id",
    text: str = "text",
    table: dict[str, int] | None = None,
    cache_size: int = 200_000,
) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (more tokens than ``limit``)."""
    spark = documents.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_table(documents, path, text=text) if table is None else table)
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = ("lengths", path, cache_size, hash(frozenset(frequent.value.items())))
        lengths = worker_state(key, lambda: _Lengths(path, frequent.value, cache_size))
        for batch in batches:
            sizes, counts = [], []
            for value in batch.column(1):
                t = value.as_py() or ""
                sizes.append(len(t.encode("utf-8", "surrogatepass")))
                counts.append(lengths.count(t))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return mapped(documents.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"`{text}` text"), count, schema)
