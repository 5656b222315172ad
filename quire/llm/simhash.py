"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at 3 or fewer differing bits: cut the 64 bits into three blocks; unless the
fingerprints are equal, some block holds a difference, and without that block at most 2 differing
bits are left. So every distinct fingerprint emits, for each block left out, all variants of the
remaining bits within half that distance (itself and each single flip: 131 variants in all). Two
linked fingerprints meet at one variant at least. Rows are dealt by variant, sorted, and the pairs
that meet are verified on all 64 bits.

Equal fingerprints are grouped before anything is emitted, so a group of exact copies costs one
fingerprint however large it is. Inside a variant's group no pairs are listed: each member is
compared once with the members not yet reached, and only links that join two components of what
the task remembers (a bounded number of fingerprints) leave it. Components are then found by alternating large-star and small-star
rounds over staged tables; no link, label or fingerprint list goes to the driver.

Defined cases: null and empty texts have fingerprint zero and link like any other; repeated rows
get the same answer each; a component whose doc_ids are all null has a null component_id; an empty
table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import mapped, own_name, release, staged, tasks_for

RADIUS = 3
#: Bits of the three blocks, lowest first.
BLOCKS = ((0, 22), (22, 43), (43, 64))
SEED = 42
#: Bytes of fingerprints for one task; their variants are about 260 times as much.
TASK_BYTES = 1 << 20


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: str | None, shingle: int = 3, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of one text's word shingles (repeats count)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lowers A-Z only
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.empty(n, np.int64)
    starts[0], starts[1:] = 0, ends[:-1] + 1
    k = min(shingle, n)
    first, last = starts[: n - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    m = len(first)
    h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(first, last, strict=True)), np.uint64, m)
    ones = np.zeros(64, np.int64)
    for at in range(0, m, 8192):
        part = h[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.flatnonzero(2 * ones > m)
    return int(sum(1 << int(b) for b in bits))


def with_fingerprints(documents: DataFrame, text: str, name: str, shingle: int = 3) -> DataFrame:
    """All rows and columns of ``documents`` plus the fingerprint as a signed long."""
    schema = documents.selectExpr("*", f"cast(0 as long) `{name}`").schema
    at = documents.columns.index(text)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_signed(fingerprint(v.as_py(), shingle)) for v in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.int64())], names=[*batch.schema.names, name])

    return mapped(documents, add, schema)


def _variants(fp: str) -> str:
    """SQL for the array of a fingerprint's variants, each block's marked by bits of its own."""
    parts = []
    for k, (low, high) in enumerate(BLOCKS):
        kept = ((1 << 64) - 1) ^ (((1 << (high - low)) - 1) << low)
        mark = (k + 1) << low  # in the bits that are left out
        flips = [0, *[1 << i for i in range(64) if not low <= i < high]]
        table = ",".join(f"{_signed(x)}L" if _signed(x) != -(1 << 63) else "(-9223372036854775807L - 1L)" for x in flips)
        base = f"(({fp} & {_signed(kept)}L) | {_signed(mark)}L)"
        parts.append(f"transform(array({table}), d -> {base} ^ d)")
    return f"concat({', '.join(parts)})"


class _Forest:
    """Union-find over fingerprints of one task; says whether a link joins two components.

    It forgets all when it holds ``most``; what it then lets through again costs rows, not results.
    """

    def __init__(self, most: int = 1 << 20) -> None:
        self.up: dict[int, int] = {}
        self.most = most

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (nxt := up.get(top, top)) != top:
            top = nxt
        while (nxt := up.get(x, x)) != top:
            up[x] = top
            x = nxt
        return top

    def join(self, x: int, y: int) -> bool:
        a, b = self.root(x), self.root(y)
        if a == b:
            return False
        if len(self.up) >= self.most:
            self.up.clear()
            a, b = x, y
        self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))
        return True


def _links(members: np.ndarray, forest: _Forest) -> Iterator[tuple[int, int]]:
    """Links that connect what is connected inside one group: at most one per member."""
    rest = members
    while len(rest) > 1:
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            x = stack.pop()
            near = np.bitwise_count(rest ^ x) <= RADIUS
            if near.any():
                for y in (found := rest[near]):
                    if forest.join(int(x), int(y)):
                        yield int(x), int(y)
                stack.extend(found)
                rest = rest[~near]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by variant (key, fp) -> verified links (u, v)."""
    forest = _Forest()
    held_key = held = None

    def flush(pairs: list) -> pa.RecordBatch:
        ends = np.array(pairs, np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, i].copy()) for i in (0, 1)], names=["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        if held is not None:
            key = np.concatenate([np.full(len(held), held_key, np.int64), key])
            fp = np.concatenate([held, fp])
        edges = np.flatnonzero(key[1:] != key[:-1]) + 1
        starts = np.concatenate([[0], edges])
        held_key, held = key[-1], fp[starts[-1] :].copy()  # its group may go on in the next batch
        sizes = np.diff(starts)
        pairs: list[tuple[int, int]] = []
        two = starts[:-1][sizes == 2]
        close = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= RADIUS]
        pairs += [(x, y) for x, y in zip(fp[close].tolist(), fp[close + 1].tolist(), strict=True) if forest.join(x, y)]
        for a, n in zip(starts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            pairs += _links(fp[a : a + n], forest)
        if pairs:
            yield flush(pairs)
    if held is not None and (pairs := list(_links(held, forest))):
        yield flush(pairs)


def links(fingerprints: DataFrame, fp: str) -> DataFrame:
    """Links ``u < v`` between distinct fingerprints that connect all components within RADIUS.

    ``fingerprints`` has one row for each distinct value.
    """
    # The rows grow by two orders of magnitude here, so they are spread over all tasks first.
    tasks = tasks_for(fingerprints, TASK_BYTES)
    rows = fingerprints.repartition(tasks).selectExpr(f"explode({_variants(f'`{fp}`')}) key", f"`{fp}` fp")
    # Sorted by both columns: a task that runs again emits the same links, whatever order it fetched.
    met = mapped(rows.repartition(tasks, "key").sortWithinPartitions("key", "fp"), _meet, "u long, v long")
    return met.selectExpr("least(u, v) u", "greatest(u, v) v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Edges ``u, v`` -> ``node, label`` (smallest node) by large-star and small-star rounds.

    Every round is a grouped minimum and a join on the node, staged to the shared folder; the
    minimum is combined map side, and AQE splits the join where one node has very many links.
    """
    now = staged(edges.where("u <> v").selectExpr("least(u, v) u", "greatest(u, v) v").distinct(), "star")
    mark = None
    while True:
        both = now.select("u", "v").unionByName(now.selectExpr("v u", "u v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) m")
        large = both.where("v > u").join(low, "u").selectExpr("m u", "v").where("u <> v").distinct()
        large = staged(large, "star")
        # Every edge goes to its larger end's smallest neighbour.
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v")
        small = small.selectExpr("m u", "v").unionByName(small.where("u <> m").selectExpr("m u", "u v"))
        before, now = now, staged(small.where("u <> v").distinct(), "star")
        release(before, large)
        seen = tuple(now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())
        if seen == mark or not seen[0]:
            break
        mark = seen
    return now.selectExpr("v node", "u label").unionByName(now.selectExpr("u node", "u label")).distinct()


def component_table(with_fp: DataFrame, doc_id: str, fp: str) -> DataFrame:
    """Distinct ``fp`` -> ``label`` (smallest fingerprint) and ``component_id`` (smallest doc_id)."""
    groups = with_fp.groupBy(F.col(fp).alias("fp")).agg(F.min(F.col(doc_id).cast("long")).alias("first"))
    groups = staged(groups, "fps")
    parts = staged(components(links(groups, "fp")), "parts")
    linked = groups.join(parts, groups.fp == parts.node, "left").select(
        "fp", "first", F.coalesce("label", "fp").alias("label")
    )
    tops = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    return linked.join(tops, "label").select("fp", "label", "component_id")


def near_duplicates(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id."""
    slim = documents.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"`{text}` text")
    prints = staged(with_fingerprints(slim, "text", "fp", shingle).select("doc_id", "fp"), "prints")
    table = staged(component_table(prints, "doc_id", "fp"), "classes")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(table, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def drop_near_duplicates(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """One document of each component stays: the one with the smallest doc_id (null if all are).

    If several rows of a component carry that doc_id, one of them stays. Rows are numbered and staged
    once with their fingerprints; the numbers of those that go are a staged table of their own, so
    Spark broadcasts them only if that table is small, and deals the texts only if it is not.
    """
    fp, row = own_name(documents, "near_fp", "near_row")
    marked = with_fingerprints(documents.withColumn(row, F.monotonically_increasing_id()), text, fp, shingle)
    marked = staged(marked, "marked")
    prints = marked.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(fp).alias("fp"), F.col(row).alias("row"))
    table = staged(component_table(prints, "doc_id", "fp"), "classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    labelled = staged(prints.join(table, "fp").select("label", "doc_id", "row"), "labelled")
    stay = labelled.groupBy("label").agg(first.alias("first")).select("first.row")
    gone = staged(labelled.select("row").join(stay, "row", "left_anti"), "gone")
    return marked.join(gone.withColumnRenamed("row", row), row, "left_anti").select(*documents.columns)
