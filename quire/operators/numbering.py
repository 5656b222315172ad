"""List numbering: counters by level, labels, overrides."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from quire.batches import mapped
from quire.functions.scalars import numeral


def level_counts(items: DataFrame, keys: Sequence[str], order: str, level: str, levels: int = 9, starts: Sequence[int] | None = None) -> DataFrame:
    """``counts``: the counter of every level at each item. A level counts its items since the last
    item of a shallower level; levels deeper than the item stand one below their start."""
    starts = list(starts or [1] * levels)
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = items
    for k in range(levels):
        out = out.withColumn(f"_reset{k}", F.sum((F.col(level) < k).cast("int")).over(w))
    counts = []
    for k in range(levels):
        own = Window.partitionBy(*keys, f"_reset{k}").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        counts.append(F.sum((F.col(level) == k).cast("long")).over(own) + F.lit(starts[k] - 1).cast("long"))
    out = out.withColumn("counts", F.array(*counts))
    return out.drop(*[f"_reset{k}" for k in range(levels)])


def label(counts: Column, template: str, forms: Sequence[str], legal: bool = False) -> Column:
    """``%1.%2`` with each level's counter in its own format; ``legal`` makes all decimal."""
    out: list[Column] = []
    at = 0
    while at < len(template):
        if template[at] == "%" and template[at + 1 : at + 2].isdigit():
            k = int(template[at + 1])
            if 1 <= k <= len(forms):
                out.append(numeral(F.greatest(F.element_at(counts, k), F.lit(0)), "decimal" if legal else forms[k - 1]))
            at += 2
        else:
            out.append(F.lit(template[at]))
            at += 1
    return F.concat(*out) if out else F.lit("")


def counters_with_overrides(items: DataFrame, instances: DataFrame, levels: int = 9) -> DataFrame:
    """Counters of lists whose instances share an abstract list and may restart a level.

    ``items``: doc_id, ord, num_id, level; ``instances``: doc_id, num_id, abstract_id, starts
    (array<long>), overrides (map<int, long>). The first use of an instance's level sets that
    counter to its override, which needs the items in order; all other lists are windows.
    """
    state = instances.withColumn("_plain", F.coalesce(F.size("overrides") < 1, F.lit(True)))
    plain = F.min(F.col("_plain")).over(Window.partitionBy("doc_id", "abstract_id"))
    alike = F.size(F.collect_set("starts").over(Window.partitionBy("doc_id", "abstract_id"))) <= 1
    known = items.join(state.withColumn("_plain", plain & alike), ["doc_id", "num_id"])
    names = items.columns
    schema = StructType([*items.schema.fields, StructField("counts", ArrayType(LongType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, used = None, [], set()
        for batch in batches:
            rows = batch.to_pydict()
            out: list[list[int] | None] = []
            for *this, num_id, level, starts, overrides in zip(*[rows[c] for c in ("doc_id", "abstract_id", "num_id", "level", "starts", "overrides")], strict=True):
                if this != key:
                    key, now, used = this, [x - 1 for x in starts], set()
                k = int(level)
                if k >= len(now):
                    out.append(None)
                    continue
                if (num_id, k) not in used:
                    used.add((num_id, k))
                    given = dict(overrides or ()).get(k)
                    if given is not None:
                        now[k] = given - 1
                now[k] += 1
                now[k + 1 :] = [x - 1 for x in starts[k + 1 :]]
                out.append(list(now))
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], pa.array(out, arrow.field("counts").type)], names=[*names, "counts"])

    # Lists without overrides are windows; a list with some is read in order. A task runs through its lists one
    # after another, with the state of one at a time.
    lists = known.where("not _plain").repartition("doc_id", "abstract_id").sortWithinPartitions("doc_id", "abstract_id", F.asc_nulls_last("ord"))
    held = mapped(lists.select(*names, "abstract_id", "starts", "overrides"), run, schema)
    free = level_counts(known.where("_plain"), ["doc_id", "abstract_id"], "ord", "level", levels)
    counts = F.transform(F.slice("counts", F.lit(1), F.size("starts")), lambda n, k: n + F.get("starts", k) - 1)
    free = free.withColumn("counts", F.when(F.col("level") < F.size("starts"), counts))
    return held.unionByName(free.select(*names, F.col("counts").cast("array<long>").alias("counts")))


def item_numbers(items: DataFrame, keys: Sequence[str], order: str, start: str, name: str = "number") -> DataFrame:
    """One number an item: the list's start, then one more each."""
    w = Window.partitionBy(*keys).orderBy(order)
    return items.withColumn(name, F.col(start) + F.row_number().over(w) - 1)


def auto_numbers(paragraphs: DataFrame, keys: Sequence[str], order: str, level: str, text: str, levels: int = 9) -> DataFrame:
    """Slide numbering: only paragraphs with text count, deeper levels start again."""
    counted = paragraphs.where(F.trim(text) != "")
    return level_counts(counted, keys, order, level, levels)


def running_sections(breaks: DataFrame, keys: Sequence[str], order: str, ends: str, name: str = "section") -> DataFrame:
    """Section of each block: how many section ends stand before it."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return breaks.withColumn(name, F.coalesce(F.sum(F.col(ends).cast("int")).over(before), F.lit(0)))


def inherit_slots(sections: DataFrame, keys: Sequence[str], order: str, slots: Sequence[str]) -> DataFrame:
    """Header and footer slots that a section leaves out are those of the section before."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return sections.withColumns({s: F.last(s, ignorenulls=True).over(w) for s in slots})


def join_deleted_marks(paragraphs: DataFrame, keys: Sequence[str], order: str, deleted: str, text: str) -> DataFrame:
    """A paragraph whose mark is deleted runs on into the next."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    group = F.coalesce(F.sum((~F.col(deleted)).cast("int")).over(before), F.lit(0))
    out = paragraphs.withColumn("_group", group).groupBy(*keys, "_group")
    parts = F.sort_array(F.collect_list(F.struct(order, text)))
    return out.agg(F.min(order).alias(order), F.array_join(F.transform(parts, lambda p: p[text]), "").alias(text)).drop("_group")


def outline_lists(blocks: DataFrame, levels: DataFrame, outline_list: str = "outline") -> DataFrame:
    """Headings without a list take the outline's numbering, at their own level.

    ``blocks``: doc_id, outline (level from 0, null for no heading), num_id, list_level; ``levels``:
    doc_id, level, numbered: which levels of the outline have a number or a bullet.
    """
    numbered = levels.where("numbered").select("doc_id", F.col("level").alias("outline"), F.lit(True).alias("_on")).distinct()
    out = blocks.join(numbered, ["doc_id", "outline"], "left")
    takes = F.col("num_id").isNull() & F.coalesce("_on", F.lit(False))
    return out.withColumns({"num_id": F.when(takes, outline_list).otherwise(F.col("num_id")), "list_level": F.when(takes, F.col("outline")).otherwise(F.col("list_level"))}).select(*blocks.columns)


def visible_numbers(slides: DataFrame, keys: Sequence[str], order: str, shown: str, name: str = "number") -> DataFrame:
    """Slides that are shown, numbered among themselves."""
    w = Window.partitionBy(*keys).orderBy(order)
    return slides.where(shown).withColumn(name, F.row_number().over(w))


def odf_label(counts: Column, level: int, forms: Sequence[str], prefix: str, suffix: str, display_levels: int) -> Column:
    """An OpenDocument label: the last ``display_levels`` counters joined by dots; 0 shows as 1.

    ``counts`` comes from ``level_counts``; a level above that has no item yet stands at its start.
    """
    first = level + 1 - min(display_levels, level + 1)
    parts = [numeral(F.when(c == 0, 1).otherwise(c), forms[k]) for k, c in ((k, F.element_at(counts, k + 1)) for k in range(first, level + 1))]
    return F.concat(F.lit(prefix), F.concat_ws(".", *parts), F.lit(suffix))


def doc_label(counts: Column, template: str, forms: Sequence[str]) -> Column:
    """A binary document's label: characters below 9 stand for the counters of their level."""
    out = [numeral(F.greatest(F.element_at(counts, ord(c) + 1), F.lit(1)), forms[ord(c)]) if ord(c) < min(9, len(forms)) else F.lit(c) for c in template]
    return F.concat(*out) if out else F.lit("")


def list_keys(lists: DataFrame) -> DataFrame:
    """``key`` of each list of a document: its own, or that of the list that it continues.

    ``lists``: doc_id, ord, list_id, continue_list (an id), continue_numbering, style. Continuation
    runs in document order, so a document's lists are read as one group.
    """
    import pandas as pd

    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in lists.schema)}, key string"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ord", kind="stable")
        by_id: dict[str, str] = {}
        by_style: dict[str, str] = {}
        keys = []
        for row in group.itertuples(index=False):
            key = by_id.get(row.continue_list) if row.continue_list is not None else None
            if key is None and row.continue_numbering:
                key = by_style.get(row.style)
            key = key or f"list-{len(keys) + 1}"
            if row.list_id is not None:
                by_id[row.list_id] = key
            if row.style is not None:
                by_style[row.style] = key
            keys.append(key)
        return group.assign(key=keys)

    return lists.groupBy("doc_id").applyInPandas(run, schema)
