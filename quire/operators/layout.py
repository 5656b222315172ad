"""Ordered-sequence operators of sheets and pages: offsets, page groups, overflow, merges, gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.scalars import let


def prefix_offsets(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, name: str = "start") -> DataFrame:
    """Sum of the sizes before each item."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(size).over(before), F.lit(0.0)))


def pack_starts(sizes: Column, limit: Column | float, breaks: Column | None = None) -> Column:
    """Places (from 0) of the first items of the groups of an array of sizes, filled in order: a new
    group starts where the next size would pass the limit (by over 0.01) or after an item marked in
    ``breaks``. None is empty. The fold keeps starts only, so its cost is that of items and groups."""
    limit = limit if isinstance(limit, Column) else F.lit(float(limit))
    marks = breaks if breaks is not None else F.transform(sizes, lambda _: F.lit(False))
    items = F.arrays_zip(sizes.alias("size"), marks.alias("mark"))
    start = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("used"), F.lit(True).alias("cut"), F.array().cast("array<int>").alias("starts"))

    def add(state: Column, item: Column) -> Column:
        size = item["size"].cast("double")
        turn = state["cut"] | (state["used"] + size > limit + 0.01)
        return F.struct(
            (state["at"] + 1).alias("at"), (F.when(turn, 0.0).otherwise(state["used"]) + size).alias("used"), F.coalesce(item["mark"], F.lit(False)).alias("cut"),
            F.when(turn, F.concat(state["starts"], F.array(state["at"]))).otherwise(state["starts"]).alias("starts"),
        )

    return F.aggregate(items, start, add, lambda s: s["starts"])


def pack(sizes: Column, limit: Column | float, breaks: Column | None = None) -> Column:
    """Group numbers (from 0) of an array of sizes, see ``pack_starts``."""
    size = lambda p, s, g: F.coalesce(F.get(p["starts"], g + 1), p["n"]) - s
    numbers = lambda p: F.flatten(F.transform(p["starts"], lambda s, g: F.array_repeat(g, size(p, s, g))))
    return let(F.struct(pack_starts(sizes, limit, breaks).alias("starts"), F.size(sizes).alias("n")), numbers)


def pack_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, limit: float, name: str = "page") -> DataFrame:
    """Each item with its group. A sheet's sizes are folded as one array (a sheet has a million rows
    at most, so the array is bounded by the format)."""
    item = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in df.columns if c not in order])
    sheets = df.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("items"))
    sheets = sheets.withColumn("pages", pack(F.transform("items", lambda x: x[size].cast("double")), limit))
    spread = sheets.select(*keys, F.explode(F.arrays_zip("items", "pages")).alias("x"))
    rest = [c for c in df.columns if c not in keys]
    return spread.select(*keys, *[F.col(f"x.items.{c}").alias(c) for c in rest], F.col("x.pages").alias(name))


def page_number(row_group: Column, col_group: Column, row_groups: Column, col_groups: Column, over_then_down: Column) -> Column:
    """1-based page of a (row group, column group): over then down, or down then over."""
    return F.when(over_then_down, row_group * col_groups + col_group).otherwise(col_group * row_groups + row_group) + 1


def point_to_cell(points: DataFrame, spans: DataFrame, keys: Sequence[str], x: str, name: str = "cell") -> DataFrame:
    """The first span (keys, ``ord``, ``start``, ``size``) whose end is at x - 0.01 or behind.

    Ends and points are sorted together from the far end, and each point takes the last end seen.
    """
    ends = spans.select(*keys, (F.col("start") + F.col("size")).alias("_at"), F.lit(0).alias("_t"), F.col("ord").alias("_ord"))
    asked = points.withColumns({"_at": F.col(x) - 0.01, "_t": F.lit(1)})
    w = Window.partitionBy(*keys).orderBy(F.desc("_at"), "_t", F.desc("_ord")).rowsBetween(Window.unboundedPreceding, 0)
    found = asked.unionByName(ends, allowMissingColumns=True).withColumn(name, F.last("_ord", ignorenulls=True).over(w))
    return found.where("_t = 1").drop("_at", "_t", "_ord")


def left_neighbour(cells: DataFrame, keys: Sequence[str], name: str = "left") -> DataFrame:
    """struct(c, kind, txt) of the nearest cell with content to the left in the row."""
    before = Window.partitionBy(*keys, "r").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    content = F.when(F.col("kind") != "empty", F.struct("c", "kind", "txt"))
    return cells.withColumn(name, F.last(content, ignorenulls=True).over(before))


def overflow_width(cells: DataFrame, keys: Sequence[str], width: str, name: str = "room") -> DataFrame:
    """Points to the right up to the next cell with content, less 3, at least 1.

    ``cells`` has a row for each column of the used range.
    """
    row = Window.partitionBy(*keys, "r").orderBy("c")
    upto = F.sum(width).over(row.rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum(width).over(Window.partitionBy(*keys, "r"))
    out = cells.withColumn("_at", F.coalesce(upto, F.lit(0.0))).withColumn("_total", total)
    content = F.when(F.col("kind") != "empty", F.col("_at"))
    # From the right, so that the frame only grows.
    following = F.last(content, ignorenulls=True).over(Window.partitionBy(*keys, "r").orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, -1))
    room = F.coalesce(following, F.col("_total")) - F.col("_at") - 3.0
    return out.withColumn(name, F.greatest(room, F.lit(1.0))).drop("_at", "_total")


def row_spans(cells: DataFrame, keys: Sequence[str], merge: str, name: str = "row_span") -> DataFrame:
    """Spans of vertical merges: 'restart' opens one, 'continue' below lengthens it, null closes it.

    Continuations are dropped; one that follows nothing open stands alone.
    """
    down = Window.partitionBy(*keys, "c").orderBy("r")
    opens = F.coalesce(F.col(merge) != "continue", F.lit(True)) | F.coalesce(F.lag(F.coalesce(F.col(merge), F.lit("none"))).over(down), F.lit("none")).isin("none")
    marked = cells.withColumn("_open", opens.cast("int"))
    marked = marked.withColumn("_run", F.sum("_open").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    span = F.count(F.lit(1)).over(Window.partitionBy(*keys, "c", "_run"))
    return marked.withColumn(name, span).where("_open = 1").drop("_open", "_run")


def collapse_gaps(blocks: DataFrame, keys: Sequence[str], order: str, name: str = "gap") -> DataFrame:
    """Space above each paragraph after the one before: the larger of both, or their sum.

    Columns: kind, style_id, before, after, contextual, additive. Neighbours of one style with
    ``contextual`` set have none between them; a table starts afresh.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    prior = F.lag(F.struct("kind", "style_id", "after", "contextual")).over(w)
    out = blocks.withColumn("_p", prior)
    para = F.col("_p.kind") == "paragraph"
    same = F.col("_p.style_id").eqNullSafe(F.col("style_id"))
    above = F.when(same & F.col("_p.contextual"), 0.0).otherwise(F.col("_p.after"))
    below = F.when(same & F.col("contextual") & para, 0.0).otherwise(F.col("before"))
    gap = F.when(F.col("additive"), above + below).otherwise(F.greatest(above, below))
    return out.withColumn(name, F.when(F.col("kind") != "paragraph", 0.0).when(F.coalesce(para, F.lit(False)), gap).otherwise(F.col("before"))).drop("_p")


def runs_of(df: DataFrame, keys: Sequence[str], order: Sequence[str], same: Sequence[str], name: str = "run") -> DataFrame:
    """Number of each stretch of consecutive rows with equal ``same`` columns."""
    w = Window.partitionBy(*keys).orderBy(*order)
    this = F.struct(*same)
    fresh = ~this.eqNullSafe(F.lag(this).over(w)) | (F.row_number().over(w) == 1)
    out = df.withColumn("_fresh", fresh.cast("int"))
    return out.withColumn(name, F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def merge_runs(df: DataFrame, keys: Sequence[str], order: str, same: Sequence[str], text: str) -> DataFrame:
    """Neighbouring runs with equal properties as one, their texts joined in order."""
    numbered = runs_of(df, keys, [order], same)
    out = numbered.groupBy(*keys, "run", *same).agg(
        F.min(order).alias(order), F.sort_array(F.collect_list(F.struct(order, text))).alias("_parts")
    )
    return out.withColumn(text, F.array_join(F.transform("_parts", lambda p: p[text]), "")).drop("_parts")


def group_ends(df: DataFrame, keys: Sequence[str], order: Sequence[str], same: Sequence[str]) -> DataFrame:
    """``first`` and ``last`` mark the ends of stretches of equal borders or shading."""
    w = Window.partitionBy(*keys).orderBy(*order)
    this, n = F.struct(*same), F.row_number().over(w)
    out = df.withColumn("first", (n == 1) | ~this.eqNullSafe(F.lag(this).over(w)))
    total = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return out.withColumn("last", (n == total) | ~this.eqNullSafe(F.lead(this).over(w)))


def slice_runs(df: DataFrame, keys: Sequence[str], at: str, text: str) -> DataFrame:
    """Substrings of a text between the starts of its format runs (0-based)."""
    w = Window.partitionBy(*keys).orderBy(at)
    end = F.coalesce(F.lead(at).over(w), F.char_length(text))
    return df.withColumn("part", F.substring(F.col(text), F.col(at) + 1, end - F.col(at)))


def expand_repeats(df: DataFrame, repeat: str, cap: int, name: str) -> DataFrame:
    """Each row as often as it repeats, up to the cap, numbered from 0."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.least(F.col(repeat), F.lit(cap)) - 1)))


def numbered(df: DataFrame, key: str, order: Sequence[str], name: str = "n", parts: int = 64) -> DataFrame:
    """1-based numbers over the whole table by ``key`` and ``order``, without one sort for all.

    Quantiles of the key cut the table into ranges; rows are numbered within each range, and the
    ranges' sizes (``parts`` rows) give the offsets.
    """
    cuts = df.agg(F.percentile_approx(key, [k / parts for k in range(1, parts)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    part = F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x < F.col(key))) if cuts else F.lit(0)
    ranged = df.withColumn("_part", part)
    sizes = {r[0]: r[1] for r in ranged.groupBy("_part").count().collect()}
    offsets, total = [], 0
    for k in range(len(cuts) + 1):
        offsets.append(F.lit(total).cast("long"))
        total += sizes.get(k, 0)
    w = Window.partitionBy("_part").orderBy(key, *order)
    start = F.get(F.array(*offsets), F.col("_part"))
    return ranged.withColumn(name, F.row_number().over(w) + start).drop("_part")
