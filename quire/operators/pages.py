"""Sheets to pages: scale, groups of rows and columns, page order, notes, cells as shown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.scalars import let
from quire.operators.condfmt import match_rectangles
from quire.operators.layout import overflow_width, pack_starts, page_number, point_to_cell, prefix_offsets


def page_scale(options: Column, width: Column, height: Column) -> Column:
    """The print scale: the sheet's own, or what fits it on its pages, between 0.1 and 1."""
    one = F.lit(1.0)
    wide = F.when(options["fit_width"] > 0, options["printable_w"] * options["fit_width"] / F.greatest(width, one))
    tall = F.when(options["fit_height"] > 0, options["printable_h"] * options["fit_height"] / F.greatest(height, one))
    fitted = F.greatest(F.lit(0.1), F.least(wide, tall, one))
    return F.when(options["fit_to_page"], fitted).otherwise(options["scale"])


def _ends(items: str):
    """From the groups' starts: the places of the first and the last item of each group."""
    last = lambda starts, g: F.coalesce(F.get(starts, g + 1), F.size(items)) - 1
    ends = lambda starts, s, g: F.struct(F.get(items, s)["at"].alias("a"), F.get(items, last(starts, g))["at"].alias("b"))
    return lambda starts: F.transform(starts, lambda s, g: ends(starts, s, g))


def sheet_pages(rows: DataFrame, columns: DataFrame, options: DataFrame, keys: Sequence[str] = ("doc_id", "sheet_idx")) -> DataFrame:
    """Pages of each sheet: (keys, page, row_group, col_group, r1, r2, c1, c2, scale).

    ``rows``: r, height, hidden, break_after; ``columns``: c, width, break_after (hidden ones have
    width 0); ``options``: printable_w, printable_h, scale, fit_to_page, fit_width, fit_height,
    over_then_down. A sheet's rows and columns are one array each, bounded by the format.
    """
    keys = list(keys)
    item = lambda at, size: F.sort_array(F.collect_list(F.struct(F.col(at).alias("at"), F.col(size).cast("double").alias("size"), F.coalesce("break_after", F.lit(False)).alias("cut"))))
    down = rows.where(~F.coalesce("hidden", F.lit(False))).groupBy(*keys).agg(item("r", "height").alias("rows"))
    across = columns.groupBy(*keys).agg(item("c", "width").alias("cols"))
    fields = [c for c in options.columns if c not in keys]
    sheets = options.select(*keys, F.struct(*fields).alias("o")).join(down, keys).join(across, keys)
    total = lambda name: F.aggregate(name, F.lit(0.0), lambda a, x: a + x["size"])
    sheets = sheets.withColumn("scale", page_scale(F.col("o"), total("cols"), total("rows")))
    for name, limit in (("rows", "printable_h"), ("cols", "printable_w")):
        sizes = F.transform(name, lambda x: x["size"] * F.col("scale"))
        starts = pack_starts(sizes, F.col("o")[limit], F.transform(name, lambda x: x["cut"]))
        sheets = sheets.withColumn(f"{name}_of", let(starts, _ends(name)))
    grid = sheets.select(*keys, "o", "scale", F.size("rows_of").alias("rgs"), F.size("cols_of").alias("cgs"), "rows_of", "cols_of")
    grid = grid.select("*", F.posexplode("rows_of").alias("row_group", "rr")).drop("rows_of")
    out = grid.select("*", F.posexplode("cols_of").alias("col_group", "cc")).drop("cols_of")
    page = page_number(F.col("row_group"), F.col("col_group"), F.col("rgs"), F.col("cgs"), F.col("o.over_then_down"))
    return out.select(*keys, page.alias("page"), "row_group", "col_group", F.col("rr.a").alias("r1"), F.col("rr.b").alias("r2"), F.col("cc.a").alias("c1"), F.col("cc.b").alias("c2"), "scale")


def page_notes(comments: DataFrame, pages: DataFrame, rows: DataFrame, columns: DataFrame, keys: Sequence[str] = ("doc_id", "sheet_idx")) -> DataFrame:
    """Comments on their pages: x behind their column, y at their row, from the page's corner."""
    keys = list(keys)
    on_page = comments.join(pages, keys).where("r between r1 and r2 and c between c1 and c2")
    left = on_page.select(*keys, "r", "c", "page", "c1", "r1", "scale", "text")
    wide = columns.select(*keys, F.col("c").alias("_k"), F.col("width").cast("double").alias("width"))
    tall = rows.where(~F.coalesce("hidden", F.lit(False))).select(*keys, F.col("r").alias("_m"), F.col("height").cast("double").alias("height"))
    xs = left.join(wide, keys).where("_k between c1 and c").groupBy(*keys, "r", "c", "page").agg((F.sum("width") * F.first("scale")).alias("x"))
    ys = left.join(tall, keys).where("_m >= r1 and _m < r").groupBy(*keys, "r", "c", "page").agg((F.sum("height") * F.first("scale")).alias("y"))
    out = left.select(*keys, "r", "c", "page", "text").join(xs, [*keys, "r", "c", "page"]).join(ys, [*keys, "r", "c", "page"], "left")
    return out.withColumn("y", F.coalesce("y", F.lit(0.0)))


def drawings_on_pages(drawings: DataFrame, pages: DataFrame, rows: DataFrame, columns: DataFrame, keys: Sequence[str] = ("doc_id", "sheet_idx")) -> DataFrame:
    """Drawings (keys, idx, x, y in points from the sheet's corner) on the page of the cell that holds
    their corner: with page, and x and y from the page's corner, to its scale."""
    keys = list(keys)
    spans = []
    for table, at, size in ((columns, "c", F.col("width")), (rows, "r", F.when(F.coalesce("hidden", F.lit(False)), 0.0).otherwise(F.col("height")))):
        spans.append(prefix_offsets(table.select(*keys, F.col(at).alias("ord"), size.cast("double").alias("size")), keys, ["ord"], "size"))
    corner = drawings.withColumns({"_x": F.col("x") + 0.01, "_y": F.col("y") + 0.01})
    corner = point_to_cell(point_to_cell(corner, spans[0], keys, "_x", "c"), spans[1], keys, "_y", "r").drop("_x", "_y")
    on_page = match_rectangles(corner, pages.select(*keys, "page", "r1", "c1", "r2", "c2", "scale"), keys=keys)
    left = spans[0].select(*keys, F.col("ord").alias("c1"), F.col("start").alias("_left"))
    top = spans[1].select(*keys, F.col("ord").alias("r1"), F.col("start").alias("_top"))
    out = on_page.join(left, [*keys, "c1"]).join(top, [*keys, "r1"])
    place = {"x": (F.col("x") - F.col("_left")) * F.col("scale"), "y": (F.col("y") - F.col("_top")) * F.col("scale")}
    return out.withColumns(place).select(*drawings.columns, "page", "r", "c")


FONT_FIELDS = ("font", "size", "bold", "italic", "underline", "strike", "color")


def auto_row_heights(cells: DataFrame, xfs: DataFrame, rows: DataFrame, default: float, keys: Sequence[str] = ("doc_id", "sheet_idx")) -> DataFrame:
    """``rows`` (keys, r, height) with heights that are not set by the largest font of the row's cells,
    where it is larger than the workbook's first font and needs more than the default."""
    doc = keys[0]
    sized = xfs.select(doc, F.col("idx").alias("xf"), F.coalesce("size", F.lit(10.0)).alias("_size"))
    first = sized.where("xf = 0").select(doc, F.col("_size").alias("_base"))
    largest = cells.join(sized, [doc, "xf"]).groupBy(*keys, "r").agg(F.max("_size").alias("_size"))
    out = rows.join(largest, [*keys, "r"], "left").join(first, doc, "left")
    need = F.col("_size") * 1.117 + 2.0
    grown = F.when((F.col("_size") > F.coalesce("_base", F.lit(10.0)) + 0.01) & (need > default), need)
    return out.withColumn("height", F.coalesce("height", grown, F.lit(default))).drop("_size", "_base")


def page_cells(cells: DataFrame, pages: DataFrame, columns: DataFrame, xfs: DataFrame, dxfs: DataFrame, merges: DataFrame, keys: Sequence[str] = ("doc_id", "sheet_idx")) -> DataFrame:
    """The cells of each page as they are shown: one view of format, rule, merge and overflow.

    ``cells``: keys, r, c, kind, xf, dxf (the rule's format or null) and more columns, a row for each
    cell of the used range; ``pages``: keys, page, r1, r2, c1, c2; ``columns``: keys, c, width;
    ``xfs`` and ``dxfs``: the document's formats by idx; ``merges``: keys, ordinal, r1, c1, r2, c2.

    Cells covered by a merge go, but for its first column: below its first row they stand for the
    merge going on. A span ends at the page's last column. The rule's font, fill and number format
    replace the cell's own. Without wrapping, text has the room up to the next cell with content.
    """
    keys = list(keys)
    doc = keys[0]
    boxes = merges.select(*keys, "ordinal", *[F.col(n).alias(f"m_{n}") for n in ("r1", "c1", "r2", "c2")])
    areas = boxes.withColumns({n: F.col(f"m_{n}") for n in ("r1", "c1", "r2", "c2")})
    held = match_rectangles(cells.select(*keys, "r", "c"), areas, keys=keys).groupBy(*keys, "r", "c")
    held = held.agg(F.min(F.struct("ordinal", "m_r1", "m_c1", "m_r2", "m_c2")).alias("_merge"))
    placed = cells.join(held, [*keys, "r", "c"], "left").join(columns.select(*keys, "c", "width"), [*keys, "c"], "left")
    paged = match_rectangles(placed, pages.select(*keys, "page", "r1", "c1", "r2", "c2"), keys=keys).withColumnRenamed("c2", "_last").drop("r1", "c1", "r2")
    # Rooms are those of the page's own columns, before covered cells go.
    paged = overflow_width(paged, [*keys, "page"], "width", "room")
    merge, r, c = F.col("_merge"), F.col("r"), F.col("c")
    shown = paged.where(merge.isNull() | (c == merge["m_c1"]))
    goes_on = F.coalesce(r != merge["m_r1"], F.lit(False))
    own = xfs.select(doc, F.col("idx").alias("xf"), F.struct(*[n for n in xfs.columns if n not in (doc, "idx")]).alias("_xf"))
    over = dxfs.select(doc, F.col("idx").alias("dxf"), F.struct(*[n for n in dxfs.columns if n not in (doc, "idx")]).alias("_dxf"))
    out = shown.join(own, [doc, "xf"], "left").join(over, [doc, "dxf"], "left")
    field = lambda name: F.when(~goes_on, F.coalesce(F.col(f"_dxf.{name}"), F.col(f"_xf.{name}")))
    default = F.when(F.col("kind").isin("number", "shown", "bool"), "right").when(F.col("kind") == "error", "center").otherwise("left")
    extra = [n for n in cells.columns if n not in (*keys, "r", "c", "kind", "xf", "dxf")]
    return out.select(
        *keys, "page", "r", "c", "kind", *extra,
        F.when(merge.isNull(), 1).otherwise(F.least(merge["m_c2"], "_last") - merge["m_c1"] + 1).cast("int").alias("span"),
        F.when(goes_on, "continue").when(merge["m_r2"] > merge["m_r1"], "restart").alias("vmerge"),
        *[field(n).alias(n) for n in (*FONT_FIELDS, "fill")], F.when(~goes_on, F.coalesce("_dxf.num_fmt", "_xf.num_fmt", F.lit("General"))).alias("code"),
        F.when(~goes_on, F.col("_xf.borders")).alias("borders"), F.when(~goes_on, F.coalesce("_xf.align", default)).alias("align"), F.when(~goes_on, F.col("_xf.valign")).alias("valign"),
        F.when(~goes_on & ~F.coalesce("_xf.wrap", F.lit(False)), F.col("room")).alias("room"),
    )
