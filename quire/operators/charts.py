"""Charts as data: categories, series, axes, shares and slots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.scalars import nice_axis
from quire.operators.condfmt import match_rectangles


def chart_points(df: DataFrame, keys: Sequence[str], category: str, series: str, value: str) -> DataFrame:
    """Long points with every category for every series; gaps are null. Places follow the names."""
    keys = list(keys)
    cats = df.select(*keys, category).distinct()
    cats = cats.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(category)))
    rows = df.select(*keys, series).distinct()
    rows = rows.withColumn("series_idx", F.row_number().over(Window.partitionBy(*keys).orderBy(series)))
    sums = df.groupBy(*keys, category, series).agg(F.sum(value).alias("value"))
    grid = cats.join(rows, keys) if keys else cats.crossJoin(rows)
    return grid.join(sums, [*keys, category, series], "left")


def pad_categories(points: DataFrame, keys: Sequence[str], size: str) -> DataFrame:
    """A point for each place up to ``size``; missing categories are named by their place."""
    heads = points.groupBy(*keys).agg(F.max(size).alias("_size"))
    grid = heads.select(*keys, F.explode(F.sequence(F.lit(1), F.col("_size"))).alias("pos"))
    out = grid.join(points.drop(size), [*keys, "pos"], "left")
    return out.withColumn("category", F.coalesce(F.col("category").cast("string"), F.col("pos").cast("string")))


def axis(points: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Axis ends and step; the axis always shows 0."""
    ends = points.groupBy(*keys).agg(F.least(F.lit(0.0), F.min(value)).alias("_low"), F.greatest(F.lit(0.0), F.max(value)).alias("_high"))
    made = nice_axis(F.col("_low"), F.col("_high"))
    return ends.withColumn("_a", made).select(*keys, F.col("_a.low").alias("low"), F.col("_a.high").alias("high"), F.col("_a.step").alias("step"))


def pie_angles(points: DataFrame, keys: Sequence[str], order: str, value: str = "value") -> DataFrame:
    """Share and angles of each slice; negatives are 0, a pie without any positive value is left out."""
    v = F.greatest(F.coalesce(F.col(value), F.lit(0.0)), F.lit(0.0))
    out = points.withColumn("_v", v)
    total = F.sum("_v").over(Window.partitionBy(*keys))
    before = F.coalesce(F.sum("_v").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    out = out.withColumn("_total", total).withColumn("_before", before).where("_total > 0")
    share, start = F.col("_v") / F.col("_total"), F.col("_before") / F.col("_total") * 360.0
    return out.withColumn("share", share).withColumn("angle", start).withColumn("sweep", share * 360.0).drop("_v", "_total", "_before")


def bar_slots(pos: Column, series_idx: Column, categories: Column, series: Column, width: Column, gap: float = 0.3) -> Column:
    """struct(x, width) of a bar: a category has an equal slot, ``gap`` of it is empty."""
    slot = width / categories
    bar = slot * (1 - gap) / series
    return F.struct(((pos - 1) * slot + slot * gap / 2 + (series_idx - 1) * bar).alias("x"), bar.alias("width"))


def chart_title(title: Column, series_names: Column, auto_deleted: Column) -> Column:
    """The explicit title, else a single series' name unless the automatic title is deleted."""
    alone = F.when((F.size(series_names) == 1) & ~F.coalesce(auto_deleted, F.lit(False)), F.get(series_names, F.lit(0)))
    return F.coalesce(title, alone)


def table_band(row: Column, first_row: Column, banded: Column) -> Column:
    """Look of a table row: 'header', 'band1', 'band2' or 'plain'."""
    inner = row - F.when(first_row, 1).otherwise(0)
    return F.when(first_row & (row == 0), "header").when(~banded, "plain").when(inner % 2 == 0, "band1").otherwise("band2")


def area_points(areas: DataFrame, cells: DataFrame, keys: Sequence[str] = ("doc_id", "sheet_idx")) -> DataFrame:
    """Points of charts from the sheet areas that they refer to.

    ``areas``: keys, chart, series_idx, role (values, categories, name), r1, c1, r2, c2; ``cells``:
    keys, r, c, kind, num, shown (the text of a cell). Returns keys, chart, series_idx, series_name,
    pos, category, value: an area is read row by row, empty cells are null values and empty
    categories. The first series with categories gives them to all, further ones are numbers.
    """
    keys = list(keys)
    one = [*keys, "chart", "series_idx"]
    wide = F.col("c2") - F.col("c1") + 1
    size = (F.col("r2") - F.col("r1") + 1) * wide
    filled = cells.where("kind <> 'empty'").select(*keys, "r", "c", "kind", "num", "shown")
    found = match_rectangles(filled, areas, keys=keys).withColumn("pos", ((F.col("r") - F.col("r1")) * wide + F.col("c") - F.col("c1") + 1).cast("int"))
    number = F.when(F.col("kind").isin("number", "shown"), F.col("num"))
    values = found.where("role = 'values'").select(*one, "pos", number.alias("value"))
    names = found.where("role = 'name'").groupBy(*one).agg(F.min_by("shown", "pos").alias("series_name"))
    places = areas.where("role = 'values'").select(*one, F.explode(F.sequence(F.lit(1), size.cast("int"))).alias("pos"))
    axis = areas.where("role = 'categories'").groupBy(*keys, "chart").agg(F.min(F.struct("series_idx", size.cast("int").alias("n"))).alias("first"))
    axis = axis.select(*keys, "chart", F.col("first.series_idx").alias("_series"), F.col("first.n").alias("_n"))
    told = found.where("role = 'categories'").select(*keys, "chart", F.col("series_idx").alias("_series"), "pos", F.col("shown").alias("_told"))
    out = places.join(values, [*one, "pos"], "left").join(names, one, "left").join(axis, [*keys, "chart"], "left").join(told, [*keys, "chart", "_series", "pos"], "left")
    category = F.when(F.col("pos") <= F.col("_n"), F.coalesce("_told", F.lit(""))).otherwise(F.col("pos").cast("string"))
    return out.select(*one, "series_name", "pos", category.alias("category"), "value")
