"""Sheet aggregates over the cells of a group, as ordinary Spark aggregates.

Values are numbers or logicals; texts and blanks are not counted by the numeric ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numeric(kind: Column, num: Column, flag: Column) -> Column:
    """A cell as a number for aggregates: logicals are 1 and 0, texts and blanks null."""
    return F.when(kind.isin("number", "shown"), num).when(kind == "bool", F.when(flag, 1.0).otherwise(0.0))


def sheet_sum(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0.0))


def sheet_average(x: Column) -> Column:
    return F.avg(x)


def sheet_min(x: Column) -> Column:
    """Plus infinity without numbers."""
    return F.coalesce(F.min(x), F.lit(float("inf")))


def sheet_max(x: Column) -> Column:
    """Minus infinity without numbers."""
    return F.coalesce(F.max(x), F.lit(float("-inf")))


def sheet_count(x: Column) -> Column:
    return F.count(x)


def sheet_counta(kind: Column) -> Column:
    return F.count_if(F.coalesce(kind != "empty", F.lit(False)))


def sheet_countblank(kind: Column) -> Column:
    return F.count_if(F.coalesce(kind == "empty", F.lit(True)))


def sheet_and(b: Column) -> Column:
    return F.coalesce(F.bool_and(b), F.lit(True))


def sheet_or(b: Column) -> Column:
    return F.coalesce(F.bool_or(b), F.lit(False))


def used_range(cells: DataFrame, keys: list[str], styled: Column | None = None) -> DataFrame:
    """Least and greatest row and column of cells with content, or with a fill or border."""
    counts = F.col("kind") != "empty"
    if styled is not None:
        counts = counts | styled
    inside = cells.where(counts)
    return inside.groupBy(*keys).agg(
        F.min("r").alias("first_row"), F.max("r").alias("last_row"), F.min("c").alias("first_col"), F.max("c").alias("last_col")
    )


def row_height(largest: Column, default_size: Column, default_height: Column) -> Column:
    """Automatic height from a row's largest font."""
    need = largest * 1.117 + 2.0
    return F.when((largest > default_size) & (need > default_height), need).otherwise(default_height)


def fit_scale(width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    """The scale that fits a sheet on a page, between 0.1 and 1."""
    scale = F.least(F.try_divide(page_width, width), F.try_divide(page_height, height))
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.coalesce(scale, F.lit(1.0))))
