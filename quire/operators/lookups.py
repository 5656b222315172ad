"""Lookups that the readers' tables need: dictionary joins, nearest runs, rectangles.

Dictionaries are per document, so they grow with the data: joins are plain equi-joins, and Spark
broadcasts a side only where its measured size is within its threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shared_strings(cells: DataFrame, strings: DataFrame) -> DataFrame:
    """Cells with kind 'shared' get their text by (doc_id, idx); a missing one is empty."""
    table = strings.select("doc_id", F.col("idx").alias("_idx"), F.col("text").alias("_text"))
    index = F.when(F.col("kind") == "shared", F.col("num").cast("int"))
    out = cells.withColumn("_at", index).join(table, (cells["doc_id"] == table["doc_id"]) & (F.col("_at") == F.col("_idx")), "left").drop(table["doc_id"])
    shared = F.col("kind") == "shared"
    return out.withColumns(
        {
            "txt": F.when(shared, F.col("_text")).otherwise(F.col("txt")),
            "num": F.when(~shared, F.col("num")),
            "kind": F.when(shared & F.col("_text").isNull(), "empty").when(shared, "text").otherwise(F.col("kind")),
        }
    ).drop("_at", "_idx", "_text")


def with_default(df: DataFrame, index: str, table: DataFrame, keys: Sequence[str], key: str, values: Sequence[str], default: int = 0) -> DataFrame:
    """Values by index; an index out of range takes entry ``default``, and null where there is none.

    Of several entries with one index, the least values count.
    """
    keys = list(keys)
    known = table.groupBy(*keys, F.col(key).alias("_k")).agg(F.min(F.struct(*values)).alias("_v"))
    first = known.where(F.col("_k") == default)
    joined = df.withColumn("_k", F.col(index)).join(known, [*keys, "_k"], "left")
    if keys:
        joined = joined.join(first.select(*keys, F.col("_v").alias("_d")), keys, "left")
    else:  # one value for all rows
        joined = joined.withColumn("_d", first.agg(F.min("_v").alias("_d")).scalar())
    found = F.coalesce("_v", "_d")
    return joined.withColumns({v: found[v] for v in values}).drop("_k", "_v", "_d")


def relationships(refs: DataFrame, rels: DataFrame, parts: DataFrame) -> DataFrame:
    """References (doc_id, part, rid) to their target parts; a miss on the way drops the row."""
    inside = rels.where("coalesce(mode, '') <> 'External'").select("doc_id", "part", "rid", "type", "target")
    data = parts.select("doc_id", F.col("part").alias("target"), "data")
    return refs.join(inside, ["doc_id", "part", "rid"]).join(data, ["doc_id", "target"])


def nearest_run(points: DataFrame, runs: DataFrame, keys: Sequence[str], at: str, start: str, end: str, value: str, parts: int = 64) -> DataFrame:
    """The run that holds each point: start <= at < end. Runs do not overlap, so the last start at
    or before the point decides.

    Quantiles of the positions cut them into ranges, each sorted by a task of its own, so that one
    document's points need not fit in one; a range takes over the last run that starts before it.
    """
    a = points.withColumn("_t", F.lit(1)).withColumn("_at", F.col(at)).withColumn("_run", F.lit(None).cast(f"struct<end:{runs.schema[end].dataType.simpleString()},value:{runs.schema[value].dataType.simpleString()}>"))
    b = runs.select(*keys, F.col(start).alias("_at"), F.lit(0).alias("_t"), F.struct(F.col(end).alias("end"), F.col(value).alias("value")).alias("_run"))
    places = a.select("_at").unionByName(b.select("_at"))
    cuts = sorted(set(places.agg(F.percentile_approx("_at", [k / parts for k in range(1, parts)], 10_000)).first()[0] or []))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x < F.col("_at"))) if cuts else F.lit(0)
    every = a.unionByName(b, allowMissingColumns=True).withColumn("_part", part)
    held = [*keys, "_part"]
    last = b.withColumn("_part", part).groupBy(*held).agg(F.max_by("_run", "_at").alias("_run"))
    last = a.withColumn("_part", part).select(*held).distinct().withColumn("_run", F.lit(None).cast(last.schema["_run"].dataType)).unionByName(last).groupBy(*held).agg(F.max("_run").alias("_run"))
    before = last.withColumn("_before", F.last("_run", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(*[F.col(k).alias(f"_of_{k}") for k in held], "_before")
    w = Window.partitionBy(*held).orderBy("_at", "_t").rowsBetween(Window.unboundedPreceding, 0)
    found = every.withColumn("_last", F.last("_run", ignorenulls=True).over(w)).where("_t = 1")
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in held]
    found = found.join(before, same, "left").withColumn("_last", F.coalesce("_last", "_before"))
    return found.withColumn(value, F.when(F.col("_last.end") > F.col(at), F.col("_last.value"))).drop("_t", "_at", "_run", "_last", "_part", "_before", *[f"_of_{k}" for k in held])


def column_widths(columns: DataFrame, specs: DataFrame, keys: Sequence[str], default: float, most: int = 16_384) -> DataFrame:
    """Width of each column: the first specification (by ordinal) that covers it; hidden is 0."""
    spread = specs.withColumn("c", F.explode(F.sequence(F.col("c_min"), F.least(F.col("c_max"), F.lit(most)))))
    value = F.when(F.col("hidden"), 0.0).otherwise(F.col("width"))
    first = spread.groupBy(*keys, "c").agg(F.min_by(value, "ordinal").alias("width"))
    return columns.join(first, [*keys, "c"], "left").withColumn("width", F.coalesce("width", F.lit(default)))


def placeholders(shapes: DataFrame, layout: DataFrame, master: DataFrame, values: Sequence[str]) -> DataFrame:
    """Slide placeholders with what layout and master give: by type for titles, dates, footers and
    numbers, else by index; the first match by ordinal."""
    named = ("title", "ctrTitle", "dt", "ftr", "sldNum")
    key = F.when(F.col("type").isin(*named), F.concat(F.lit("t:"), F.regexp_replace("type", "^ctrTitle$", "title"))).otherwise(F.concat(F.lit("i:"), F.coalesce(F.col("idx").cast("string"), F.lit("0"))))
    out = shapes.withColumn("_key", key)
    for name, side in (("layout", layout), ("master", master)):
        first = side.withColumn("_key", key).groupBy("doc_id", "_key").agg(*[F.min_by(F.col(v), "ordinal").alias(f"{name}_{v}") for v in values])
        out = out.join(first, ["doc_id", "_key"], "left")
    return out.withColumns({v: F.coalesce(v, f"layout_{v}", f"master_{v}") for v in values}).drop("_key", *[f"{s}_{v}" for s in ("layout", "master") for v in values])


#: Layers of text properties on slides, from the weakest: the presentation's default, the master's title, body or other
#: text, the master's placeholder, the layout's, the shape's own list style.
LEVEL_SCOPES = ("default", "text", "master", "layout", "shape")


def level_properties(paragraphs: DataFrame, levels: DataFrame, values: Sequence[str], keys: Sequence[str] = ("doc_id",), scopes: Sequence[str] = LEVEL_SCOPES) -> DataFrame:
    """Paragraphs with the properties of their level: what they set themselves, else what the strongest
    layer gives that sets it.

    ``paragraphs``: keys, level, the values, and for each scope ``<scope>_owner`` (null where the
    paragraph has no such layer); ``levels``: keys, scope, owner, level, the values. One join a layer.
    """
    keys = list(keys)
    out, found = paragraphs, []
    for scope in scopes:
        side = levels.where(F.col("scope") == scope).groupBy(*keys, F.col("owner").alias(f"{scope}_owner"), "level")
        side = side.agg(*[F.min(v).alias(f"_{scope}_{v}") for v in values])
        out = out.join(side, [*keys, f"{scope}_owner", "level"], "left")
        found.append(scope)
    set_by = lambda v: F.coalesce(F.col(v), *[F.col(f"_{scope}_{v}") for scope in reversed(found)])
    return out.withColumns({v: set_by(v) for v in values}).select(*paragraphs.columns)


def list_formats(instances: DataFrame, levels: DataFrame, overrides: DataFrame) -> DataFrame:
    """Levels of each list format of a binary document: those of its list, replaced where the format
    overrides a level, and with its start where it overrides that alone.

    ``instances``: doc_id, format_id, list_id; ``levels``: doc_id, list_id, level, start, form, text;
    ``overrides``: doc_id, format_id, level, start, form (null: only the start), text.
    """
    over = overrides.select("doc_id", "format_id", "level", F.struct("start", "form", "text").alias("_o"))
    out = instances.join(levels, ["doc_id", "list_id"]).join(over, ["doc_id", "format_id", "level"], "left")
    whole = F.col("_o.form").isNotNull()
    new = {
        "start": F.coalesce("_o.start", "start"), "form": F.coalesce("_o.form", "form"), "text": F.when(whole, F.col("_o.text")).otherwise(F.col("text")),
    }
    return out.withColumns(new).select("doc_id", "format_id", "list_id", "level", "start", "form", "text")
