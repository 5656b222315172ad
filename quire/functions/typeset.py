"""Typesetting scalars: font aliases, breaks, literals, line metrics, header slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SANS, SERIF, MONO, SYMBOLS = "Liberation Sans", "Liberation Serif", "Liberation Mono", "OpenSymbol"
#: Families that stand for others.
ALIASES: dict[str, tuple[str, ...]] = {
    SYMBOLS: ("symbol", "wingdings", "wingdings 2", "wingdings 3", "webdings", "opensymbol", "starsymbol", "starbats"),
    "Carlito": ("calibri", "calibri light", "carlito"),
    "Caladea": ("cambria", "cambria math", "caladea"),
    SANS: (
        "arial", "arial narrow", "helvetica", "helvetica neue", "arimo", "albany", "verdana", "tahoma", "segoe ui", "trebuchet ms", "century gothic",
        "franklin gothic", "franklin gothic book", "gill sans", "gill sans mt", "lucida sans", "candara", "corbel", "open sans", "roboto", "avenir",
        "futura", "aptos", "aptos display", "lato", "montserrat", "inter", "dejavu sans", "noto sans",
    ),
    SERIF: (
        "times new roman", "times", "tinos", "thorndale", "nimbus roman", "georgia", "garamond", "book antiqua", "palatino", "palatino linotype",
        "century schoolbook", "bookman old style", "constantia", "minion pro", "baskerville", "perpetua",
    ),
    MONO: ("courier new", "courier", "cousine", "cumberland", "consolas", "lucida console", "menlo", "monaco", "source code pro", "fira code", "cascadia code"),
}


def font_alias(name: Column, generic: Column | None = None) -> Column:
    """The family that stands for a font: by name, else its generic kind, else words in its name.

    The words decide in this order: a fixed-width name, a serif name, a name of roman or book type,
    else sans. A document without the font gets the family that its producer would have put in.
    """
    low = F.lower(F.trim(name))
    out = (
        F.when(low.rlike("mono|courier|code"), MONO)
        .when(low.contains("serif") & ~low.contains("sans"), SERIF)
        .when(low.rlike("roman|times|book"), SERIF)
        .otherwise(SANS)
    )
    if generic is not None:
        out = F.when(generic == "serif", SERIF).when(generic == "mono", MONO).when(generic == "sans", SANS).otherwise(out)
    for family, names in ALIASES.items():
        out = F.when(low.isin(*names), family).otherwise(out)
    return out


def keep_space_tokens(text: Column) -> Column:
    """Pieces that end behind each space."""
    return F.regexp_extract_all(text, F.lit("[^ ]* |[^ ]+$"), F.lit(0))


def hyphen_breaks(text: Column) -> Column:
    """A break opportunity behind a hyphen between a letter and a digit."""
    return F.regexp_replace(text, r"(?<=\p{L}-)(?=[0-9])", "​")


def points_text(value: Column) -> Column:
    """Points with at most three decimals and their unit."""
    rounded = F.signum(value) * F.floor(F.abs(value) * 1000 + 0.5) / 1000
    shown = F.regexp_replace(F.regexp_replace(F.format_number(rounded, 3), ",", ""), r"\.?0+$", "")
    return F.when(rounded == 0, "0pt").otherwise(F.concat(shown, F.lit("pt")))


def quoted(text: Column) -> Column:
    """A string literal: quotes, backslashes and control characters escaped."""
    marked = F.regexp_replace(text, r'(["\\])', r"\\$1")
    parts = F.regexp_extract_all(marked, F.lit(r"(?s)[\x00-\x1f\x7f]|[^\x00-\x1f\x7f]+"), F.lit(0))
    plain = F.transform(parts, lambda p: F.when(p.rlike(r"^[\x00-\x1f\x7f]$"), F.concat(F.lit("\\u{"), F.lower(F.hex(F.ascii(p))), F.lit("}"))).otherwise(p))
    return F.concat(F.lit('"'), F.array_join(plain, ""), F.lit('"'))


def line_edges(size: Column, spacing: Column, metrics: Column | None = None) -> Column:
    """struct(above, below) of a line: ``spacing`` is struct(kind, value) with kinds multiple, exact
    and at_least; ``metrics`` struct(ascender, descender, line_gap) in shares of the size, or none
    for the fixed line of 1.2 sizes."""
    kind, v = spacing["kind"], spacing["value"]
    zero = F.lit(0.0)
    if metrics is None:
        height = F.when(kind == "exact", v).when(kind == "at_least", F.greatest(v, 1.2 * size)).otherwise(1.2 * v * size)
        return F.struct(F.greatest(height - 0.2 * size, zero).alias("above"), (0.2 * size).alias("below"))
    natural = metrics["descender"] + metrics["line_gap"]
    line = metrics["ascender"] + natural
    above = (
        F.when(kind == "exact", v / size - natural)
        .when(kind == "at_least", metrics["ascender"] + F.greatest(v / size - line, zero))
        .when(v >= 1, metrics["ascender"])
        .otherwise(metrics["ascender"] + (v - 1) * line)
    )
    below = F.when((kind == "multiple") & (v >= 1), natural + (v - 1) * line).otherwise(natural)
    return F.struct((F.greatest(above, zero) * size).alias("above"), (F.greatest(below, zero) * size).alias("below"))


def paragraph_lines(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Natural line height of each paragraph: the largest parts above and below of its runs with
    text. ``runs``: keys, text, size, ascender, descender, line_gap."""
    filled = runs.where("text <> ''")
    above, below = F.max(F.col("ascender") * F.col("size")), F.max((F.col("descender") + F.col("line_gap")) * F.col("size"))
    return filled.groupBy(*keys).agg(above.alias("above"), below.alias("below"), (above + below).alias("height"))


def margin_slot(page: Column, first_page: Column, title_page: Column, even_odd: Column, slots: Column) -> Column:
    """Header or footer of a page: struct(default, first, even); a slot that is asked for and not
    there is empty."""
    empty = F.lit("")
    return (
        F.when(title_page & (page == first_page), F.coalesce(slots["first"], empty))
        .when(even_odd & (F.pmod(page, F.lit(2)) == 0), F.coalesce(slots["even"], empty))
        .otherwise(slots["default"])
    )


def grid_width(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of a table: the most that a row's spans come to."""
    return cells.groupBy(*keys, "r").agg(F.sum("span").alias("_n")).groupBy(*keys).agg(F.max("_n").alias("width"))


def overflow_extent(cells: DataFrame, widths: DataFrame, keys: list[str], most: int = 200) -> DataFrame:
    """Last column that unwrapped left-aligned text reaches over empty cells, by sheet.

    ``cells``: keys, r, c, kind, txt, size, wrap, align; ``widths``: keys, c, width (columns up to
    ``most``). Text needs half its font size a character and 3 points.
    """
    import pyspark.sql as sql

    row = sql.Window.partitionBy(*keys, "r").orderBy(F.desc("c")).rowsBetween(sql.Window.unboundedPreceding, -1)  # from the right
    content = F.when(F.col("kind") != "empty", F.col("c"))
    marked = cells.withColumn("_stop", F.coalesce(F.last(content, ignorenulls=True).over(row), F.lit(most + 1)))
    loose = marked.where("kind = 'text' and not coalesce(wrap, false) and coalesce(align, 'left') = 'left'")
    need = F.char_length("txt") * F.coalesce("size", F.lit(11.0)) * 0.5 + 3.0
    lined = widths.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("c", "width"))).alias("_w"))
    joined = loose.withColumn("_need", need).join(lined, list(keys))
    reach = F.aggregate(
        F.filter("_w", lambda w: (w["c"] >= F.col("c")) & (w["c"] <= most)),
        F.struct(F.col("_need").alias("need"), F.col("c").alias("at")),
        lambda a, w: F.when((w["c"] > F.col("c")) & (a["need"] > 0) & (a["at"] == w["c"] - 1), F.struct((a["need"] - F.when(w["c"] < F.col("_stop"), w["width"]).otherwise(1e18)).alias("need"), w["c"].alias("at")))
        .when(w["c"] == F.col("c"), F.struct((a["need"] - w["width"]).alias("need"), a["at"].alias("at")))
        .otherwise(a),
        lambda a: a["at"],
    )
    return joined.groupBy(*keys).agg(F.max(reach).alias("last_col"))
