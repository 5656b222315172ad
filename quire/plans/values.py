"""Queries of single operators: labels, units, symbols, cascades, placements, pages, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import drawing, numfmt, scalars, typeset
from quire.functions import formula as X
from quire.operators import charts, condfmt, fidelity, lookups, numbering, pages, styles
from quire.plans.sheets import CELLS, TASK_BYTES, line_cells, staying, table
from quire.sources import sniff

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def chosen(k: Column, *values) -> Column:
    """The value of this number among the values, from 0, over and over."""
    return F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), (F.pmod(k, F.lit(len(values))) + 1).cast("int"))


# Conditional formats -----------------------------------------------------------------------------

@query(
    """WITH cells AS (SELECT CAST(l_suppkey % 3 AS INTEGER) AS doc_id, row_number() OVER (PARTITION BY l_suppkey % 3 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS r, l_quantity AS num FROM lineitem),
a AS (SELECT doc_id, avg(CASE WHEN r <= 30000 THEN num END) AS mean, max(CASE WHEN r <= 30000 THEN num END) AS top FROM cells GROUP BY 1)
SELECT doc_id, CASE WHEN num = top THEN 2 WHEN num > mean THEN 1 END AS dxf, count(*) AS n, CAST(sum(CAST(num AS BIGINT)) AS BIGINT) AS total FROM cells JOIN a USING (doc_id) GROUP BY 1, 2"""
)
def condfmt_range_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over a range of 30,000 cells: one grouped join for the range, whatever its size."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    doc = F.pmod("l_suppkey", F.lit(3)).cast("int")
    lines = table(spark, sf_dir, "lineitem").withColumn("doc_id", doc).withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))
    cells = lines.selectExpr("doc_id", "0 sheet_idx", "r", "1 c", "'number' kind", "l_quantity num", "cast(null as string) txt", "cast(null as boolean) flag")
    area = (1, 1, 2**31 - 1, 1)  # the whole column, however many lines a document has
    rules = (condfmt.Rule(area, 2, 1, "cellIs", "greaterThan", ("AVERAGE($A$1:$A$30000)",)), condfmt.Rule(area, 1, 2, "expression", "", ("A1=MAX($A$1:$A$30000)",)))
    return condfmt.apply_rules(cells, rules).groupBy("doc_id", "dxf").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("num").cast("long")).alias("total"))


@query(
    CELLS
    + """SELECT x.doc_id, x.r, CASE WHEN x.num > a.num THEN 1 WHEN x.r > 2 AND x.num < b.num THEN 2 END AS dxf
FROM cells x LEFT JOIN cells a ON a.doc_id = x.doc_id AND a.r = x.r - 1 AND a.c = 1 LEFT JOIN cells b ON b.doc_id = x.doc_id AND b.r = x.r - 2 AND b.c = 1 WHERE x.c = 1"""
)
def condfmt_origin_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative references move with the cell, from the rule's origin; those above the sheet fail."""
    cells = line_cells(spark, sf_dir).where("c = 1")
    rules = (
        condfmt.Rule((1, 1, 1_000_000, 1), 1, 1, "cellIs", "greaterThan", ("A4",), origin=(5, 1)),
        condfmt.Rule((1, 1, 1_000_000, 1), 2, 2, "cellIs", "lessThan", ("$A1",), origin=(3, 1)),
        condfmt.Rule((1, 1, 1_000_000, 1), 0, 9, "dataBar"),
    )
    return condfmt.apply_rules(cells, rules).select("doc_id", "r", "dxf")


@query(
    CELLS
    + """, m AS (SELECT o_orderkey AS doc_id, i AS ordinal, 1 + i AS r1, 1 AS c1, 3 + i AS r2, 2 + i AS c2 FROM orders, range(2) t(i) WHERE o_orderkey % 3 = 0)
SELECT cells.doc_id, r, c, CAST(min(ordinal) AS INTEGER) AS merge, count(*) AS n FROM cells JOIN m ON m.doc_id = cells.doc_id AND r BETWEEN r1 AND r2 AND c BETWEEN c1 AND c2 GROUP BY 1, 2, 3"""
)
def merge_of_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first merged rectangle that holds each cell."""
    areas = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").selectExpr("o_orderkey doc_id", "0 sheet_idx", "explode(array(0, 1)) ordinal")
    areas = areas.selectExpr("*", "1 + ordinal r1", "1 c1", "3 + ordinal r2", "2 + ordinal c2")
    found = condfmt.match_rectangles(line_cells(spark, sf_dir), areas)
    return found.groupBy("doc_id", "r", "c").agg(F.min("ordinal").alias("merge"), F.count(F.lit(1)).alias("n"))


# Formulas and formats ----------------------------------------------------------------------------

@query(
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_acctbal WHEN 1 THEN CAST(c_custkey AS DOUBLE) WHEN 3 THEN 12.5 END AS value,
  CASE c_custkey % 4 WHEN 0 THEN c_acctbal + 1 WHEN 1 THEN c_custkey + 1.0 WHEN 3 THEN 13.5 END AS more, CAST(NULL AS DOUBLE) AS unknown FROM customer"""
)
def formula_value_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VALUE and N of numbers and texts; text that is no number, and a function that is not known, fail."""
    k = F.col("c_custkey")
    text = F.when(k % 4 == 1, F.concat(F.lit(" "), k.cast("string"))).when(k % 4 == 3, F.lit("12.5")).otherwise(F.col("c_mktsegment"))
    cell = X.Val(F.when(k % 4 == 0, "n").otherwise("s"), F.col("c_acctbal"), text, F.lit(None).cast("boolean"))
    at = X.columns_as_cells({"A": cell})
    unknown = X.compile_formula("NOSUCH(A1)", at)
    return table(spark, sf_dir, "customer").select(
        "c_custkey", X.compile_formula("VALUE(A1)", at).n.alias("value"), X.compile_formula("N(A1)+1", at).n.alias("more"),
        (F.lit(None).cast("double") if unknown is None else unknown.n).alias("unknown"),
    )


@query(
    """SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS id1, printf('%.2f', o_totalprice) AS id2, printf('%.0f%%', o_orderkey * 100.0) AS id9, 'n: ' || o_orderkey || ' m-x' AS literals,
  '<' || o_orderstatus || '>' AS as_text, o_orderstatus AS plain, (o_orderkey || '') AS dropped FROM orders"""
)
def numfmt_builtin_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built-in codes by number, quoted and escaped literals, room and fill marks, text sections."""
    v = F.col("o_orderkey").cast("double")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", numfmt.format_value(v, numfmt.BUILTIN[1]).alias("id1"), numfmt.format_value(F.col("o_totalprice"), numfmt.BUILTIN[2]).alias("id2"), numfmt.format_value(v, numfmt.BUILTIN[9]).alias("id9"),
        numfmt.format_value(v, '"n: "0_)"m"\\-\\x').alias("literals"), numfmt.format_text(F.col("o_orderstatus"), '0;0;0;"<"@">"').alias("as_text"), numfmt.format_text(F.col("o_orderstatus"), "0.00").alias("plain"),
        numfmt.format_value(v, "[>5][Red]0*x").alias("dropped"),
    )


@query(
    """SELECT p_partkey, CAST(p_size * 2 + 100 AS DOUBLE) AS plain, CAST(greatest(p_size - 25, 0) AS DOUBLE) AS chosen, sqrt(CAST(p_size * p_size + 16 AS DOUBLE)) AS far, p_size / 2 AS modified FROM part"""
)
def drawing_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas of shapes: arithmetic, choice, roots, other equations and modifiers."""
    names = F.create_map(F.lit("width"), F.col("p_size").cast("double"))
    equations = F.create_map(F.lit("a"), F.lit("width*2"), F.lit("b"), F.lit("width - 25"))
    modifiers = F.array(F.col("p_size").cast("double"), F.lit(200.0))
    value = lambda text: drawing.equation(F.lit(text), equations, modifiers, names)
    # The table's few files are small beside the work on their rows.
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return parts.select("p_partkey", value("?a + 100").alias("plain"), value("if(?b, ?b, 0)").alias("chosen"), value("sqrt(width*width+16)").alias("far"), value("$0 * 100 / $1").alias("modified"))


# Symbols, units and names ------------------------------------------------------------------------

@query(
    """SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN '•' WHEN 1 THEN '❖' WHEN 2 THEN '•' ELSE '-' END AS bullet, CASE n_nationkey % 3 WHEN 0 THEN '#ffa500' WHEN 1 THEN '#808080' END AS preset,
  CASE n_nationkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 1.5 WHEN 2 THEN 0.25 WHEN 3 THEN 0.5 END::DOUBLE AS border,
  CASE n_nationkey % 3 WHEN 0 THEN 595.3 WHEN 1 THEN 612.0 ELSE 1031.8 END::DOUBLE AS paper_w, CASE n_nationkey % 3 WHEN 0 THEN 841.9 WHEN 1 THEN 792.0 ELSE 1459.8 END::DOUBLE AS paper_h,
  CASE n_nationkey % 5 WHEN 0 THEN 'Liberation Sans' WHEN 1 THEN 'Carlito' WHEN 2 THEN 'Liberation Serif' WHEN 3 THEN 'Liberation Mono' ELSE 'OpenSymbol' END AS family,
  CASE n_nationkey % 3 WHEN 0 THEN '#ff0000' WHEN 1 THEN '#000000' ELSE '#ffffff' END AS indexed FROM nation"""
)
def symbols_and_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bullets, named colours, border widths, paper sizes, font families and indexed colours."""
    k = F.col("n_nationkey")
    paper = scalars.paper_size(chosen(k, 9, 1, 12))
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", scalars.bullet_text(chosen(k, "", "", "", "-")).alias("bullet"), drawing.preset_colour(chosen(k, "Orange", "grey", "nosuch")).alias("preset"),
        scalars.border_width(chosen(k, "medium", "double", "hair", "thin", "none")).alias("border"), paper["width"].alias("paper_w"), paper["height"].alias("paper_h"),
        typeset.font_alias(chosen(k, "Verdana", " Calibri ", "Unknown Roman", "Some Mono Font", "Wingdings 2")).alias("family"), scalars.indexed_colour(chosen(k, 10, 64, 65)).alias("indexed"),
    )


@query(
    """SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN p_size * 1.0 WHEN 1 THEN p_size * 72.0 WHEN 2 THEN p_size * (72 / 2.54) WHEN 3 THEN p_size * 12.0 WHEN 4 THEN p_size * 0.75 END AS points,
  p_size / 100.0 AS share, p_size / 12700.0 AS emu, p_size / 20.0 AS twips, p_size / 2.0 AS halves, CASE WHEN p_brand LIKE '%1%' THEN 0.507 WHEN p_brand LIKE '%2%' THEN 0.5 ELSE 0.556 END::DOUBLE * p_size AS digit FROM part"""
)
def lengths_in_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths with units, percentages, the formats' own units, and digit widths."""
    size = F.col("p_size")
    text = F.concat(size.cast("string"), chosen(size, "pt", "in", "cm", " pc", "px", "em"))
    family = F.when(F.col("p_brand").contains("1"), "Calibri Light").when(F.col("p_brand").contains("2"), "Times New Roman").otherwise("Arial")
    return table(spark, sf_dir, "part").select(
        "p_partkey", scalars.length_points(text).alias("points"), scalars.percent_share(F.concat(size.cast("string"), F.lit("%"))).alias("share"), scalars.emu_points(size).alias("emu"),
        scalars.twip_points(size).alias("twips"), scalars.half_points(size).alias("halves"), scalars.digit_width(size.cast("double"), family).alias("digit"),
    )


@query(
    """SELECT s_suppkey, replace(replace(s_name, '#', '_23_'), ' ', '_20_') AS style_name, s_suppkey || '-' || 'x' AS style_attribute, upper(regexp_extract(s_name, '^(.)(\\w+)', 2)) AS small_text, 0.8::DOUBLE AS small_scale,
  '[' || s_suppkey || '|S|Page ]' AS header_left, 's' || s_suppkey AS header_right FROM supplier"""
)
def names_and_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded style names, style attributes, small capitals, header codes."""
    k = F.col("s_suppkey").cast("string")
    small = scalars.small_caps("s_name")[1]
    attribute = drawing.vml_style(F.concat(F.lit("left: 1pt;width :"), k, F.lit("; left : x;junk")))
    runs = drawing.header_runs(F.concat(F.lit("&L&B["), k, F.lit('|&"Arial,Bold"&12S|Page ]&R&A')), F.concat(F.lit("s"), k))
    zone = lambda z: F.array_join(F.transform(F.filter("_runs", lambda p: p["zone"] == z), lambda p: p["text"]), "")
    return table(spark, sf_dir, "supplier").withColumn("_runs", runs).select(
        "s_suppkey", drawing.encode_style_name("s_name").alias("style_name"), F.concat_ws("-", F.trim(attribute["width"]), attribute["left"]).alias("style_attribute"),
        small["text"].alias("small_text"), small["scale"].alias("small_scale"), zone("left").alias("header_left"), zone("right").alias("header_right"),
    )


@query(
    """SELECT p_partkey, string_split(p_name || ' ' || p_brand || '-' || p_size, ' ')[1] || ' ' AS first_token, len(string_split(p_name || ' ' || p_brand, ' ')) AS n_tokens,
  replace(p_type || '-' || p_size, '-', '-' || chr(8203)) AS hyphened, CASE WHEN p_size % 4 = 0 THEN (p_size // 4) || 'pt' ELSE rtrim(printf('%.2f', p_size / 4.0), '0') || 'pt' END AS points, '"' || p_name || '\\"' || '\\\\' || '\\u{9}' || '"' AS literal FROM part"""
)
def typeset_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that keep their space, breaks behind hyphens, lengths and string literals of a typesetter."""
    size = F.col("p_size").cast("string")
    return table(spark, sf_dir, "part").select(
        "p_partkey", typeset.keep_space_tokens(F.concat_ws(" ", "p_name", F.concat_ws("-", "p_brand", size)))[0].alias("first_token"), F.size(typeset.keep_space_tokens(F.concat_ws(" ", "p_name", "p_brand"))).cast("long").alias("n_tokens"),
        typeset.hyphen_breaks(F.concat_ws("-", "p_type", size)).alias("hyphened"), typeset.points_text(F.col("p_size") / 4.0).alias("points"), typeset.quoted(F.concat("p_name", F.lit('"\\\t'))).alias("literal"),
    )


@query(
    """SELECT p_partkey, p_name AS decoded, CAST(p_size AS INTEGER) AS width, CAST(p_partkey % 65536 AS INTEGER) AS height, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS from_uri FROM part"""
)
def images_and_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base64 with foreign characters, pixel sizes from PNG headers, data: addresses."""
    coded = F.base64(F.encode("p_name", "UTF-8"))
    four = lambda n: F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0"))
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), four(F.col("p_size")), four(F.col("p_partkey") % 65536))
    uri = F.concat(F.when(F.col("p_partkey") % 2 == 0, "data:image/png;base64,").otherwise("http:"), coded)
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.decode(sniff.base64_bytes(F.concat(F.lit("!"), coded, F.lit("\n"))), "UTF-8").alias("decoded"), sniff.png_size(png)["width"].alias("width"), sniff.png_size(png)["height"].alias("height"),
        F.decode(sniff.data_uri(uri), "UTF-8").alias("from_uri"),
    )


# Numbering and slides ----------------------------------------------------------------------------

@query(
    """WITH i AS (SELECT n_regionkey, n_nationkey, n_nationkey // 5 % 2 AS level, n_name FROM nation),
g AS (SELECT *, sum(CASE WHEN level = 0 THEN 1 ELSE 0 END) OVER w AS a, row_number() OVER w AS k FROM i WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, CASE WHEN level = 0 THEN 0 ELSE sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY n_regionkey, a ORDER BY n_nationkey ROWS UNBOUNDED PRECEDING) END AS b FROM g)
SELECT n_regionkey, n_nationkey, CASE WHEN level = 0 THEN '(' || a || ')' ELSE '(' || greatest(a, 1) || '.' || chr(CAST(96 + greatest(b, 1) AS INTEGER)) || ')' END AS odf,
  CASE WHEN level = 0 THEN a || ':' ELSE greatest(a, 1) || '/' || chr(CAST(64 + greatest(b, 1) AS INTEGER)) || ':' END AS doc, CAST(CASE WHEN level = 0 THEN a ELSE b END AS BIGINT) AS auto FROM c"""
)
def labels_of_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OpenDocument and binary list labels, and slide numbering, of two levels."""
    items = table(spark, sf_dir, "nation").selectExpr("n_regionkey", "n_nationkey", "n_nationkey div 5 % 2 level", "n_name")
    counted = numbering.auto_numbers(items, ["n_regionkey"], "n_nationkey", "level", "n_name", 2)
    counts, forms = F.col("counts"), ("decimal", "lowerLetter")
    odf = [numbering.odf_label(counts, k, forms, "(", ")", 2) for k in (0, 1)]
    doc = [numbering.doc_label(counts, t, ("decimal", "upperLetter")) for t in ("\x00:", "\x00/\x01:")]
    by_level = lambda x: F.when(F.col("level") == 0, x[0]).otherwise(x[1])
    return counted.select("n_regionkey", "n_nationkey", by_level(odf).alias("odf"), by_level(doc).alias("doc"), F.element_at(counts, (F.col("level") + 1).cast("int")).alias("auto"))


@query("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS number FROM conversations WHERE role <> 'assistant'")
def slides_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides that are shown, numbered among themselves."""
    slides = table(spark, sf_dir, "conversations").withColumn("shown", F.col("role") != "assistant")
    return numbering.visible_numbers(slides, ["conv_id"], "turn", "shown").select("conv_id", "turn", "number")


@query(
    """WITH s AS (SELECT c_custkey, c_custkey % 10 AS doc_id, CASE c_custkey % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'body' ELSE 'ftr' END AS type, c_custkey % 4 AS idx, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal END AS size FROM customer)
SELECT c_custkey, coalesce(size, CASE WHEN type = 'title' THEN CASE WHEN doc_id % 2 = 0 THEN 40.0 END WHEN type = 'body' AND idx = 1 THEN 20.0 END, CASE type WHEN 'title' THEN 44.0 WHEN 'ftr' THEN 9.0 END) AS size FROM s"""
)
def placeholder_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders take what they leave out from their layout, then from the master: by type, or by index."""
    shapes = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 10).alias("doc_id"), chosen(F.col("c_custkey"), "title", "body", "ftr").alias("type"), (F.col("c_custkey") % 4).alias("idx"), F.when(F.col("c_custkey") % 5 == 0, F.col("c_acctbal")).alias("size"))
    docs = spark.range(10).withColumnRenamed("id", "doc_id")
    rows = lambda *r: docs.selectExpr("doc_id", f"inline(array({', '.join(r)}))")
    named = lambda k, kind, idx, size: f"named_struct('ordinal', {k}, 'type', '{kind}', 'idx', cast({idx} as bigint), 'size', cast({size} as double))"
    layout = rows(named(0, "ctrTitle", 0, "case when doc_id % 2 = 0 then 40 end"), named(1, "body", 1, 20), named(2, "body", 1, 99))
    master = rows(named(0, "title", 0, 44), named(1, "ftr", 3, 9), named(2, "title", 0, 99))
    return lookups.placeholders(shapes, layout, master, ["size"]).select("c_custkey", "size")


# Cascades ----------------------------------------------------------------------------------------

@query(
    """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS n_stops, CASE c_custkey % 3 WHEN 0 THEN 18.0 WHEN 1 THEN 36.0 ELSE 72.0 END::DOUBLE AS first_stop, CASE c_custkey % 3 WHEN 0 THEN 18.0 WHEN 1 THEN 10.0 ELSE 12.0 END::DOUBLE AS size,
  CASE c_custkey % 5 WHEN 0 THEN FALSE WHEN 1 THEN TRUE WHEN 2 THEN c_custkey % 2 = 0 WHEN 3 THEN c_custkey % 2 = 1 ELSE c_custkey % 2 = 0 END AS bold FROM customer"""
)
def tabs_sizes_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab stops that add up, replace and clear; relative sizes along a chain; toggled marks."""
    k = F.col("c_custkey")
    stop = lambda at, clear=False: F.struct(F.lit(float(at)).alias("at"), F.lit(clear).alias("clear"))
    weak = F.array(stop(36), stop(72))
    strong = F.when(k % 3 == 0, F.array(stop(18))).when(k % 3 == 1, F.array(stop(72.005))).otherwise(F.array(stop(36, True)))
    tabs = styles.merge_tabs(weak, strong)
    link = lambda size, percent: F.struct(F.lit(size).cast("double").alias("size"), F.lit(percent).cast("double").alias("percent"))
    chain = F.when(k % 3 == 0, F.array(link(None, 150.0))).when(k % 3 == 1, F.array(link(20.0, None), link(None, 50.0))).otherwise(F.array(link(None, None)))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.size(tabs).alias("n_stops"), tabs[0]["at"].alias("first_stop"), styles.relative_size(chain, F.lit(12.0)).alias("size"),
        styles.toggle(k % 2 == 0, chosen(k, 0, 1, 128, 129, 128)).alias("bold"),
    )


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_size < 30 THEN CASE WHEN p_size < 20 THEN 20.0 ELSE 30.0 END WHEN p_size < 20 THEN 20.0 ELSE 54.0 END::DOUBLE AS stop FROM part"""
)
def tab_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next stop: explicit ones, the indent where it hangs, else the grid."""
    k = F.col("p_partkey")
    at = scalars.next_tab(F.array(F.lit(20.0), F.lit(54.0)), F.col("p_size").cast("double"), F.lit(30.0), F.when(k % 2 == 0, 10.0).otherwise(0.0), F.lit(36.0))
    return table(spark, sf_dir, "part").select("p_partkey", at.alias("stop"))


@query(
    """SELECT p_partkey, 18 + (CAST(p_size AS DOUBLE) - 3) AS x, 28 + (CAST(p_size AS DOUBLE) * 2 - 4) AS y, CAST(p_size AS DOUBLE) AS w, CAST(p_size AS DOUBLE) * 2 AS h FROM part"""
)
def group_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes inside two nested groups, in slide points."""
    size = F.col("p_size").cast("double")
    struct = lambda **v: F.struct(*[(x if isinstance(x, Column) else F.lit(float(x))).alias(n) for n, x in v.items()])
    outer, inner = struct(x=10, y=20, w=200, h=200, cx=1, cy=2, cw=100, ch=100), struct(x=5, y=6, w=50, h=50, cx=3, cy=4, cw=100, ch=100)
    out = drawing.placed(struct(x=size, y=size * 2, w=size, h=size * 2), F.array(outer, inner))
    return table(spark, sf_dir, "part").select("p_partkey", *[out[n].alias(n) for n in "xywh"])


# Lines, pages and tables -------------------------------------------------------------------------

@query(
    """SELECT o_custkey, max(9 * size) AS above, max(3 * size) AS below, max(9 * size) + max(3 * size) AS height FROM (SELECT o_custkey, 8 + o_orderkey % 7 AS size FROM orders WHERE o_orderstatus <> 'F') GROUP BY 1"""
)
def paragraph_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Natural line heights: the largest parts above and below among the runs with text."""
    runs = table(spark, sf_dir, "orders").selectExpr("o_custkey", "case when o_orderstatus = 'F' then '' else o_orderstatus end text", "8.0D + o_orderkey % 7 size", "0.9D ascender", "0.2D descender", "0.1D line_gap")
    return typeset.paragraph_lines(runs, ["o_custkey"]).select("o_custkey", *[F.round(F.col(n) * 10).cast("long").alias(n) for n in ("above", "below", "height")])


@query(
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 AND p_size = 3 THEN '' WHEN p_size % 2 = 0 AND p_partkey % 2 = 0 THEN 'even' ELSE 'default' END AS slot,
  CAST(round(CASE p_partkey % 3 WHEN 0 THEN 30.0 WHEN 1 THEN greatest(p_size * 1.2, 20.0) ELSE 1.5 * p_size * 1.2 END * 1000) AS BIGINT) AS line FROM part"""
)
def margins_and_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header slots by page, and the height of a line by its spacing rule."""
    k, size = F.col("p_partkey"), F.col("p_size")
    slots = F.struct(F.lit("default").alias("default"), F.lit(None).cast("string").alias("first"), F.lit("even").alias("even"))
    slot = typeset.margin_slot(size, F.lit(3), size % 3 == 0, k % 2 == 0, slots)
    spacing = F.struct(chosen(k, "exact", "at_least", "multiple").alias("kind"), chosen(k, 30.0, 20.0, 1.5).alias("value"))
    edges = typeset.line_edges(size.cast("double"), spacing)
    tall = F.when((k % 3 == 0) & (size * 0.2 > 30), 30.0).otherwise(edges["above"] + edges["below"])
    return table(spark, sf_dir, "part").select("p_partkey", slot.alias("slot"), F.round(tall * 1000).cast("long").alias("line"))


@query("SELECT o_custkey, max(n) AS width FROM (SELECT o_custkey, o_orderpriority, sum(1 + o_orderkey % 3) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def table_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a table: the most that a row's spans come to."""
    cells = table(spark, sf_dir, "orders").selectExpr("o_custkey", "o_orderpriority r", "1 + o_orderkey % 3 span")
    return typeset.grid_width(cells, ["o_custkey"]).select("o_custkey", F.col("width").cast("long").alias("width"))


@query(
    """WITH c AS (SELECT n_regionkey AS doc_id, n_nationkey % 5 + 1 AS r, n_nationkey AS k FROM nation)
SELECT doc_id, r, 1 + k % 2 AS c, CASE WHEN r > 3 THEN 2 ELSE 1 END AS page, CAST(40 * (1 + k % 2) AS DOUBLE) AS x, CAST(10 * (CASE WHEN r > 3 THEN r - 4 ELSE r - 1 END) AS DOUBLE) AS y, 'note ' || k AS text FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS r, k FROM c)"""
)
def comments_on_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments on their pages, placed behind their column and at their row."""
    keys = ["doc_id"]
    row = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    notes = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("doc_id"), row.cast("long").alias("r"), (1 + F.col("n_nationkey") % 2).alias("c"), F.concat(F.lit("note "), F.col("n_nationkey").cast("string")).alias("text"))
    docs = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("doc_id"))
    rows = docs.selectExpr("doc_id", "explode(sequence(1, 6)) r").selectExpr("*", "10.0D height", "false hidden", "r = 3 break_after")
    columns = docs.selectExpr("doc_id", "explode(sequence(1, 2)) c").selectExpr("*", "40.0D width", "false break_after")
    options = docs.selectExpr("doc_id", "500.0D printable_w", "500.0D printable_h", "1.0D scale", "false fit_to_page", "0 fit_width", "0 fit_height", "false over_then_down")
    found = pages.page_notes(notes, pages.sheet_pages(rows, columns, options, keys), rows, columns, keys)
    return found.select("doc_id", "r", "c", "page", "x", "y", "text")


# Charts and fidelity -----------------------------------------------------------------------------

@query(
    """SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN n_name WHEN 1 THEN 'only' END AS title, CASE n_nationkey % 4 WHEN 3 THEN 'plain' ELSE CASE WHEN n_nationkey = 0 THEN 'header' WHEN (n_nationkey - 1) % 2 = 0 THEN 'band1' ELSE 'band2' END END AS look FROM nation"""
)
def chart_titles_table_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of charts: explicit, or of a single series; looks of table rows."""
    k = F.col("n_nationkey")
    title = charts.chart_title(F.when(k % 4 == 0, F.col("n_name")), F.when(k % 4 == 3, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("only"))), k % 4 == 2)
    return table(spark, sf_dir, "nation").select("n_nationkey", title.alias("title"), charts.table_band(k, F.lit(True), k % 4 != 3).alias("look"))


@query("SELECT event_type, count(*) AS runs, median(CAST(value * 100 AS BIGINT)) AS warm_ms FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS round FROM events) WHERE round > 1 GROUP BY 1")
def median_warm_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median time by engine without each case's first round, which is cold."""
    first = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    warm = table(spark, sf_dir, "events").withColumn("round", first).where("round > 1")
    return warm.groupBy("event_type").agg(F.count(F.lit(1)).alias("runs"), F.median(F.round(F.col("value") * 100).cast("long")).alias("warm_ms"))


@query(
    """WITH b AS (SELECT o_custkey, min(o_totalprice) AS previous FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1)
SELECT o_orderkey, o_custkey, o_totalprice AS price, previous AS previous_price FROM orders LEFT JOIN b USING (o_custkey) WHERE o_orderkey % 2 = 1"""
)
def previous_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of the run before beside this one's."""
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey", "o_totalprice price")
    return fidelity.with_previous(rows.where("o_orderkey % 2 = 1"), rows.where("o_orderkey % 2 = 0"), ["o_custkey"], "price")


@query(
    CELLS
    + """, m AS (SELECT doc_id, max(r) AS n FROM cells GROUP BY 1), p AS (SELECT doc_id, unnest(range(1, n + 2)) AS pos FROM m), s AS (SELECT p.*, i AS series_idx FROM p, range(2) t(i))
SELECT s.doc_id, CAST(series_idx AS INTEGER) AS series_idx, CASE WHEN series_idx = 0 THEN printf('%.1f', f.num) END AS series_name, CAST(s.pos AS INTEGER) AS pos, CASE WHEN s.pos <= 2 THEN coalesce(k.txt, '') ELSE s.pos || '' END AS category,
  v.num AS value FROM s LEFT JOIN cells v ON v.doc_id = s.doc_id AND v.r = s.pos AND v.c = series_idx + 1 LEFT JOIN cells k ON k.doc_id = s.doc_id AND k.r = s.pos AND k.c = 4 LEFT JOIN cells f ON f.doc_id = s.doc_id AND f.r = 1 AND f.c = 1"""
)
def chart_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charts of a sheet: values, categories and names from the areas that they refer to."""
    cells = line_cells(staying(spark), sf_dir, TASK_BYTES // 4).withColumn("shown", F.coalesce("txt", F.call_function("format_number", F.col("num"), F.lit("0.0"))))
    last = cells.groupBy("doc_id", "sheet_idx").agg(F.max("r").cast("int").alias("n"))
    area = "struct(0 as chart, {} as series_idx, '{}' as role, 1 as r1, {} as c1, {} as r2, {} as c2)"
    areas = [area.format(k, "values", k + 1, "n + 1", k + 1) for k in (0, 1)] + [area.format(0, "categories", 4, 2, 4), area.format(0, "name", 1, 1, 1)]
    spread = last.selectExpr("doc_id", "sheet_idx", f"inline(array({', '.join(areas)}))")
    return charts.area_points(spread, cells).select("doc_id", "series_idx", "series_name", "pos", "category", "value")


@query(
    """WITH d AS (SELECT p_partkey, p_partkey % 20 AS doc_id, CAST(p_size * 7 AS DOUBLE) AS x, CAST(p_size * 3 AS DOUBLE) AS y FROM part),
c AS (SELECT *, greatest(ceil(x / 50) - 1, 0) AS ci, greatest(ceil(y / 20) - 1, 0) AS ri FROM d)
SELECT p_partkey, CAST(ci + 1 AS INTEGER) AS c, CAST(ri + 1 AS INTEGER) AS r, CAST(1 + floor(ri / 4) + 2 * floor(ci / 4) AS INTEGER) AS page, (x - 200 * floor(ci / 4)) / 2 AS x, (y - 80 * floor(ri / 4)) / 2 AS y FROM c WHERE ri < 8 AND ci < 8"""
)
def drawings_on_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawings on the page of the cell under their corner, placed from the page's corner."""
    keys = ["doc_id"]
    drawn = table(spark, sf_dir, "part").selectExpr("p_partkey % 20 doc_id", "p_partkey", "cast(p_size * 7 as double) x", "cast(p_size * 3 as double) y")
    docs = spark.range(20).withColumnRenamed("id", "doc_id")
    rows = docs.selectExpr("doc_id", "explode(sequence(1, 8)) r").selectExpr("*", "20.0D height", "false hidden", "false break_after")
    columns = docs.selectExpr("doc_id", "explode(sequence(1, 8)) c").selectExpr("*", "50.0D width", "false break_after")
    options = docs.selectExpr("doc_id", "100.0D printable_w", "40.0D printable_h", "0.5D scale", "false fit_to_page", "0 fit_width", "0 fit_height", "false over_then_down")
    found = pages.drawings_on_pages(drawn, pages.sheet_pages(rows, columns, options, keys), rows, columns, keys)
    return found.select("p_partkey", "c", "r", "page", "x", "y")


@query(
    """WITH c AS (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, r, CASE WHEN o_orderkey % 5 = 0 THEN 'none' WHEN r = 0 THEN 'outer' ELSE 'inner' END AS top, CASE WHEN r = n - 1 THEN 'outer' ELSE 'inner' END AS bottom, 'outer' AS "left", CASE WHEN r > 0 AND o_orderkey % 2 = 0 THEN 'own' ELSE 'outer' END AS "right" FROM c"""
)
def table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides of table cells: their own, the table's at its edges, the inner lines between."""
    k = F.col("o_orderkey")
    row = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("int")
    none = F.lit(None).cast("string")
    cells = table(spark, sf_dir, "orders").select("o_custkey", row.alias("r"), F.lit(0).alias("c"), F.lit(1).alias("span"), F.when(k % 5 == 0, "none").alias("top"), none.alias("bottom"), none.alias("left"), F.when((row > 0) & (k % 2 == 0), "own").alias("right"))
    lines = F.struct(*[F.lit(v).alias(n) for n, v in (("top", "outer"), ("right", "outer"), ("bottom", "outer"), ("left", "outer"), ("inside_h", "inner"), ("inside_v", "inner"))])
    return styles.table_borders(cells, ["o_custkey"], lines).select("o_custkey", "r", "top", "bottom", "left", "right")


@query(
    """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 AND turn < 6 AND role = 'user' THEN 'outline' WHEN role <> 'user' THEN 'own' END AS num_id, CASE WHEN role <> 'user' THEN 7 WHEN turn % 3 = 0 AND turn < 6 THEN CAST(turn // 3 AS INTEGER) END AS list_level FROM conversations"""
)
def outline_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings without a list take the outline's numbering where its level has one."""
    turn, own = F.col("turn"), F.col("role") != "user"
    blocks = table(spark, sf_dir, "conversations").select("conv_id", F.col("conv_id").alias("doc_id"), "turn", F.when(turn % 3 == 0, (turn / 3).cast("int")).alias("outline"), F.when(own, "own").alias("num_id"), F.when(own, 7).alias("list_level"))
    levels = table(spark, sf_dir, "conversations").selectExpr("conv_id doc_id").distinct().selectExpr("doc_id", "inline(array(struct(0, true), struct(1, true)))").toDF("doc_id", "level", "numbered")
    return numbering.outline_lists(blocks, levels).select("conv_id", "turn", "num_id", "list_level")


@query(
    """WITH p AS (SELECT c_custkey, c_custkey % 10 AS doc_id, c_custkey % 3 AS level, CASE c_custkey % 4 WHEN 0 THEN 'title' WHEN 1 THEN 'body' ELSE 'other' END AS kind, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal END AS size FROM customer)
SELECT c_custkey, coalesce(size, CASE WHEN c_custkey % 5 = 0 AND level = 0 THEN 11.0 END, CASE WHEN kind = 'body' AND level < 2 THEN 24.0 - level END, CASE WHEN kind = 'title' THEN 44.0 WHEN kind = 'body' THEN 32.0 - 2 * level END, 18.0)::DOUBLE AS size,
  CASE WHEN kind = 'body' AND level < 2 THEN 'left' WHEN kind = 'title' THEN 'center' END AS align FROM p"""
)
def slide_text_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text on slides by level: shape, layout, master and default layers, the strongest that sets a property."""
    k = F.col("c_custkey")
    kind = F.when(k % 4 == 0, "title").when(k % 4 == 1, "body").otherwise("other")
    paras = table(spark, sf_dir, "customer").select("c_custkey", (k % 10).alias("doc_id"), (k % 3).cast("int").alias("level"), F.when(k % 7 == 0, F.col("c_acctbal")).alias("size"), F.lit(None).cast("string").alias("align"), kind.alias("text_owner"))
    none = F.lit(None).cast("string")
    paras = paras.withColumns({"default_owner": F.lit("all"), "master_owner": none, "layout_owner": F.when(F.col("text_owner") == "body", "ph1"), "shape_owner": F.when(k % 5 == 0, "s")})
    row = lambda scope, owner, level, size, align="null": f"struct('{scope}', '{owner}', {level}, cast({size} as double), cast({align} as string))"
    rows = [row("default", "all", n, 18) for n in range(3)] + [row("text", "title", n, 44, "'center'") for n in range(3)] + [row("text", "body", n, 32 - 2 * n) for n in range(3)]
    rows += [row("layout", "ph1", n, 24 - n, "'left'") for n in range(2)] + [row("shape", "s", 0, 11)]
    levels = spark.range(10).selectExpr("id doc_id", f"inline(array({', '.join(rows)}))").toDF("doc_id", "scope", "owner", "level", "size", "align")
    return lookups.level_properties(paras, levels, ["size", "align"]).select("c_custkey", "size", "align")


@query(
    """SELECT o_custkey AS doc_id, CAST(o_orderkey AS BIGINT) AS format_id, CAST(i AS INTEGER) AS level, CASE WHEN i = 0 AND o_orderkey % 2 = 0 THEN 5 WHEN i = 1 AND o_orderkey % 3 = 0 THEN 7 ELSE 1 END AS start,
  CASE WHEN i = 1 AND o_orderkey % 3 = 0 THEN 'upperRoman' ELSE 'decimal' END AS form, CASE WHEN i = 1 AND o_orderkey % 3 = 0 THEN o_orderstatus ELSE '%' || (i + 1) END AS text FROM orders, range(2) t(i)"""
)
def doc_list_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of list formats in binary documents: replaced levels, and starts alone."""
    orders = table(spark, sf_dir, "orders").selectExpr("o_custkey doc_id", "o_orderkey format_id", "o_orderstatus")
    instances = orders.selectExpr("doc_id", "format_id", "1 list_id")
    levels = orders.select("doc_id").distinct().selectExpr("doc_id", "1 list_id", "inline(array(struct(0, 1, 'decimal', '%1'), struct(1, 1, 'decimal', '%2')))").toDF("doc_id", "list_id", "level", "start", "form", "text")
    starts = orders.where("format_id % 2 = 0").selectExpr("doc_id", "format_id", "0 level", "5 start", "cast(null as string) form", "cast(null as string) text")
    whole = orders.where("format_id % 3 = 0").selectExpr("doc_id", "format_id", "1 level", "7 start", "'upperRoman' form", "o_orderstatus text")
    return lookups.list_formats(instances, levels, starts.unionByName(whole)).select("doc_id", "format_id", "level", "start", "form", "text")


@query(
    """SELECT p_partkey, p_size * (11.0::DOUBLE * 0.507) AS width, CASE WHEN p_size % 2 = 0 THEN 0.0::DOUBLE ELSE p_size * (10.0::DOUBLE * 0.556) END AS shown, least(p_size * 75, 1000)::DOUBLE AS picture_w, CASE WHEN p_size * 75 > 1000 THEN (p_size * 30) * (1000.0::DOUBLE / (p_size * 75)) ELSE (30 * p_size)::DOUBLE END AS picture_h,
  CAST(CASE WHEN p_size = 1 THEN 7 WHEN p_size <= 4 THEN 2 * p_size + 2 WHEN p_size <= 9 THEN p_size + 2 WHEN p_size <= 18 THEN p_size // 2 + 2 WHEN p_size <= 45 THEN p_size // 5 + 2 ELSE p_size // 10 + 2 END AS INTEGER) AS n_ticks FROM part"""
)
def widths_pictures_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column widths from characters, pictures clamped to the text's width, ticks of axes."""
    size = F.col("p_size").cast("double")
    picture = scalars.clamped_size(size * 75, size * 30, F.lit(1000.0))
    ticks = scalars.axis_ticks(scalars.nice_axis(F.lit(0.0), size))
    return table(spark, sf_dir, "part").select(
        "p_partkey", scalars.column_points(size, F.lit(11.0), F.lit("Calibri")).alias("width"), scalars.column_points(size, F.lit(10.0), F.lit("Arial"), F.col("p_size") % 2 == 0).alias("shown"),
        picture["width"].alias("picture_w"), picture["height"].alias("picture_h"), F.size(ticks).alias("n_ticks"),
    )


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 1.0 WHEN c_custkey % 3 = 0 THEN 36.0 WHEN c_custkey % 5 = 0 THEN 9.0 ELSE 0.0 END::DOUBLE AS indent, CASE WHEN c_custkey % 5 = 0 THEN 4.0 ELSE 2.0 END::DOUBLE AS space, CASE WHEN c_custkey % 4 = 0 THEN 'none' ELSE 'single' END AS side FROM customer"""
)
def paragraph_merge_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults, style, numbering level, direct properties: later layers win; a border's space only above 0, and none is a side."""
    k = F.col("c_custkey")
    indent = styles.merge(F.lit(0.0), F.when(k % 5 == 0, 9.0), F.when(k % 3 == 0, 36.0), F.when(k % 2 == 0, 1.0))
    space = styles.merge_border_space(F.lit(2.0), F.when(k % 5 == 0, 4.0).when(k % 3 == 0, 0.0))
    return table(spark, sf_dir, "customer").select("c_custkey", indent.alias("indent"), space.alias("space"), styles.merge_border(F.lit("single"), F.when(k % 4 == 0, "none")).alias("side"))
