"""Document queries over the driver's tables: numbering, runs, styles, charts, text, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import scalars
from quire.operators import charts, fidelity, layout, lookups, numbering, styles
from quire.plans.sheets import LINE_ORDER, line_cells, table
from quire.sources import sniff

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# Numbering ---------------------------------------------------------------------------------------

OUTLINE = """
WITH items AS (
  SELECT r_regionkey AS region, 0 AS lvl, 0 AS a, 0 AS b, r_name AS name FROM region
  UNION ALL SELECT n_regionkey, 1, n_nationkey + 1, 0, n_name FROM nation
  UNION ALL SELECT n_regionkey, 2, n_nationkey + 1, CAST(s_suppkey AS INTEGER), s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
)
"""


def _outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, its nations, their suppliers: three levels of one list, in order. A supplier with key 0
    has its nation's place and stands below it, whichever row the exchange brings first."""
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    out = region.selectExpr("r_regionkey region", "0 lvl", "0 a", "0 b", "r_name name")
    out = out.unionByName(nation.selectExpr("n_regionkey region", "1 lvl", "n_nationkey + 1 a", "0 b", "n_name name"))
    third = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
    out = out.unionByName(third.selectExpr("n_regionkey region", "2 lvl", "n_nationkey + 1 a", "cast(s_suppkey as int) b", "s_name name"))
    return out.withColumn("ord", F.struct("a", "b", "lvl"))


@query(
    OUTLINE
    + """, n AS (
  SELECT *, sum(CASE WHEN lvl = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY region ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS second,
         CASE WHEN lvl = 2 THEN row_number() OVER (PARTITION BY region, a, lvl ORDER BY b) ELSE 0 END AS third FROM items
)
SELECT region, name, lvl, CASE lvl WHEN 0 THEN '1.' WHEN 1 THEN '1.' || CAST(second AS VARCHAR) ELSE '1.' || CAST(second AS VARCHAR) || '.' || CAST(third AS VARCHAR) END AS label FROM n"""
)
def list_numbering_3level(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = numbering.level_counts(_outline(spark, sf_dir), ["region"], "ord", "lvl", 3)
    forms = ("decimal",) * 3
    text = F.when(F.col("lvl") == 0, numbering.label(F.col("counts"), "%1.", forms)).when(F.col("lvl") == 1, numbering.label(F.col("counts"), "%1.%2", forms)).otherwise(numbering.label(F.col("counts"), "%1.%2.%3", forms))
    return items.select("region", "name", "lvl", text.alias("label"))


@query(
    """WITH i AS (SELECT o_custkey, o_orderkey, o_orderkey % 2 AS num, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n,
    row_number() OVER (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY o_orderkey) AS own FROM orders),
f AS (SELECT o_custkey, min(CASE WHEN num = 1 THEN n END) AS first_odd FROM i GROUP BY 1)
SELECT i.o_custkey, o_orderkey, CAST(CASE WHEN first_odd IS NULL OR n < first_odd THEN n ELSE n - first_odd + 10 END AS BIGINT) AS number FROM i JOIN f ON i.o_custkey = f.o_custkey"""
)
def list_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two instances share a list; the first use of the second one restarts it at 10."""
    orders = table(spark, sf_dir, "orders")
    items = orders.selectExpr("o_custkey doc_id", "o_orderkey ord", "cast(o_orderkey % 2 as string) num_id", "0 level")
    docs = orders.selectExpr("o_custkey doc_id").distinct()
    instances = docs.selectExpr("doc_id", "'x' abstract_id", "array(1L) starts", "explode(map('0', cast(map() as map<int, bigint>), '1', map(0, 10L))) as (num_id, overrides)")
    out = numbering.counters_with_overrides(items, instances)
    return out.selectExpr("doc_id o_custkey", "ord o_orderkey", "counts[0] number")


@query("SELECT n_regionkey, n_name, 5 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS number FROM nation")
def markdown_list_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "nation").withColumn("start", F.lit(5))
    return numbering.item_numbers(items, ["n_regionkey"], "n_nationkey", "start").select("n_regionkey", "n_name", F.col("number").cast("long").alias("number"))


@query(
    """WITH s AS (SELECT conv_id, turn, role, text, coalesce(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS section FROM
  (SELECT conv_id, turn, min(role) AS role, min(text) AS text FROM conversations GROUP BY 1, 2))
SELECT conv_id, turn, CAST(section AS BIGINT) AS section FROM s"""
)
def section_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    turns = turns.withColumn("ends", F.coalesce(F.col("role") == "assistant", F.lit(False)))
    return numbering.running_sections(turns, ["conv_id"], "turn", "ends").select("conv_id", "turn", F.col("section").cast("long").alias("section"))


@query(
    """SELECT o_custkey, o_orderkey, last_value(CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN o_orderpriority END IGNORE NULLS) OVER
  (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS header FROM orders"""
)
def header_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("o_orderpriority").startswith("1") | F.col("o_orderpriority").startswith("2"), F.col("o_orderpriority"))
    df = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", own.alias("header"))
    return numbering.inherit_slots(df, ["o_custkey"], "o_orderkey", ["header"])


@query(
    """WITH m AS (SELECT *, o_orderkey % 3 = 0 AS deleted FROM orders), g AS (SELECT o_custkey, o_orderkey, o_orderstatus,
  coalesce(sum(CASE WHEN deleted THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM m)
SELECT o_custkey, min(o_orderkey) AS o_orderkey, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS o_orderstatus FROM g GROUP BY o_custkey, grp"""
)
def deleted_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").withColumn("deleted", F.col("o_orderkey") % 3 == 0)
    return numbering.join_deleted_marks(df, ["o_custkey"], "o_orderkey", "deleted", "o_orderstatus")


# Runs and gaps -----------------------------------------------------------------------------------

@query(
    """WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r, l_quantity, l_tax, l_discount FROM lineitem),
c AS (SELECT l_orderkey AS doc_id, r, 1 AS c, 10.0 + l_quantity AS width, true AS full_cell FROM l UNION ALL SELECT l_orderkey, r, 2, 20.0, l_tax > 0.04 FROM l UNION ALL SELECT l_orderkey, r, 3, 30.0, l_discount > 0.05 FROM l),
p AS (SELECT *, coalesce(sum(width) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos0, sum(width) OVER (PARTITION BY doc_id, r) AS total FROM c WINDOW w AS (PARTITION BY doc_id, r ORDER BY c)),
n AS (SELECT *, coalesce(min(CASE WHEN full_cell THEN pos0 END) OVER (PARTITION BY doc_id, r ORDER BY c ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), total) AS nxt FROM p)
SELECT doc_id, r, c, greatest(nxt - pos0 - 3.0, 1.0) AS room FROM n"""
)
def overflow_next_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = line_cells(spark, sf_dir).where("c in (1, 3, 4)")
    width = F.when(F.col("c") == 1, F.col("num") + 10.0).when(F.col("c") == 4, 20.0).otherwise(30.0)
    shown = cells.withColumn("width", width).withColumn("c", F.when(F.col("c") == 4, 2).otherwise(F.col("c")))
    kind = F.when(F.col("c") == 3, F.when(F.col("num") > 0.05, "number").otherwise("empty")).otherwise(F.col("kind"))
    return layout.overflow_width(shown.withColumn("kind", kind), ["doc_id"], "width").select("doc_id", "r", "c", "room")


@query(
    """WITH c AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r, 1 AS c,
  CASE WHEN l_returnflag = 'A' THEN 'restart' WHEN l_returnflag = 'N' THEN 'continue' END AS vmerge FROM lineitem),
o AS (SELECT *, CASE WHEN coalesce(vmerge, 'none') <> 'continue' OR coalesce(lag(coalesce(vmerge, 'none')) OVER (PARTITION BY doc_id ORDER BY r), 'none') = 'none' THEN 1 ELSE 0 END AS opens FROM c),
g AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY r ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT doc_id, min(r) AS r, count(*) AS row_span FROM g GROUP BY doc_id, run"""
)
def merge_rowspan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    row = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)).cast("long")
    merge = F.when(F.col("l_returnflag") == "A", "restart").when(F.col("l_returnflag") == "N", "continue")
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), row.alias("r"), F.lit(1).alias("c"), merge.alias("vmerge"))
    return layout.row_spans(cells, ["doc_id"], "vmerge").select("doc_id", "r", "row_span")


@query(
    """WITH b AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, CASE WHEN o_orderkey % 7 = 0 THEN 'table' ELSE 'paragraph' END AS kind, o_orderstatus AS style_id,
  CAST(o_orderkey % 10 AS DOUBLE) AS before, CAST(o_orderkey % 6 AS DOUBLE) AS after, o_orderkey % 4 = 0 AS contextual, o_orderkey % 5 = 0 AS additive FROM orders),
p AS (SELECT *, lag(kind) OVER w AS pk, lag(style_id) OVER w AS ps, lag(after) OVER w AS pa, lag(contextual) OVER w AS pc FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
q AS (SELECT *, CASE WHEN ps = style_id AND pc THEN 0.0 ELSE pa END AS above, CASE WHEN ps = style_id AND contextual AND pk = 'paragraph' THEN 0.0 ELSE before END AS below FROM p)
SELECT doc_id, ord, CASE WHEN kind <> 'paragraph' THEN 0.0 WHEN pk = 'paragraph' THEN CASE WHEN additive THEN above + below ELSE greatest(above, below) END ELSE before END AS gap FROM q"""
)
def gap_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "orders").selectExpr(
        "o_custkey doc_id", "o_orderkey ord", "case when o_orderkey % 7 = 0 then 'table' else 'paragraph' end kind", "o_orderstatus style_id",
        "cast(o_orderkey % 10 as double) before", "cast(o_orderkey % 6 as double) after", "o_orderkey % 4 = 0 contextual", "o_orderkey % 5 = 0 additive",
    )
    return layout.collapse_gaps(blocks, ["doc_id"], "ord").select("doc_id", "ord", "gap")


@query(
    """WITH f AS (SELECT user_id, ts, event_id, event_type, CASE WHEN row_number() OVER w = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS a,
  CASE WHEN row_number() OVER w = count(*) OVER (PARTITION BY user_id) OR event_type IS DISTINCT FROM lead(event_type) OVER w THEN 1 ELSE 0 END AS z FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, a = 1 AS first, z = 1 AS last FROM f"""
)
def border_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.group_ends(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type"]).select("user_id", "event_id", "first", "last")


@query(
    """WITH f AS (SELECT user_id, event_id, event_type, CASE WHEN row_number() OVER w = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, sum(a) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT user_id, CAST(run AS BIGINT) AS run, event_type, min(event_id) AS event_id, string_agg(CAST(event_id AS VARCHAR), '' ORDER BY event_id) AS text FROM g GROUP BY 1, 2, 3"""
)
def run_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.col("event_id").cast("string").alias("text"))
    return layout.merge_runs(df, ["user_id"], "event_id", ["event_type"], "text")


@query("SELECT p_partkey, start, substr(p_name, start + 1, CASE start WHEN 0 THEN 2 WHEN 2 THEN 3 ELSE greatest(length(p_name) - 5, 0) END) AS part FROM part, (SELECT CAST(unnest([0, 2, 5]) AS INTEGER) AS start)")
def rich_text_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.explode(F.array(F.lit(0), F.lit(2), F.lit(5))).alias("start"))
    return layout.slice_runs(df, ["p_partkey"], "start", "p_name").select("p_partkey", "start", "part")


@query("SELECT p_partkey, CAST(unnest(range(least(p_size, 4))) AS INTEGER) AS copy FROM part")
def repeat_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.expand_repeats(table(spark, sf_dir, "part"), "p_size", 4, "copy").select("p_partkey", "copy")


# Styles ------------------------------------------------------------------------------------------

STYLES = """
WITH RECURSIVE styles AS (
  SELECT c_custkey AS style_id, CASE WHEN c_custkey > 3 THEN c_custkey // 3 END AS parent_id, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal END AS size,
         CASE WHEN c_custkey % 5 = 1 THEN c_mktsegment END AS family FROM customer
), chain AS (
  SELECT style_id, style_id AS ancestor, 0 AS depth FROM styles
  UNION ALL SELECT c.style_id, s.parent_id, c.depth + 1 FROM chain c JOIN styles s ON s.style_id = c.ancestor WHERE s.parent_id IS NOT NULL AND c.depth < 31
)
SELECT c.style_id, arg_min(size, depth) FILTER (size IS NOT NULL) AS size, arg_min(family, depth) FILTER (family IS NOT NULL) AS family
FROM chain c JOIN styles s ON s.style_id = c.ancestor GROUP BY 1
"""


@query(STYLES)
def style_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey style_id", "case when c_custkey > 3 then c_custkey div 3 end parent_id",
        "case when c_custkey % 4 = 0 then c_acctbal end size", "case when c_custkey % 5 = 1 then c_mktsegment end family",
    )
    return styles.cascade(own, [], ["size", "family"])


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal WHEN c_custkey % 3 = 0 THEN 10.0 ELSE 12.0 END AS size, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'base' END AS family FROM customer"""
)
def merge_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    size = styles.merge(F.lit(12.0), F.when(k % 3 == 0, 10.0), F.when(k % 2 == 0, F.col("c_acctbal")))
    return table(spark, sf_dir, "customer").select("c_custkey", size.alias("size"), styles.merge(F.lit("base"), F.when(k % 3 == 0, F.col("c_mktsegment"))).alias("family"))


# Charts ------------------------------------------------------------------------------------------

POINTS = """
WITH base AS (SELECT l_returnflag AS chart, CAST(month(l_shipdate) AS VARCHAR) AS cat, l_linestatus AS series, sum(CAST(l_quantity AS BIGINT)) AS value FROM lineitem GROUP BY 1, 2, 3),
cats AS (SELECT chart, cat, row_number() OVER (PARTITION BY chart ORDER BY cat) AS pos FROM (SELECT DISTINCT chart, cat FROM base)),
sers AS (SELECT chart, series, row_number() OVER (PARTITION BY chart ORDER BY series) AS series_idx FROM (SELECT DISTINCT chart, series FROM base)),
points AS (SELECT c.chart, c.cat, c.pos, s.series, s.series_idx, b.value FROM cats c JOIN sers s ON c.chart = s.chart LEFT JOIN base b ON b.chart = c.chart AND b.cat = c.cat AND b.series = s.series)
"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag chart", "cast(month(l_shipdate) as string) cat", "l_linestatus series", "cast(l_quantity as long) value")
    return charts.chart_points(df, ["chart"], "cat", "series", "value")


@query(POINTS + "SELECT chart, cat, CAST(pos AS INTEGER) AS pos, series, CAST(series_idx AS INTEGER) AS series_idx, CAST(value AS BIGINT) AS value FROM points")
def chart_series_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).select("chart", "cat", "pos", "series", "series_idx", "value")


@query(
    POINTS
    + """, e AS (SELECT chart, CAST(least(0, min(value)) AS DOUBLE) AS lo, CAST(greatest(0, max(value)) AS DOUBLE) AS hi FROM points GROUP BY 1),
r AS (SELECT *, (hi - lo) / 9.0 AS raw, pow(10.0, floor(log10((hi - lo) / 9.0))) AS mag FROM e),
s AS (SELECT *, mag * CASE WHEN raw / mag <= 1 THEN 1.0 WHEN raw / mag <= 2 THEN 2.0 WHEN raw / mag <= 5 THEN 5.0 ELSE 10.0 END AS step FROM r)
SELECT chart, floor(lo / step) * step AS low, floor(hi / step + 1e-9) * step + step AS high, step FROM s"""
)
def nice_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.axis(_points(spark, sf_dir).withColumn("value", F.col("value").cast("double")), ["chart"])


@query(
    POINTS
    + """, v AS (SELECT chart, series, pos, greatest(coalesce(CAST(value AS DOUBLE), 0.0), 0.0) AS v FROM points),
t AS (SELECT *, sum(v) OVER (PARTITION BY chart, series) AS total, coalesce(sum(v) OVER (PARTITION BY chart, series ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before FROM v)
SELECT chart, series, CAST(pos AS INTEGER) AS pos, v / total AS share, before / total * 360.0 AS angle, v / total * 360.0 AS sweep FROM t WHERE total > 0"""
)
def pie_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir).withColumn("value", F.col("value").cast("double"))
    return charts.pie_angles(points, ["chart", "series"], "pos").select("chart", "series", "pos", "share", "angle", "sweep")


@query(
    POINTS
    + """, n AS (SELECT chart, max(pos) AS cats, max(series_idx) AS sers FROM points GROUP BY 1)
SELECT p.chart, CAST(pos AS INTEGER) AS pos, CAST(series_idx AS INTEGER) AS series_idx, (pos - 1) * (480.0 / cats) + 480.0 / cats * 0.25 / 2 + (series_idx - 1) * (480.0 / cats * 0.75 / sers) AS x, 480.0 / cats * 0.75 / sers AS width FROM points p JOIN n ON p.chart = n.chart"""
)
def bar_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    n = points.groupBy("chart").agg(F.max("pos").alias("cats"), F.max("series_idx").alias("sers"))
    slot = charts.bar_slots(F.col("pos"), F.col("series_idx"), F.col("cats"), F.col("sers"), F.lit(480.0), 0.25)
    return points.join(n, "chart").withColumn("s", slot).select("chart", "pos", "series_idx", "s.x", "s.width")


@query(
    """WITH n AS (SELECT n_regionkey AS chart, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) * 2 AS pos, n_name AS category FROM nation), g AS (SELECT chart, unnest(range(1, 13)) AS pos FROM (SELECT DISTINCT chart FROM n))
SELECT g.chart, CAST(g.pos AS INTEGER) AS pos, coalesce(category, CAST(g.pos AS VARCHAR)) AS category FROM g LEFT JOIN n ON n.chart = g.chart AND n.pos = g.pos"""
)
def chart_pad_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) * 2
    points = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("chart"), pos.alias("pos"), F.col("n_name").alias("category"), F.lit(12).alias("size"))
    return charts.pad_categories(points, ["chart"], "size").select("chart", "pos", "category")


# Text --------------------------------------------------------------------------------------------

@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*(?:>|$)', '', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def html_strip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", scalars.strip_tags(F.col("html")).alias("text"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def collapse_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scalars.collapse_space(F.col("text")).alias("text"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&')) AS digest FROM pages")
def entity_unescape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(scalars.unescape(F.col("html"))).alias("digest"))


@query(r"SELECT page_id, len(regexp_extract_all(html, '(?s)<p(?:\s[^>]*)?>(.*?)</p>', 1)) AS n, md5(array_to_string(regexp_extract_all(html, '(?s)<p(?:\s[^>]*)?>(.*?)</p>', 1), '|')) AS digest FROM pages")
def tag_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = scalars.collect_tags(F.col("html"), "p")
    return table(spark, sf_dir, "pages").select("page_id", F.size(tags).cast("long").alias("n"), F.md5(F.array_join(tags, "|")).alias("digest"))


WORDS = r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents)"""


@query(WORDS + " SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(list_distinct(ws)) AS BIGINT) AS n_distinct, md5(array_to_string(ws, ' ')) AS digest FROM w")
def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", scalars.word_tokens(F.col("text")).alias("ws"))
    return df.select("doc_id", F.size("ws").cast("long").alias("n_words"), F.size(F.array_distinct("ws")).cast("long").alias("n_distinct"), F.md5(F.array_join("ws", " ")).alias("digest"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each document as the source, and as extracted without its every third word."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    short = docs.select("doc_id", F.array_join(F.filter(words, lambda w, i: i % 3 != 0), " ").alias("text"))
    return docs, short


OVERLAP = (
    WORDS
    + """, a AS (SELECT doc_id, unnest(ws) AS word FROM w), e AS (SELECT doc_id, word FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w) WHERE i % 3 <> 0),
ac AS (SELECT doc_id, word, count(*) AS n FROM a GROUP BY 1, 2), ec AS (SELECT doc_id, word, count(*) AS n FROM e GROUP BY 1, 2),
t AS (SELECT ac.doc_id, sum(ac.n) AS s, sum(coalesce(ec.n, 0)) AS x, sum(least(ac.n, coalesce(ec.n, 0))) AS h FROM ac LEFT JOIN ec ON ac.doc_id = ec.doc_id AND ac.word = ec.word GROUP BY 1),
o AS (SELECT documents.doc_id, CAST(coalesce(s, 0) AS BIGINT) AS source_words, CAST(coalesce(x, 0) AS BIGINT) AS extracted_words, CAST(coalesce(h, 0) AS BIGINT) AS hit FROM documents LEFT JOIN t ON t.doc_id = documents.doc_id)
"""
)


@query(OVERLAP + "SELECT * FROM o")
def word_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fidelity.overlap(*_sides(spark, sf_dir), ["doc_id"])


@query(OVERLAP + "SELECT *, CASE WHEN source_words = 0 THEN 1.0 ELSE hit / source_words END AS recall, CASE WHEN extracted_words = 0 THEN 1.0 ELSE hit / extracted_words END AS precision FROM o")
def recall_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fidelity.recall_precision(*_sides(spark, sf_dir), ["doc_id"])


@query("SELECT doc_id, CAST(length(text) - length(replace(text, '�', '')) AS INTEGER) AS n FROM documents")
def unmappable_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scalars.unmappable(F.col("text")).alias("n"))


#: The table of longest common subsequences, row by row: a row is the running maximum of what the row above allows.
LCS = r"""WITH RECURSIVE i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM benchmark),
p AS (SELECT x.item_id, x.ws AS a, y.ws AS b FROM i x JOIN i y ON y.item_id = x.item_id + 1),
d AS (
  SELECT item_id, a, b, 0 AS k, list_transform(range(len(b) + 1), lambda j: 0) AS best FROM p
  UNION ALL
  SELECT item_id, a, b, k + 1, list_prepend(0, list_transform(range(1, len(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda m: CASE WHEN b[m] = a[k + 1] THEN best[m] + 1 ELSE best[m + 1] END)))) FROM d WHERE k < len(a)
)
SELECT item_id, CAST(best[len(b) + 1] AS BIGINT) AS lcs, CASE WHEN least(len(a), len(b)) = 0 THEN 1.0 ELSE best[len(b) + 1] / least(len(a), len(b)) END AS score FROM d WHERE k = len(a)"""


@query(LCS)
def lcs_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word order of each benchmark item against the next one."""
    items = table(spark, sf_dir, "benchmark").select("item_id", scalars.word_tokens(F.col("text")).alias("a"))
    other = items.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b"))
    pairs = items.join(other, "item_id")
    return pairs.select("item_id", fidelity.lcs_length(F.col("a"), F.col("b")).alias("lcs"), fidelity.order_score(F.col("a"), F.col("b")).alias("score"))


@query(
    """WITH p AS (SELECT l_orderkey, list(CAST(l_quantity * 5 AS INTEGER) ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS a, list(CAST(l_quantity * 4 AS INTEGER) ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS b FROM lineitem GROUP BY 1),
u AS (SELECT l_orderkey, unnest(a) AS x, unnest(b) AS y FROM p), k AS (SELECT l_orderkey, x, y, CASE WHEN x < 160 THEN 255 - x ELSE 0 END AS wx, CASE WHEN y < 160 THEN 255 - y ELSE 0 END AS wy FROM u)
SELECT l_orderkey, CASE WHEN sum(greatest(wx, wy)) = 0 THEN 1.0 ELSE sum(least(wx, wy)) / sum(greatest(wx, wy)) END AS iou, 1.0 - sum(abs(x - y)) / (count(*) * 255.0) AS similarity FROM k GROUP BY 1"""
)
def ink_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct(*LINE_ORDER, F.col("l_quantity"))
    px = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    grey = lambda k: F.transform("rows", lambda x: (x["l_quantity"] * k).cast("int"))
    return px.withColumn("x", fidelity.ink(grey(5), grey(4))).select("l_orderkey", "x.iou", "x.similarity")


@query(
    """SELECT event_type, count(*) AS cases, median(CAST(value * 100 AS BIGINT)) AS median_ms, CAST(sum(CAST(value * 100 AS BIGINT)) AS BIGINT) AS total_ms,
  avg(event_id % 100) / 100 AS mean_score, CASE WHEN avg(event_id % 100) / 100 >= 0.85 THEN 'good' WHEN avg(event_id % 100) / 100 >= 0.6 THEN 'fair' ELSE 'weak' END AS grade FROM events GROUP BY 1"""
)
def metric_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 100).alias("score"), F.round(F.col("value") * 100).cast("long").alias("warm"))
    out = fidelity.report(events, ["event_type"], "score", "warm")
    mean = F.col("mean_score") / 100
    return out.withColumn("mean_score", mean).withColumn("grade", scalars.grade(mean)).select("event_type", "cases", "median_ms", "total_ms", "mean_score", "grade")


# Lookups -----------------------------------------------------------------------------------------

@query("SELECT p_partkey, CASE WHEN p_size <= 40 THEN 'text' ELSE 'empty' END AS kind, CASE WHEN p_size <= 40 THEN 'string ' || p_size END AS txt FROM part")
def shared_string_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "part").selectExpr("0 doc_id", "p_partkey", "'shared' kind", "cast(p_size as double) num", "cast(null as string) txt")
    strings = spark.range(1, 41).selectExpr("0 doc_id", "cast(id as int) idx", "'string ' || id text")
    return lookups.shared_strings(cells, strings).select("p_partkey", "kind", "txt")


@query("SELECT c_custkey, CASE WHEN c_nationkey < 10 THEN c_nationkey ELSE 0 END AS xf FROM customer")
def style_index_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    xfs = spark.range(10).selectExpr("cast(id as int) idx", "cast(id as int) xf")
    return lookups.with_default(table(spark, sf_dir, "customer"), "c_nationkey", xfs, [], "idx", ["xf"]).select("c_custkey", "xf")


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 2")
def relationship_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers refer to nations; the nations of one region are outside the package."""
    refs = table(spark, sf_dir, "supplier").selectExpr("0 doc_id", "'s' part", "s_nationkey rid", "s_suppkey")
    nation = table(spark, sf_dir, "nation")
    rels = nation.selectExpr("0 doc_id", "'s' part", "n_nationkey rid", "'nation' type", "n_nationkey target", "case when n_regionkey = 2 then 'External' end mode")
    parts = nation.selectExpr("0 doc_id", "n_nationkey part", "n_name data")
    return lookups.relationships(refs, rels, parts).selectExpr("s_suppkey", "data n_name")


@query(
    """WITH runs AS (SELECT p_partkey * 10 AS s, p_partkey * 10 + least(p_size, 10) AS e, p_brand AS v FROM part)
SELECT o_orderkey, v FROM orders LEFT JOIN runs ON o_orderkey % 3000 >= s AND o_orderkey % 3000 < e"""
)
def nearest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "orders").selectExpr("0 doc_id", "o_orderkey", "o_orderkey % 3000 at")
    runs = table(spark, sf_dir, "part").selectExpr("0 doc_id", "p_partkey * 10 s", "p_partkey * 10 + least(p_size, 10) e", "p_brand v")
    return lookups.nearest_run(points, runs, ["doc_id"], "at", "s", "e", "v").select("o_orderkey", "v")


@query("SELECT n_nationkey, CASE WHEN n_nationkey BETWEEN 2 AND 5 THEN 11.0 WHEN n_nationkey BETWEEN 4 AND 9 THEN 0.0 WHEN n_nationkey BETWEEN 8 AND 12 THEN 33.0 ELSE 48.0 END::DOUBLE AS width FROM nation")
def column_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = spark.createDataFrame([(0, 0, 2, 5, 11.0, False), (0, 1, 4, 9, 22.0, True), (0, 2, 8, 12, 33.0, False)], "doc_id int, ordinal int, c_min int, c_max int, width double, hidden boolean")
    cols = table(spark, sf_dir, "nation").selectExpr("0 doc_id", "n_nationkey", "n_nationkey c")
    return lookups.column_widths(cols, specs, ["doc_id"], 48.0).select("n_nationkey", "width")


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'xlsx' WHEN 1 THEN 'fodt' WHEN 2 THEN 'png' WHEN 3 THEN NULL ELSE 'docx' END AS format FROM pages")
def format_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats of bytes put in front of each page."""
    zipped = lambda marker: F.concat(F.unhex(F.lit("504B0304")), F.encode(F.lit(marker), "UTF-8"))
    kind = F.col("page_id") % 5
    head = (
        F.when(kind == 0, zipped("....xl/workbook.xml"))
        .when(kind == 1, F.encode(F.lit('<?xml version="1.0"?><office:document office:mimetype="application/vnd.oasis.opendocument.text">'), "UTF-8"))
        .when(kind == 2, F.unhex(F.lit("89504E470D0A1A0A")))
        .when(kind == 3, F.encode(F.lit("plain"), "UTF-8"))
        .otherwise(zipped("....word/document.xml"))
    )
    content = F.concat(head, F.encode(F.col("html"), "UTF-8"))
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(sniff.detect_format(content), sniff.image_format(content)).alias("format"))
