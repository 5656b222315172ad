"""Sheet queries over the driver's tables: each order is a sheet, its lines are the rows.

Every query is a (DataFrame, SQL) pair under one name; sums are taken over whole cents, so that
both engines agree to the last digit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import formula as X
from quire.functions import numfmt, scalars
from quire.operators import aggregates, condfmt, layout

LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of line items in their file for each task, whose sorts of cells then take about 300 MB.
TASK_BYTES = 4 << 20


def by_order(df: DataFrame, key: str, size: int, each: int = TASK_BYTES) -> DataFrame:
    """``df`` dealt out by order; tables of ``size`` bytes of line items get a task for each few megabytes."""
    tasks = -(-size // each)
    return df.repartition(tasks, key) if tasks > df.sparkSession.sparkContext.defaultParallelism else df.repartition(key)


def line_bytes(spark: SparkSession, sf_dir: str) -> int:
    return int(str(table(spark, sf_dir, "lineitem")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def staying(spark: SparkSession) -> SparkSession:
    """A copy of the session whose joins leave rows where they are, if both sides are dealt out by some of
    the join's keys alone: the sheets here are small, so a document's cells can stay in one task throughout."""
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return own


def line_cells(spark: SparkSession, sf_dir: str, each: int = TASK_BYTES) -> DataFrame:
    """doc_id, sheet_idx, r, c, kind, num, txt, flag: columns quantity, price, discount, flag, returned."""
    row = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)).cast("long")
    lines = by_order(table(spark, sf_dir, "lineitem"), "l_orderkey", line_bytes(spark, sf_dir), each).withColumn("r", row)
    cell = lambda c, kind, num="cast(null as double)", txt="cast(null as string)", flag="cast(null as boolean)": f"struct({c} as c, {kind} as kind, {num} as num, {txt} as txt, {flag} as flag)"
    cells = [
        cell(1, "'number'", "l_quantity"),
        cell(2, "'number'", "l_extendedprice"),
        cell(3, "'number'", "l_discount"),
        cell(4, "case when l_tax > 0.04 then 'text' else 'empty' end", txt="case when l_tax > 0.04 then l_returnflag || '-' || l_linestatus end"),
        cell(5, "'bool'", flag="l_returnflag = 'R'"),
    ]
    out = lines.selectExpr("l_orderkey doc_id", "0 sheet_idx", "r", f"explode(array({', '.join(cells)})) x")
    return out.select("doc_id", "sheet_idx", "r", "x.*")


#: The same cells in SQL.
CELLS = """
WITH lines AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem
), cells AS (
  SELECT l_orderkey AS doc_id, r, 1 AS c, 'number' AS kind, l_quantity AS num, NULL AS txt, NULL AS flag FROM lines
  UNION ALL SELECT l_orderkey, r, 2, 'number', l_extendedprice, NULL, NULL FROM lines
  UNION ALL SELECT l_orderkey, r, 3, 'number', l_discount, NULL, NULL FROM lines
  UNION ALL SELECT l_orderkey, r, 4, CASE WHEN l_tax > 0.04 THEN 'text' ELSE 'empty' END, NULL, CASE WHEN l_tax > 0.04 THEN l_returnflag || '-' || l_linestatus END, NULL FROM lines
  UNION ALL SELECT l_orderkey, r, 5, 'bool', NULL, NULL, l_returnflag = 'R' FROM lines
)
"""

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# Conditional formats -----------------------------------------------------------------------------

REPORT_RULES = (
    condfmt.Rule((1, 1, 100000, 1), 2, 0, "cellIs", "greaterThan", ("45",)),
    condfmt.Rule((1, 1, 100000, 2), 1, 1, "cellIs", "between", ("20000", "10000")),
    condfmt.Rule((1, 1, 3, 5), 2, 2, "expression", "", ("AND($A1>=30,$C1=0.1)",)),
    condfmt.Rule((2, 3, 100000, 3), 3, 3, "cellIs", "equal", ("0.05",)),
    condfmt.Rule((1, 1, 100000, 5), 4, 4, "beginsWith", "", (), "r-"),
)


@query(
    CELLS
    + """, hits AS (
  SELECT x.*, a.num AS a, d.num AS d FROM cells x
  LEFT JOIN cells a ON a.doc_id = x.doc_id AND a.r = x.r AND a.c = 1
  LEFT JOIN cells d ON d.doc_id = x.doc_id AND d.r = x.r AND d.c = 3
), chosen AS (
  SELECT *, CASE
    WHEN c <= 2 AND kind = 'number' AND num BETWEEN 10000 AND 20000 THEN 1
    WHEN c = 1 AND num > 45 THEN 0
    WHEN r <= 3 AND a >= 30 AND d = 0.1 THEN 2
    WHEN c = 3 AND r >= 2 AND abs(num - 0.05) < 1e-9 THEN 3
    WHEN kind = 'text' AND starts_with(lower(txt), 'r-') THEN 4 END AS dxf
  FROM hits
)
SELECT dxf, c, count(*) AS n_cells, CAST(sum(CAST(round(coalesce(num, 0) * 100) AS BIGINT)) AS BIGINT) AS cents,
       min(CASE WHEN c = 3 THEN printf('%.0f%%', num * 100) ELSE format('{:,.2f}', num + 0.0) END) AS least_text
FROM chosen WHERE dxf IS NOT NULL GROUP BY dxf, c
"""
)
def condfmt_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over all sheets, the shown numbers, and totals by format: the flagship query."""
    cells = condfmt.apply_rules(line_cells(spark, sf_dir), REPORT_RULES).select("c", "num", "dxf")
    # A generator drops the cells without a format: a filter would be pushed below and choose each rule twice.
    chosen = cells.select("c", "num", F.explode(F.array_compact(F.array("dxf"))).alias("dxf"))
    shown = F.when(F.col("c") == 3, numfmt.format_value(F.col("num"), "0%")).otherwise(numfmt.format_value(F.col("num"), "#,##0.00"))
    return chosen.withColumn("shown", shown).groupBy("dxf", "c").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.sum(F.round(F.coalesce("num", F.lit(0.0)) * 100).cast("long")).alias("cents"),
        F.min("shown").alias("least_text"),
    )


@query(
    CELLS
    + """SELECT doc_id, r, c, CASE WHEN c = 1 AND (num < 10 OR num > 40) THEN 7 WHEN c = 2 AND num BETWEEN 1000 AND 5000 THEN 8 END AS dxf
FROM cells WHERE c <= 2"""
)
def condfmt_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = (condfmt.Rule((1, 1, 1_000_000, 1), 1, 7, "cellIs", "notBetween", ("40", "10")), condfmt.Rule((1, 2, 1_000_000, 2), 1, 8, "cellIs", "between", ("1000", "5000")))
    return condfmt.apply_rules(line_cells(spark, sf_dir).where("c <= 2"), rules).select("doc_id", "r", "c", "dxf")


@query(
    CELLS
    + """SELECT doc_id, r, c, CASE WHEN contains(t, 'r-f') THEN 1 WHEN starts_with(t, 'a') THEN 2 WHEN ends_with(t, 'o') THEN 3 WHEN NOT contains(t, 'z') THEN 4 END AS dxf
FROM (SELECT doc_id, r, c, coalesce(lower(txt), '') AS t FROM cells WHERE c = 4)"""
)
def condfmt_text_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = (1, 1, 1_000_000, 9)
    rules = (
        condfmt.Rule(area, 1, 1, "containsText", text="R-F"),
        condfmt.Rule(area, 2, 2, "beginsWith", text="a"),
        condfmt.Rule(area, 3, 3, "endsWith", formulas=('"O"',)),
        condfmt.Rule(area, 4, 4, "notContainsText", text="z"),
    )
    return condfmt.apply_rules(line_cells(spark, sf_dir).where("c = 4"), rules).select("doc_id", "r", "c", "dxf")


@query(CELLS + "SELECT c, CASE WHEN kind = 'empty' THEN 1 ELSE 2 END AS dxf, count(*) AS n FROM cells GROUP BY 1, 2")
def condfmt_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = (1, 1, 1_000_000, 9)
    rules = (condfmt.Rule(area, 1, 1, "containsBlanks"), condfmt.Rule(area, 2, 2, "notContainsBlanks"))
    return condfmt.apply_rules(line_cells(spark, sf_dir), rules).groupBy("c", "dxf").agg(F.count(F.lit(1)).alias("n"))


@query(
    CELLS
    + """, areas AS (
  SELECT o_orderkey AS doc_id, 1 + CAST(i AS INTEGER) AS r1, 1 AS c1, 3 AS r2, 2 + CAST(i AS INTEGER) AS c2, CAST(3 - i AS INTEGER) AS priority, CAST(i AS INTEGER) AS ordinal
  FROM orders, range(3) t(i) WHERE o_orderkey % 2 = 0
)
SELECT cells.doc_id, r, c, arg_min(ordinal, priority * 1000 + ordinal) AS area, count(*) AS n_areas
FROM cells JOIN areas ON cells.doc_id = areas.doc_id AND r BETWEEN r1 AND r2 AND c BETWEEN c1 AND c2 GROUP BY 1, 2, 3"""
)
def condfmt_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules in a table: rectangles meet cells by bucket, the first by priority and ordinal wins."""
    areas = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").selectExpr("o_orderkey doc_id", "0 sheet_idx", "explode(sequence(0, 2)) i")
    areas = areas.selectExpr("doc_id", "sheet_idx", "1 + i r1", "1 c1", "3 r2", "2 + i c2", "3 - i priority", "i ordinal")
    pairs = condfmt.match_rectangles(line_cells(spark, sf_dir), areas)
    return pairs.groupBy("doc_id", "r", "c").agg(F.min_by("ordinal", F.struct("priority", "ordinal")).alias("area"), F.count(F.lit(1)).alias("n_areas"))


# Formulas ----------------------------------------------------------------------------------------

@query(
    CELLS
    + """, v AS (SELECT doc_id, c, CASE WHEN kind = 'number' THEN num WHEN kind = 'bool' THEN CAST(flag AS INTEGER) END AS x FROM cells WHERE c IN (1, 4, 5))
SELECT doc_id, c, coalesce(sum(x), 0.0) AS total, avg(x) AS mean, coalesce(min(x), 'inf'::DOUBLE) AS least, coalesce(max(x), '-inf'::DOUBLE) AS most FROM v GROUP BY 1, 2"""
)
def formula_sum_avg_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = line_cells(spark, sf_dir).where("c in (1, 4, 5)")
    x = aggregates.numeric(F.col("kind"), F.col("num"), F.col("flag"))
    return cells.groupBy("doc_id", "c").agg(
        aggregates.sheet_sum(x).alias("total"), aggregates.sheet_average(x).alias("mean"), aggregates.sheet_min(x).alias("least"), aggregates.sheet_max(x).alias("most")
    )


@query(
    CELLS
    + """SELECT doc_id, count(CASE WHEN kind IN ('number', 'bool') THEN 1 END) AS n_numbers, count(CASE WHEN kind <> 'empty' THEN 1 END) AS n_filled,
       count(CASE WHEN kind = 'empty' THEN 1 END) AS n_blank, coalesce(bool_and(flag), true) AS all_returned, coalesce(bool_or(flag), false) AS any_returned
FROM cells GROUP BY 1"""
)
def formula_count_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = aggregates.numeric(F.col("kind"), F.col("num"), F.col("flag"))
    return line_cells(spark, sf_dir).groupBy("doc_id").agg(
        aggregates.sheet_count(x).alias("n_numbers"), aggregates.sheet_counta(F.col("kind")).alias("n_filled"), aggregates.sheet_countblank(F.col("kind")).alias("n_blank"),
        aggregates.sheet_and(F.col("flag")).alias("all_returned"), aggregates.sheet_or(F.col("flag")).alias("any_returned"),
    )


def _value(text: str, cells: X.Resolver) -> X.Val:
    found = X.compile_formula(text, cells)
    if found is None:
        raise ValueError(f"not a formula: {text}")
    return found


def _columns(df: DataFrame, keys: list[str], cells: X.Resolver, made: dict[str, tuple[str, str]]) -> DataFrame:
    """Formulas as columns: name -> (formula, payload n, s or b)."""
    return df.select(*keys, *[getattr(_value(f, cells), part).alias(name) for name, (f, part) in made.items()])


@query(
    """SELECT c_custkey, sign(c_acctbal * 10.0) * floor(abs(c_acctbal * 10.0) + 0.5) / 10.0 AS tenths, sign(c_acctbal) * floor(abs(c_acctbal) + 0.5) AS units,
  c_acctbal - 7.0 * floor(c_acctbal / 7.0) AS mod_pos, c_acctbal - (-7.0) * floor(c_acctbal / -7.0) AS mod_neg, floor(c_acctbal) AS whole, abs(c_acctbal) AS size,
  CAST(trunc(c_acctbal) AS BIGINT) % 2 = 0 AS even FROM customer"""
)
def formula_round_mod_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = X.columns_as_cells({"A": X.num(F.col("c_acctbal"))})
    return _columns(
        table(spark, sf_dir, "customer"), ["c_custkey"], cells,
        {"tenths": ("ROUND(A1,1)", "n"), "units": ("ROUND(A1)", "n"), "mod_pos": ("MOD(A1,7)", "n"), "mod_neg": ("MOD(A1,-7)", "n"), "whole": ("INT(A1)", "n"), "size": ("ABS(A1)", "n"), "even": ("ISEVEN(A1)", "b")},
    )


@query(
    """SELECT p_partkey, CASE WHEN p_size > 25 AND p_retailprice >= 1000 THEN 'big' ELSE 'small' END AS class, NOT (p_size = 1 OR p_size = 50) AS inner_size,
  CASE WHEN p_size - 10 = 0 THEN NULL ELSE p_retailprice / (p_size - 10) END AS share, p_size * 1.0 AS rescued FROM part"""
)
def formula_logic_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = X.columns_as_cells({"A": X.num(F.col("p_size").cast("double")), "B": X.num(F.col("p_retailprice"))})
    return _columns(
        table(spark, sf_dir, "part"), ["p_partkey"], cells,
        {"class": ('IF(AND(A1>25,B1>=1000),"big","small")', "s"), "inner_size": ("NOT(OR(A1=1,A1=50))", "b"), "share": ("B1/(A1-10)", "n"), "rescued": ("IFERROR(A1,0)", "n")},
    )


@query(
    """SELECT p_partkey, CAST(length(p_name) AS DOUBLE) AS len, upper(p_name) AS up, lower(p_brand) AS low, left(p_name, 3) AS l3, right(p_name, 4) AS r4, substr(p_name, 2, 3) AS mid,
  trim(regexp_replace('  ' || p_type || '   x ', '\\s+', ' ', 'g')) AS trimmed, p_brand = upper(p_brand) AS same, p_name || '/' || CAST(p_size AS VARCHAR) AS joined FROM part"""
)
def formula_text_funcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = X.columns_as_cells({"A": X.txt(F.col("p_name")), "B": X.txt(F.col("p_brand")), "C": X.txt(F.col("p_type")), "D": X.num(F.col("p_size").cast("double"))})
    return _columns(
        table(spark, sf_dir, "part"), ["p_partkey"], cells,
        {
            "len": ("LEN(A1)", "n"), "up": ("UPPER(A1)", "s"), "low": ("LOWER(B1)", "s"), "l3": ("LEFT(A1,3)", "s"), "r4": ("RIGHT(A1,4)", "s"), "mid": ("MID(A1,2,3)", "s"),
            "trimmed": ('TRIM("  "&C1&"   x ")', "s"), "same": ("EXACT(B1,UPPER(B1))", "b"), "joined": ('A1&"/"&D1', "s"),
        },
    )


@query(CELLS + "SELECT doc_id, r, c, kind = 'empty' AS blank, kind = 'number' AS number, kind = 'text' AS text FROM cells")
def formula_is_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    here = X.cell_value(F.col("kind"), F.col("num"), F.col("txt"), F.col("flag"))
    cells = X.columns_as_cells({"A": here})
    return _columns(line_cells(spark, sf_dir), ["doc_id", "r", "c"], cells, {"blank": ("ISBLANK(A1)", "b"), "number": ("ISNUMBER(A1)", "b"), "text": ("ISTEXT(A1)", "b")})


@query(
    """SELECT p_partkey, lower(p_brand) < 'brand#3' AS before, p_size < 10 AS small, CAST(p_size AS VARCHAR) = '7' AS seven, p_size > 0 AS more, p_size = 1 AS one FROM part"""
)
def formula_compare_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = X.columns_as_cells({"A": X.txt(F.col("p_brand")), "B": X.num(F.col("p_size").cast("double"))})
    return _columns(
        table(spark, sf_dir, "part"), ["p_partkey"], cells,
        {"before": ('A1<"BRAND#3"', "b"), "small": ("B1<10", "b"), "seven": ('B1="7"', "b"), "more": ("B1>C1", "b"), "one": ("B1=TRUE", "b")},
    )


@query("SELECT p_partkey, p_size / 100.0 AS pct, CAST(p_size * p_size AS DOUBLE) AS square, CAST(2 + 3 * p_size AS DOUBLE) AS line, (p_size / 100.0) / 100.0 AS pct2 FROM part")
def formula_percent_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = X.columns_as_cells({"A": X.num(F.col("p_size").cast("double"))})
    made = {"pct": ("A1%", "n"), "square": ("-A1^2", "n"), "line": ("2+3*A1", "n"), "pct2": ("A1%%", "n")}
    return _columns(table(spark, sf_dir, "part"), ["p_partkey"], cells, made)


# Number formats ----------------------------------------------------------------------------------

def _shown(spark: SparkSession, sf_dir: str, name: str, key: str, value: str, codes: dict[str, str]) -> DataFrame:
    df = table(spark, sf_dir, name)
    return df.select(key, *[numfmt.format_value(F.expr(value), code).alias(alias) for alias, code in codes.items()])


@query(
    """SELECT o_orderkey, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS whole,
  CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR)
       ELSE rtrim(rtrim(CASE CAST(floor(log10(o_totalprice)) AS INTEGER) + 1 WHEN 6 THEN printf('%.4f', o_totalprice) WHEN 5 THEN printf('%.5f', o_totalprice)
            WHEN 4 THEN printf('%.6f', o_totalprice) WHEN 3 THEN printf('%.7f', o_totalprice) WHEN 2 THEN printf('%.8f', o_totalprice) ELSE printf('%.9f', o_totalprice) END, '0'), '.') END AS price FROM orders"""
)
def numfmt_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    return df.select("o_orderkey", numfmt.format_value(F.floor("o_totalprice").cast("double"), "General").alias("whole"), numfmt.format_value(F.col("o_totalprice"), "General").alias("price"))


@query("SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS two, format('{:,.0f}', o_totalprice) AS none, printf('%012.3f', o_totalprice) AS wide FROM orders")
def numfmt_fixed_thousands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", {"two": "#,##0.00", "none": "#,##0", "wide": "00000000.000"})


@query("SELECT c_custkey, printf('%.0f%%', c_acctbal / 10000 * 100.0) AS pct, printf('%.2f%%', c_acctbal / 10000 * 100.0) AS pct2 FROM customer")
def numfmt_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(spark, sf_dir, "customer", "c_custkey", "c_acctbal / 10000", {"pct": "0%", "pct2": "0.00%"})


@query(
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '(' || format('{:,.2f}', -c_acctbal) || ')' ELSE format('{:,.2f}', c_acctbal) END AS brackets,
  '$' || format('{:.1f}', c_acctbal) AS money, CASE WHEN c_acctbal < 0 THEN '#ff0000' END AS colour FROM customer"""
)
def numfmt_negative_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("c_acctbal")
    code = "#,##0.00;[Red](#,##0.00)"
    return table(spark, sf_dir, "customer").select(
        "c_custkey", numfmt.format_value(v, code).alias("brackets"), numfmt.format_value(v, "[$$-409]0.0").alias("money"), numfmt.format_colour(v, code).alias("colour")
    )


@query("SELECT o_orderkey, printf('%.8E', o_totalprice) AS sci FROM orders")
def numfmt_scientific(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", {"sci": "0.00000000E+00"})


@query(
    """WITH d AS (SELECT DISTINCT l_quantity, l_discount FROM lineitem), v AS (SELECT l_quantity, l_discount, l_quantity / 8.0 + l_discount AS x FROM d),
f AS (SELECT *, x - floor(x) AS rest FROM v), c AS (SELECT *, unnest(range(1, 10)) AS den FROM f),
e AS (SELECT *, floor(rest * den + 0.5) AS num, abs(rest - floor(rest * den + 0.5) / den) AS err FROM c),
b AS (SELECT l_quantity, l_discount, x, min_by(struct_pack(num := num, den := den), round(err, 11) * 1000 + den * 1e-9) AS best FROM e GROUP BY ALL),
w AS (SELECT l_quantity, l_discount, floor(x) + CASE WHEN best.num = best.den THEN 1 ELSE 0 END AS whole, CASE WHEN best.num = best.den THEN 0 ELSE best.num END AS num, best.den AS den FROM b)
SELECT l_quantity, l_discount, CASE WHEN whole > 0 OR num = 0 THEN CAST(CAST(whole AS BIGINT) AS VARCHAR) ELSE '' END ||
  CASE WHEN num > 0 THEN CASE WHEN whole > 0 THEN ' ' ELSE '' END || CAST(CAST(num AS BIGINT) AS VARCHAR) || '/' || CAST(den AS VARCHAR) ELSE '' END AS fraction FROM w"""
)
def numfmt_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount").distinct()
    return df.select("l_quantity", "l_discount", numfmt.format_value(F.expr("l_quantity / 8.0 + l_discount"), "# ?/?").alias("fraction"))


SERIAL = "date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE))"


def _serials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", "cast(datediff(cast(o_orderdate as date), date'1899-12-30') as double) v")


@query(f"SELECT o_orderkey, CAST({SERIAL} AS DOUBLE) AS serial, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def serial_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _serials(spark, sf_dir).select("o_orderkey", F.col("v").alias("serial"), F.date_format(numfmt.serial_date(F.col("v")), "yyyy-MM-dd").alias("day"))


@query(
    """SELECT o_orderkey, strftime(o_orderdate, '%-m/%-d/%Y') AS us, strftime(o_orderdate, '%-d-%b-%y') AS short, strftime(o_orderdate, '%B %d, %Y') AS long FROM orders"""
)
def date_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return _serials(spark, sf_dir).select(
        "o_orderkey", numfmt.format_value(v, "m/d/yyyy").alias("us"), numfmt.format_value(v, "d-mmm-yy").alias("short"), numfmt.format_value(v, "mmmm dd, yyyy").alias("long")
    )


@query(
    """SELECT event_id, CAST(event_id * 900 // 3600 AS VARCHAR) || ':' || lpad(CAST(event_id * 900 // 60 % 60 AS VARCHAR), 2, '0') || ':00' AS elapsed,
  CASE WHEN event_id * 900 // 3600 % 24 % 12 = 0 THEN '12' ELSE CAST(event_id * 900 // 3600 % 24 % 12 AS VARCHAR) END || ':' || lpad(CAST(event_id * 900 // 60 % 60 AS VARCHAR), 2, '0') ||
  CASE WHEN event_id * 900 // 3600 % 24 >= 12 THEN ' PM' ELSE ' AM' END AS clock FROM events"""
)
def elapsed_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarter hours as serials: exact in binary after division by 96 only in part, hence rounded seconds."""
    serial = F.col("event_id") / 96.0
    return table(spark, sf_dir, "events").select("event_id", numfmt.format_value(serial + 1e-9, "[h]:mm:ss").alias("elapsed"), numfmt.format_value(serial, "h:mm AM/PM").alias("clock"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%a') AS short, strftime(o_orderdate, '%A') AS long FROM orders")
def weekday_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return _serials(spark, sf_dir).select("o_orderkey", numfmt.format_value(v, "ddd").alias("short"), numfmt.format_value(v, "dddd").alias("long"))


# References, numerals, colours -------------------------------------------------------------------

LETTERS_SQL = """CASE WHEN n <= 26 THEN chr(CAST(64 + n AS INTEGER)) WHEN n <= 702 THEN chr(CAST(64 + (n - 1) // 26 AS INTEGER)) || chr(CAST(65 + (n - 1) % 26 AS INTEGER))
  ELSE chr(CAST(64 + (n - 703) // 676 + 1 AS INTEGER)) || chr(CAST(65 + (n - 703) // 26 % 26 AS INTEGER)) || chr(CAST(65 + (n - 703) % 26 AS INTEGER)) END"""


@query(f"SELECT p_partkey, {LETTERS_SQL} || p_size AS cell, p_size AS row, CAST(n AS INTEGER) AS col FROM (SELECT *, p_partkey % 16384 + 1 AS n FROM part)")
def a1_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").withColumn("n", (F.col("p_partkey") % 16384 + 1).cast("int"))
    named = df.select("p_partkey", scalars.a1(F.col("p_size"), F.col("n")).alias("cell")).withColumn("at", scalars.parse_a1(F.concat(F.lit("'My Sheet'!$"), "cell")))
    return named.select("p_partkey", "cell", F.col("at.row").alias("row"), F.col("at.col").alias("col"))


@query("SELECT p_partkey, least(p_size, 20) AS r1, 2 AS c1, greatest(p_size, 20) AS r2, 28 AS c2 FROM part")
def a1_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", scalars.parse_range(F.concat(F.lit("$AB$"), "p_size", F.lit(":B20"))).alias("x"))
    return df.select("p_partkey", "x.*")


@query(
    """WITH n AS (SELECT DISTINCT p_size AS n FROM part)
SELECT n, repeat('X', CAST(n // 10 % 10 % 5 % 4 * (CASE WHEN n // 10 = 4 OR n // 10 = 9 THEN 0 ELSE 1 END) AS INTEGER)) AS x_only,
  CASE n // 10 WHEN 0 THEN '' WHEN 1 THEN 'X' WHEN 2 THEN 'XX' WHEN 3 THEN 'XXX' WHEN 4 THEN 'XL' WHEN 5 THEN 'L' END ||
  CASE n % 10 WHEN 0 THEN '' WHEN 1 THEN 'I' WHEN 2 THEN 'II' WHEN 3 THEN 'III' WHEN 4 THEN 'IV' WHEN 5 THEN 'V' WHEN 6 THEN 'VI' WHEN 7 THEN 'VII' WHEN 8 THEN 'VIII' ELSE 'IX' END AS roman,
  repeat(chr(CAST(65 + (n - 1) % 26 AS INTEGER)), CAST((n - 1) // 26 + 1 AS INTEGER)) AS letters,
  CAST(n AS VARCHAR) || CASE WHEN n % 10 = 1 AND n <> 11 THEN 'st' WHEN n % 10 = 2 AND n <> 12 THEN 'nd' WHEN n % 10 = 3 AND n <> 13 THEN 'rd' ELSE 'th' END AS ordinal FROM n"""
)
def roman_letters_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    df = table(spark, sf_dir, "part").select(F.col("p_size").alias("n")).distinct()
    tens = F.floor(n / 10)
    x_only = F.repeat(F.lit("X"), (tens % 10 % 5 % 4 * F.when(tens.isin(4, 9), 0).otherwise(1)).cast("int"))
    return df.select("n", x_only.alias("x_only"), scalars.roman(n).alias("roman"), scalars.letters(n).alias("letters"), scalars.ordinal(n).alias("ordinal"))


@query(
    """SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) AS plain, CASE WHEN n_nationkey = 0 THEN '0' ELSE lower(CASE n_nationkey // 10 WHEN 0 THEN '' WHEN 1 THEN 'X' ELSE 'XX' END ||
  CASE n_nationkey % 10 WHEN 0 THEN '' WHEN 1 THEN 'I' WHEN 2 THEN 'II' WHEN 3 THEN 'III' WHEN 4 THEN 'IV' WHEN 5 THEN 'V' WHEN 6 THEN 'VI' WHEN 7 THEN 'VII' WHEN 8 THEN 'VIII' ELSE 'IX' END) END AS small_roman,
  CASE WHEN n_nationkey = 0 THEN '' ELSE chr(CAST(64 + n_nationkey AS INTEGER)) END AS letter FROM nation"""
)
def page_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    page = lambda form: scalars.page_number(n, scalars.page_pattern(form))
    return table(spark, sf_dir, "nation").select("n_nationkey", page(None).alias("plain"), page("lowerRoman").alias("small_roman"), page("upperLetter").alias("letter"))


@query(
    """WITH c AS (SELECT DISTINCT p_size AS n FROM part), g AS (SELECT n, n * 5 % 256 AS v FROM c)
SELECT n, '#' || repeat(lpad(lower(hex(CAST(v AS UTINYINT))), 2, '0'), 3) AS grey,
  '#' || repeat(lpad(lower(hex(CAST(floor((v / 255.0 * 0.5 + 0.5) * 255 + 0.5) AS UTINYINT))), 2, '0'), 3) AS lighter,
  '#' || repeat(lpad(lower(hex(CAST(floor(v / 255.0 * 0.75 * 255 + 0.5) AS UTINYINT))), 2, '0'), 3) AS darker, CAST(v AS INTEGER) AS luma FROM g"""
)
def color_hsl_tint(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select(F.col("p_size").alias("n")).distinct().withColumn("v", F.col("n") * 5 % 256)
    grey = scalars.colour_hex(F.col("v"), F.col("v"), F.col("v"))
    df = df.withColumn("grey", grey)
    return df.select("n", "grey", scalars.tint(F.col("grey"), F.lit(0.5)).alias("lighter"), scalars.tint(F.col("grey"), F.lit(-0.25)).alias("darker"), scalars.luma(F.col("v"), F.col("v"), F.col("v")).alias("luma"))


# Pages -------------------------------------------------------------------------------------------

def _heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rows of a sheet for each brand and type, their size as the height."""
    return table(spark, sf_dir, "part").selectExpr("p_brand || '/' || p_type sheet", "p_partkey", "cast(p_size as double) size")


PACK_SQL = """
WITH RECURSIVE items AS (
  SELECT p_brand || '/' || p_type AS sheet, p_partkey, CAST(p_size AS DOUBLE) AS size,
         row_number() OVER (PARTITION BY p_brand || '/' || p_type ORDER BY p_partkey) AS n FROM part
), packed AS (
  SELECT sheet, p_partkey, size, n, size AS used, 0 AS page FROM items WHERE n = 1
  UNION ALL
  SELECT i.sheet, i.p_partkey, i.size, i.n, CASE WHEN p.used + i.size > 120.01 THEN i.size ELSE p.used + i.size END,
         CASE WHEN p.used + i.size > 120.01 THEN p.page + 1 ELSE p.page END
  FROM packed p JOIN items i ON i.sheet = p.sheet AND i.n = p.n + 1
)
"""


@query(PACK_SQL + "SELECT sheet, p_partkey, size, page FROM packed")
def page_pack_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.pack_rows(_heights(spark, sf_dir), ["sheet"], ["p_partkey"], "size", 120.0)


@query(
    PACK_SQL
    + """, groups AS (SELECT sheet, max(page) + 1 AS n FROM packed GROUP BY 1), g AS (SELECT sheet, n, unnest(range(n)) AS rg FROM groups), h AS (SELECT *, unnest(range(2)) AS cg FROM g)
SELECT sheet, CAST(rg AS INTEGER) AS rg, CAST(cg AS INTEGER) AS cg, CAST(cg * n + rg + 1 AS INTEGER) AS down_first, CAST(rg * 2 + cg + 1 AS INTEGER) AS over_first FROM h"""
)
def page_order_over_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = page_pack_rows(spark, sf_dir).groupBy("sheet").agg((F.max("page") + 1).alias("n"))
    grid = packed.select("sheet", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("rg")).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("cg"))
    page = lambda over: layout.page_number(F.col("rg"), F.col("cg"), F.col("n"), F.lit(2), F.lit(over))
    return grid.select("sheet", "rg", "cg", page(False).alias("down_first"), page(True).alias("over_first"))


PREFIX_SQL = "SELECT p_brand || '/' || p_type AS sheet, p_partkey, CAST(p_size AS DOUBLE) AS size, coalesce(sum(CAST(p_size AS DOUBLE)) OVER (PARTITION BY p_brand || '/' || p_type ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS start FROM part"


@query(PREFIX_SQL)
def prefix_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.prefix_offsets(_heights(spark, sf_dir), ["sheet"], ["p_partkey"], "size")


@query(
    f"""WITH o AS ({PREFIX_SQL}), p AS (SELECT DISTINCT sheet, CAST(x AS DOUBLE) AS x FROM o, (SELECT unnest([0.0, 10.0, 55.5, 100000.0]) AS x))
SELECT p.sheet, x, min(CASE WHEN start + size >= x - 0.01 THEN p_partkey END) AS cell FROM p LEFT JOIN o ON o.sheet = p.sheet GROUP BY 1, 2"""
)
def point_to_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = prefix_offsets(spark, sf_dir).withColumnRenamed("p_partkey", "ord")
    points = spans.select("sheet").distinct().select("sheet", F.explode(F.array(*map(F.lit, (0.0, 10.0, 55.5, 100000.0)))).alias("x"))
    return layout.point_to_cell(points, spans, ["sheet"], "x")


@query(
    """SELECT p_brand, greatest(0.1, least(1.0, least(540.0 / (count(*) * 10.0), 720.0 / sum(CAST(p_size AS DOUBLE))))) AS scale FROM part GROUP BY 1"""
)
def fit_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "part").groupBy("p_brand").agg((F.count(F.lit(1)) * 10.0).alias("w"), F.sum(F.col("p_size").cast("double")).alias("h"))
    return sums.select("p_brand", aggregates.fit_scale(F.col("w"), F.col("h"), F.lit(540.0), F.lit(720.0)).alias("scale"))


@query(CELLS + "SELECT doc_id, min(r) AS first_row, max(r) AS last_row, min(c) AS first_col, max(c) AS last_col FROM cells WHERE kind <> 'empty' AND c >= 3 GROUP BY 1")
def used_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.used_range(line_cells(spark, sf_dir).where("c >= 3"), ["doc_id"])


@query("SELECT p_brand, CASE WHEN max(p_size) > 11 AND max(p_size) * 1.117 + 2.0 > 15 THEN CAST(max(p_size) AS DOUBLE) * 1.117::DOUBLE + 2.0::DOUBLE ELSE 15.0::DOUBLE END AS height FROM part GROUP BY 1")
def row_auto_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    most = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.max("p_size").cast("double").alias("m"))
    return most.select("p_brand", aggregates.row_height(F.col("m"), F.lit(11.0), F.lit(15.0)).alias("height"))


@query(
    PACK_SQL
    + """, r AS (SELECT sheet, page AS rg, min(p_partkey) AS r1, max(p_partkey) AS r2 FROM packed GROUP BY 1, 2), n AS (SELECT sheet, max(rg) + 1 AS rgs FROM r GROUP BY 1),
c AS (SELECT * FROM (VALUES (0, 1, 2), (1, 3, 3)) t(cg, c1, c2))
SELECT r.sheet, CAST(cg * rgs + rg + 1 AS INTEGER) AS page, r1, r2, c1, c2 FROM r JOIN n ON n.sheet = r.sheet, c"""
)
def sheet_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rows, three columns of which two fit side by side: down, then over."""
    from quire.operators import pages

    rows = _heights(spark, sf_dir).selectExpr("sheet", "p_partkey r", "size height", "false hidden", "false break_after")
    sheets = rows.select("sheet").distinct()
    columns = sheets.selectExpr("sheet", "posexplode(array(60.0D, 70.0D, 80.0D)) as (i, width)").selectExpr("sheet", "i + 1 c", "width", "false break_after")
    options = sheets.selectExpr("sheet", "150.0D printable_w", "120.0D printable_h", "1.0D scale", "false fit_to_page", "0 fit_width", "0 fit_height", "false over_then_down")
    return pages.sheet_pages(rows, columns, options, ["sheet"]).select("sheet", "page", "r1", "r2", "c1", "c2")


@query(
    CELLS
    + """, f AS (SELECT doc_id, r, c, last_value(CASE WHEN kind <> 'empty' THEN c END IGNORE NULLS) OVER (PARTITION BY doc_id, r ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS left_c FROM cells)
SELECT doc_id, r, c, left_c FROM f"""
)
def left_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layout.left_neighbour(line_cells(spark, sf_dir), ["doc_id"])
    return found.select("doc_id", "r", "c", F.col("left.c").alias("left_c"))


PAGE_CELLS_SQL = (
    CELLS
    + """, styled AS (SELECT *, CAST(r % 3 AS INTEGER) AS xf, CASE WHEN c = 1 AND num > 40 THEN 0 WHEN c = 3 AND num < 0.02 THEN 1 END AS dxf FROM cells),
box AS (SELECT o_orderkey AS doc_id, 1 AS r1, 2 AS c1, 2 AS r2, 4 AS c2 FROM orders WHERE o_orderkey % 4 = 0),
held AS (SELECT s.*, b.r1, b.c1, b.c2, CASE WHEN s.c <= 3 THEN 1 ELSE 2 END AS page, CASE WHEN s.c <= 3 THEN 3 ELSE 5 END AS last FROM styled s LEFT JOIN box b ON b.doc_id = s.doc_id AND s.r BETWEEN b.r1 AND b.r2 AND s.c BETWEEN b.c1 AND b.c2),
room AS (SELECT *, min(CASE WHEN kind <> 'empty' THEN c END) OVER (PARTITION BY doc_id, page, r ORDER BY c ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS following FROM held)
SELECT doc_id, page, r, c, CAST(CASE WHEN r1 IS NULL THEN 1 ELSE least(c2, last) - c1 + 1 END AS INTEGER) AS span, CASE WHEN r > r1 THEN 'continue' WHEN r1 IS NOT NULL THEN 'restart' END AS vmerge,
  CASE WHEN r > r1 THEN NULL ELSE coalesce(CASE dxf WHEN 0 THEN TRUE END, xf = 1) END AS bold, CASE WHEN r > r1 THEN NULL ELSE coalesce(CASE dxf WHEN 0 THEN '#ff0000' END, CASE xf WHEN 2 THEN '#00ff00' END) END AS fill,
  CASE WHEN r > r1 THEN NULL ELSE coalesce(CASE dxf WHEN 1 THEN '0%' END, CASE xf WHEN 0 THEN 'General' ELSE '0.00' END) END AS code,
  CASE WHEN r > r1 THEN NULL WHEN xf = 2 THEN 'center' WHEN kind IN ('number', 'bool') THEN 'right' ELSE 'left' END AS align,
  CASE WHEN r > r1 OR xf = 1 THEN NULL ELSE greatest(10.0 * (coalesce(following, last + 1) - c) - 3, 1) END::DOUBLE AS room
FROM room WHERE r1 IS NULL OR c = c1"""
)


@query(PAGE_CELLS_SQL)
def page_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of two pages side by side with format, rule, merge and room in one view."""
    from quire.operators import pages

    spark, each = staying(spark), TASK_BYTES // 4  # a task sorts its cells for join after join
    cells = line_cells(spark, sf_dir, each).withColumn("xf", (F.col("r") % 3).cast("int"))
    area = (1, 1, 1_000_000, 1)
    cells = condfmt.apply_rules(cells, (condfmt.Rule(area, 1, 0, "cellIs", "greaterThan", ("40",)), condfmt.Rule((1, 3, 1_000_000, 3), 1, 1, "cellIs", "lessThan", ("0.02",))))
    docs = by_order(table(spark, sf_dir, "orders").selectExpr("o_orderkey doc_id"), "doc_id", line_bytes(spark, sf_dir), each)
    sheets = docs.selectExpr("doc_id", "0 sheet_idx")
    look = lambda rows, names: docs.selectExpr("doc_id", f"inline(array({', '.join(rows)}))").toDF("doc_id", *names)
    nothing = "cast(null as string), cast(null as double)"
    rest = "cast(null as boolean), cast(null as boolean), cast(null as boolean), cast(null as string)"
    names = ["idx", "num_fmt", "align", "valign", "wrap", "indent", "font", "size", "bold", "italic", "underline", "strike", "color", "fill", "borders"]
    xf = lambda k, code, align, wrap, bold, fill: f"struct({k}, '{code}', {align}, 'bottom', {wrap}, 0.0D, {nothing}, {bold}, {rest}, {fill}, array('x'))"
    none = "cast(null as string)"
    xfs = look([xf(0, "General", none, "false", "false", none), xf(1, "0.00", none, "true", "true", none), xf(2, "0.00", "'center'", "false", "false", "'#00ff00'")], names)
    dxf = lambda k, code, bold, fill: f"struct({k}, {code}, {nothing}, {bold}, {rest}, {fill})"
    dxfs = look([dxf(0, none, "true", "'#ff0000'"), dxf(1, "'0%'", "cast(null as boolean)", none)], ["idx", "num_fmt", *names[6:14]])
    merges = sheets.where("doc_id % 4 = 0").selectExpr("*", "0 ordinal", "1 r1", "2 c1", "2 r2", "4 c2")
    parts = sheets.selectExpr("*", "inline(array(struct(1, 1, 1000, 1, 3), struct(2, 1, 1000, 4, 5)))").toDF("doc_id", "sheet_idx", "page", "r1", "r2", "c1", "c2")
    columns = sheets.selectExpr("*", "explode(sequence(1, 5)) c", "10.0D width")
    out = pages.page_cells(cells.drop("num", "txt", "flag"), parts, columns, xfs, dxfs, merges)
    return out.select("doc_id", "page", "r", "c", "span", "vmerge", "bold", "fill", "code", "align", "room")
