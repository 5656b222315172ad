"""Formulas, number formats and scalars: a table of cases each."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quire.functions import formula as X
from quire.functions import numfmt, scalars


def value_of(spark, text, cells=None):
    made = X.compile_formula(text, cells or X.columns_as_cells({}))
    if made is None:
        return None
    kind = F.lit(made.kind) if isinstance(made.kind, str) else made.kind
    r = spark.range(1).select(kind.alias("k"), made.n.alias("n"), made.s.alias("s"), made.b.alias("b")).first()
    return {"n": r.n, "s": r.s, "b": r.b, "e": ""}.get(r.k)


CASES = {
    "1+2*3": 7.0, "-2^2": 4.0, "2^3^2": 64.0, "(1+2)*3": 9.0, "50%": 0.5, "200%%": 0.02, "1/0": None, "1=1": True, '"A"="a"': True, '"b">"a"': True, "2<>2": False, "1<=1": True, '1&"x"': "1x", "1.5&TRUE": "1.5TRUE",
    "SUM(1,2,TRUE,\"x\")": 4.0, "SUM()": 0.0, "AVERAGE(\"x\")": None, "AVERAGE(1,2)": 1.5, "MIN()": math.inf, "MAX(\"x\")": -math.inf, "MAX(1,5,3)": 5.0, "COUNT(1,\"a\",FALSE)": 2.0, "COUNTA(1,\"a\",A1)": 2.0, "COUNTBLANK(1,A1)": 1.0,
    "ABS(-3)": 3.0, "INT(-1.5)": -2.0, "ROUND(2.5)": 3.0, "ROUND(-2.5)": -3.0, "ROUND(1.25,1)": 1.3, "ROUND(1250,-2)": 1300.0, "MOD(7,-3)": -2.0, "MOD(-7,3)": 2.0, "MOD(1,0)": None, "MOD(1)": None,
    "AND()": True, "AND(1,\"x\")": True, "OR(0,A1)": False, "NOT(0)": True, 'IF(1,"a","b")': "a", 'IF(0,"a")': False, "IF(1)": True, "IF(1,2,1/0)": None, "IFERROR(1/0,5)": None, "IFERROR(3,5)": 3.0, "IF(0,1,\"x\")": "x",
    "ISBLANK(A1)": True, "ISNUMBER(1)": True, "ISNUMBER(TRUE)": False, 'ISTEXT("")': True, 'LEN("héé")': 3.0, "LEN(12.5)": 4.0, 'UPPER("é")': "É", 'TRIM("  a   b ")': "a b", 'LEFT("abc")': "a", 'LEFT("abc",9)': "abc", 'RIGHT("abc",2)': "bc", 'RIGHT("abc",0)': "",
    'MID("abcd",2,2)': "bc", 'MID("abcd",0,2)': "ab", 'MID("abcd",2)': "", 'VALUE(" 12.5 ")': 12.5, 'VALUE("12d")': None, 'VALUE("x")': None, 'N("1e2")': 100.0, 'EXACT("a","A")': False, "EXACT(1,\"1\")": True, "ISEVEN(-2.9)": True, "ISODD(3.9)": True, "ISODD(2)": False,
    "TRUE()": None, "TRUE": True, "NOSUCH(1)": None, "1+": None, "(1": None, "1 2": None, '"a""b"': 'a"b', "=1+1": 2.0, "SUM(1;2)": 3.0, "Sheet1!A1+1": 1.0, "'My Sheet'!A1+1": 1.0, "1#2": None, '"5"+1': 6.0, '"x"+1': None, "A1=0": True, 'A1=""': True, "2>\"10\"": True,
}


def test_formulas(spark):
    wrong = {}
    for text, want in CASES.items():
        got = value_of(spark, text)
        if not (got == want and type(got) is type(want)) and not (isinstance(want, float) and got == pytest.approx(want)):
            wrong[text] = (got, want)
    assert not wrong


def test_ranges_and_offsets(spark):
    cells = X.columns_as_cells({"A": X.num(1.0), "B": X.num(2.0), "C": X.txt("t")})
    assert value_of(spark, "SUM(A1:C1)", cells) == 3.0 and value_of(spark, "A1:B1+1", cells) == 2.0
    assert value_of(spark, "SUM(A1:A99999)", cells) is None


def test_random_arithmetic(spark):
    rng = random.Random(3)

    def make(depth):
        if not depth:
            n = rng.randrange(1, 20)
            return str(n), float(n)
        a, x = make(depth - 1)
        b, y = make(rng.randrange(depth))
        op = rng.choice("+-*/")
        if op == "/" and (y is None or y == 0):
            op = "+"
        value = None if x is None or y is None else {"+": x + y, "-": x - y, "*": x * y, "/": x / y if y else None}[op]
        return f"({a}){op}({b})", value

    for _ in range(15):
        text, want = make(4)
        assert value_of(spark, text) == pytest.approx(want)


SHOWN = {
    ("General", 1234567.0): "1234567", ("General", 0.1 + 0.2): "0.3", ("General", -1.5): "-1.5", ("General", 1234.56789012345): "1234.56789", ("General", 1.23456789e12 + 0.5): "1.23457E+12", ("General", 0.00001234): "1.23400E-5", ("General", 0.0): "0",
    ("0.00", 0.125): "0.12", ("0.00", 1.005): "1.00", ("0.00", -0.001): "-0.00", ("#,##0", 1234567.0): "1,234,567", ("#,##0.00", -1234.5): "-1,234.50", ("0000", 12.0): "0012", ("#.0", 0.5): ".5", ("0%", 0.256): "26%", ("%0", 0.5): "%50",
    ("0.00E+00", 12345.0): "1.23E+04", ("0.00E+00", 0.00012): "1.20E-04", ("##0.0E+0", 5.0): "5.0E+00", ("# ?/?", 1.5): "1 1/2", ("# ?/?", 0.3333): "1/3", ("# ?/?", 2.0): "2", ("# ??/??", 3.14159): "3 14/99", ("?/4", 0.75): "3/4", ("# ?/8", -1.125): "-1 1/8",
    ("$0.0", -5.0): "$-5.0", ("0;(0)", -5.0): "(5)", ("0;-0;zero", 0.0): "zero0", ('0"x"\\y_)', 3.0): "3xy ", ("[$€-407]0", 3.0): "€3", ("[Red]0", 3.0): "3", ("[>100]0;0.0", 5.0): "5", ("*-0", 4.0): "4", ("0,", 5000.0): "5,000",
    ("m/d/yyyy", 45000.0): "3/15/2023", ("d-mmm-yy", 59.0): "28-Feb-00", ("yyyy-mm-dd", 60.0): "1900-03-01", ("yyyy-mm-dd", 61.0): "1900-03-01", ("dddd", 1.0): "Sunday", ("ddd dd", 45000.0): "Wed 15", ("h:mm AM/PM", 0.5): "12:00 PM", ("h:mm A/P", 0.0): "12:00 A",
    ("hh:mm:ss", 0.999999): "24:00:00", ("mm:ss", 0.0423611111): "01:00", ("[h]:mm:ss", 1.5): "36:00:00", ("[m]", 1.5): "2160", ("mmmm", 45000.0): "March", ('"on" d', 45000.0): "on 15",
}


def test_number_formats(spark):
    cases = [(c, v, w) for (c, v), w in SHOWN.items()]
    row = spark.createDataFrame([tuple(v for _, v, _ in cases)], ", ".join(f"v{i} double" for i in range(len(cases))))
    wrong = {}
    for i, (code, v, want) in enumerate(cases):
        got = row.select(numfmt.format_value(F.col(f"v{i}"), code)).first()[0]
        if got != want:
            wrong[code, v] = (got, want)
    assert not wrong
    assert not numfmt.is_date_code("mmss.0") and numfmt.is_date_code("[h]:mm") and not numfmt.is_date_code('"day" 0')
    one = spark.range(1)
    assert one.select(numfmt.format_text(F.lit("t"), '"<"@">"')).first()[0] == "<t>"
    assert one.select(numfmt.format_text(F.lit("t"), '0;0;0;@"!"')).first()[0] == "t!"
    assert one.select(numfmt.format_text(F.lit("t"), "0.00")).first()[0] == "t"
    assert one.select(numfmt.format_colour(F.lit(-1.0), "0;[Blue]0")).first()[0] == "#0000ff"


def test_references(spark):
    want = {1: "A", 26: "Z", 27: "AA", 52: "AZ", 702: "ZZ", 703: "AAA", 16384: "XFD"}
    df = spark.createDataFrame([(k, v) for k, v in want.items()], "n int, t string")
    assert all(r.t == r.a and r.n == r.b for r in df.select("n", "t", scalars.column_letters(F.col("n")).alias("a"), scalars.column_number(F.col("t")).alias("b")).collect())
    for ref, at in {"$B$7": (7, 2), "'x y'!aa10": (10, 27), "A0": None, "7": None, "ABCD1": None}.items():
        got = spark.range(1).select(scalars.parse_a1(F.lit(ref))).first()[0]
        assert (tuple(got) if got else None) == at
    assert tuple(spark.range(1).select(scalars.parse_range(F.lit("S!C9:A2"))).first()[0]) == (2, 1, 9, 3)


def test_numerals_and_colours(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert [get(scalars.numeral(F.lit(n), f)) for n, f in ((1994, "upperRoman"), (0, "lowerRoman"), (28, "lowerLetter"), (0, "upperLetter"), (7, "decimalZero"), (12, "decimalZero"), (112, "ordinal"), (23, "ordinal"), (5, "none"), (5, "x"))] == [
        "MCMXCIV", "0", "bb", "", "07", "12", "112th", "23rd", "", "5",
    ]
    assert get(scalars.tint(F.lit("#ff0000"), F.lit(0.5))) == "#ff8080" and get(scalars.tint(F.lit("#4472c4"), F.lit(0.0))) == "#4472c4" and get(scalars.tint(F.lit("zz"), F.lit(0.1))) is None
    assert get(scalars.indexed_colour(F.lit(10))) == "#ff0000" and get(scalars.indexed_colour(F.lit(65))) == "#ffffff" and get(scalars.indexed_colour(F.lit(99))) is None
    assert get(scalars.length_points(F.lit("2.54cm"))) == pytest.approx(72) and get(scalars.length_points(F.lit("3"))) is None and get(scalars.percent_share(F.lit("50%"))) == 0.5
    assert tuple(get(scalars.nice_axis(F.lit(0.0), F.lit(87.0)))) == (0.0, 90.0, 10.0)
    assert get(scalars.next_tab(F.array(F.lit(10.0), F.lit(50.0)), F.lit(20.0), F.lit(0.0), F.lit(0.0), F.lit(36.0))) == 50.0
    assert get(scalars.next_tab(F.array().cast("array<double>"), F.lit(40.0), F.lit(0.0), F.lit(0.0), F.lit(36.0))) == 72.0
    assert get(scalars.bullet_text(F.lit("x"))) == "•▪•x"
    assert [tuple(x) for x in get(scalars.small_caps(F.lit("Ab C")))] == [("A", 1.0), ("B", 0.8), (" C", 1.0)]
    assert get(scalars.strip_tags(F.lit("<p>a &amp;\n <b>b</b> <unclosed"))) == "a &amp; b"
