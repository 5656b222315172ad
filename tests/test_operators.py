"""Operators against small cases worked out by hand or by a plain loop."""

import random

from pyspark.sql import functions as F

from quire.operators import aggregates, charts, condfmt, fidelity, layout, lookups, numbering, styles
from quire.plans import documents


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def cells(spark, data):
    return spark.createDataFrame([(1, 0, *d) for d in data], "doc_id int, sheet_idx int, r int, c int, kind string, num double, txt string, flag boolean")


def test_rules_first_hit_and_references(spark):
    data = [(1, 1, "number", 5.0, None, None), (1, 2, "number", 9.0, None, None), (2, 1, "text", None, "Total", None), (2, 2, "empty", None, None, None), (3, 1, "bool", None, None, True), (3, 2, "number", 5.0, None, None)]
    R = condfmt.Rule
    rules = [
        R((1, 1, 9, 9), 5, 1, "cellIs", "greaterThan", ("4",)),
        R((1, 1, 9, 9), 1, 2, "cellIs", "between", ("A1", "8")),
        R((1, 2, 3, 2), 1, 3, "expression", "", ("A1=5",)),
        R((1, 1, 9, 9), 2, 4, "beginsWith", text="tO"),
        R((1, 1, 9, 9), 2, 5, "containsBlanks"),
        R((1, 1, 9, 9), 0, 6, "colorScale"),
        R((1, 1, 9, 9), 0, 7, "expression", "", ("1/0",)),
        R((1, 1, 9, 9), 0, 8, "cellIs", "equal", ("no such thing",)),
    ]
    got = {(r, c): d for r, c, d in rows(condfmt.apply_rules(cells(spark, data), rules), "r", "c", "dxf")}
    # Rule 2 reads the cell at the same place, so any number up to 8 is between it and 8.
    assert got == {(1, 1): 2, (1, 2): 2, (2, 1): 4, (2, 2): 5, (3, 1): None, (3, 2): 2}


def test_rules_above_the_sheet_fail(spark):
    rules = [condfmt.Rule((1, 1, 5, 1), 1, 1, "expression", "", ("A1>0",), origin=(2, 1))]
    data = [(1, 1, "number", 1.0, None, None), (2, 1, "number", 1.0, None, None)]
    assert rows(condfmt.apply_rules(cells(spark, data), rules), "r", "dxf") == [(1, None), (2, 1)]


def test_rules_read_large_ranges_whole(spark):
    n = 20_000
    body = spark.range(1, n + 1).selectExpr("cast(id as int) r").selectExpr("r", "explode(array(1, 2, 3)) c").where("c = 2 or r <= 4 or (c = 3 and r = 15000)")
    text = "c = 3 and r = 1"
    body = body.selectExpr("1 doc_id", "0 sheet_idx", "r", "c", f"if({text}, 'text', 'number') kind", f"if({text}, null, cast(if(c = 2, r, if(c = 3, 7, 9999 + r)) as double)) num", f"if({text}, 'x', null) txt", "cast(null as boolean) flag")
    other = cells(spark, [(1, 1, "number", 1.0, None, None), (2, 2, "number", 5.0, None, None)]).selectExpr("2 doc_id", "sheet_idx", "r", "c", "kind", "num", "txt", "flag")
    table = body.unionByName(other)
    mean, whole = (n + 1) / 2, n * (n + 1) / 2  # 10000.5

    def hits(*formulas, area=(1, 1, 4, 1), kind="expression", operator="", doc=1):
        rules = [condfmt.Rule(area, 1, 1, kind, operator, formulas)]
        return [tuple(x) for x in condfmt.apply_rules(table, rules).where(f"doc_id = {doc} and dxf = 1").select("r", "c").orderBy("r", "c").collect()]

    # Cells A1:A4 are 10000 to 10003, so those over the mean of B are A2:A4.
    assert hits(f"AVERAGE($B$1:$B${n})", kind="cellIs", operator="greaterThan") == [(2, 1), (3, 1), (4, 1)]
    assert hits(f"AVERAGE($B$1:$B${n})={mean}", doc=2) == [] and hits(f"SUM($B$1:$B${n})=5", doc=2) == [(1, 1)]
    # Relative rows: B[r..r + n - 1] loses the first r - 1 numbers.
    assert hits(f"SUM(B1:B{n})={whole - 3}") == [(3, 1)]
    # Relative columns: from A to B, from B to C.
    assert hits(f"COUNT(B$1:B${n})={n}", area=(1, 1, 1, 3)) == [(1, 1)] and hits(f"COUNT(B$1:B${n})=4", area=(1, 1, 1, 3)) == [(1, 2)]
    # One end fixed: running sums 1, 3, 6, 10.
    assert hits("SUM($B$1:$B1)=6") == [(3, 1)]
    everything = "$A$1:$XFD$1048576"
    assert hits(f"COUNTA({everything},1)={n + 4 + 5 + 1}") == [(r, 1) for r in range(1, 5)]
    assert hits(f"COUNTBLANK($C$1:$C${n})={n - 5}", area=(1, 1, 1, 1)) == [(1, 1)]
    assert hits(f"AND($B$1:$B${n})", area=(1, 1, 1, 1)) == [(1, 1)] and hits(f"AND($C$1:$C${n})", area=(1, 1, 1, 1)) == [] and hits(f"OR($C$1:$C${n})", area=(1, 1, 1, 1)) == [(1, 1)]
    assert hits(f"MAX($C$1:$C${n},3)+MIN($B$1:$B${n})=8", area=(1, 1, 1, 1)) == [(1, 1)]
    assert hits(f'$C$1:$C${n}="x"', area=(1, 1, 1, 1)) == [(1, 1)]  # the first cell's value
    # Ranges that start above the sheet fail the rule.
    up = [condfmt.Rule((1, 1, 4, 1), 1, 1, "expression", "", (f"COUNT(B1:B{n})>0",), origin=(3, 1))]
    assert rows(condfmt.apply_rules(body, up).where("dxf = 1").orderBy("r"), "r") == [(3,), (4,)]


def test_rectangles_match_a_plain_loop(spark):
    rng = random.Random(1)
    points = [(rng.randrange(1, 3000), rng.randrange(1, 300)) for _ in range(200)]
    areas = [(a, b, a + rng.randrange(2000), b + rng.randrange(150)) for a, b in ((rng.randrange(1, 2000), rng.randrange(1, 200)) for _ in range(30))]
    left = spark.createDataFrame([(1, 0, *p) for p in points], "doc_id int, sheet_idx int, r int, c int")
    right = spark.createDataFrame([(1, 0, i, *a) for i, a in enumerate(areas)], "doc_id int, sheet_idx int, ordinal int, r1 int, c1 int, r2 int, c2 int")
    got = sorted(rows(condfmt.match_rectangles(left, right), "r", "c", "ordinal"))
    assert got == sorted((r, c, i) for r, c in points for i, (a, b, x, y) in enumerate(areas) if a <= r <= x and b <= c <= y)


def test_odf_conditions():
    assert condfmt.odf_condition("cell-content()>=[.B2]") == ("cellIs", "greaterThanOrEqual", ("B2",), None)
    assert condfmt.odf_condition("cell-content-is-not-between(1,2)") == ("cellIs", "notBetween", ("1", "2"), None)
    assert condfmt.odf_condition('begins-with("x")') == ("beginsWith", "", (), "x")
    assert condfmt.odf_condition("formula-is(of:=SUM([.A1:.B2];1)>[$Sheet.C$3])") == ("expression", "", ("SUM(A1:B2,1)>C$3",), None)
    assert condfmt.odf_condition("nonsense") is None


def test_pack_matches_a_plain_loop(spark):
    rng = random.Random(2)
    sizes = [float(rng.randrange(1, 60)) for _ in range(80)]
    breaks = [rng.random() < 0.1 for _ in sizes]
    want, group, used = [], 0, 0.0
    for i, s in enumerate(sizes):
        if i and (used + s > 100.01 or breaks[i - 1]):
            group, used = group + 1, 0.0
        used += s
        want.append(group)
    df = spark.createDataFrame([(sizes, breaks)], "s array<double>, b array<boolean>")
    assert df.select(layout.pack(F.col("s"), 100.0, F.col("b"))).first()[0] == want
    assert spark.range(1).select(layout.pack(F.array().cast("array<double>"), 5.0)).first()[0] == []


def test_distributed_numbers(spark):
    df = spark.range(1000).selectExpr("id % 97 k", "id").repartition(7)
    got = rows(layout.numbered(df, "k", ["id"], parts=8).orderBy("n"), "k", "id", "n")
    assert [g[2] for g in got] == list(range(1, 1001)) and [g[:2] for g in got] == sorted(g[:2] for g in got)
    assert layout.numbered(df.where("id < 0"), "k", ["id"]).count() == 0


def test_counters(spark):
    items = [(1, 0), (2, 1), (3, 1), (4, 2), (5, 0), (6, 1), (7, 2), (8, 2)]
    df = spark.createDataFrame([(1, *i) for i in items], "d int, ord int, lvl int")
    got = rows(numbering.level_counts(df, ["d"], "ord", "lvl", 3).orderBy("ord"), numbering.label(F.col("counts"), "%1.%2)%3", ("decimal", "lowerLetter", "upperRoman")).alias("x"))
    assert [g[0] for g in got] == ["1.)0", "1.a)0", "1.b)0", "1.b)I", "2.)0", "2.a)0", "2.a)I", "2.a)II"]


def test_a_supplier_with_key_0_stands_below_its_nation(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(0, "R")], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    spark.createDataFrame([(k, f"N{k}", 0) for k in range(3)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(k, f"S{k}", 1) for k in range(3)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    made = documents._outline
    for first in (F.asc, F.desc):  # whichever level an exchange brings first
        monkeypatch.setattr(documents, "_outline", lambda *a, first=first: made(*a).coalesce(1).orderBy(first("lvl")))
        got = dict(rows(documents.list_numbering_3level(spark, str(tmp_path)), "name", "label"))
        assert got == {"R": "1.", "N0": "1.1", "N1": "1.2", "N2": "1.3", "S0": "1.2.1", "S1": "1.2.2", "S2": "1.2.3"}


def test_overrides_share_the_abstract_list(spark):
    items = spark.createDataFrame([(1, i, n, lv) for i, (n, lv) in enumerate([("a", 0), ("a", 0), ("b", 0), ("a", 0), ("b", 1), ("b", 0), ("z", 0)])], "doc_id int, ord int, num_id string, level int")
    inst = spark.createDataFrame([(1, "a", "x", [1, 1], None), (1, "b", "x", [1, 1], {0: 7})], "doc_id int, num_id string, abstract_id string, starts array<long>, overrides map<int,long>")
    got = rows(numbering.counters_with_overrides(items, inst).orderBy("ord"), "counts")
    assert [g[0] for g in got] == [[1, 0], [2, 0], [7, 0], [8, 0], [8, 1], [9, 0]]


def test_cascade_ends_in_circles_and_long_chains(spark):
    chain = [(1, f"s{i}", f"s{i - 1}" if i else None, 10.0 if not i else None) for i in range(40)] + [(1, "a", "b", None), (1, "b", "a", 3.0), (2, "s1", "s0", None)]
    got = dict(rows(styles.cascade(spark.createDataFrame(chain, "d int, style_id string, parent_id string, size double").where("d = 1"), ["d"], ["size"]), "style_id", "size"))
    assert got["s31"] == 10.0 and got["s32"] is None and got["a"] == 3.0 and got["b"] == 3.0


def test_merges(spark):
    get = lambda c: spark.range(1).select(c).first()[0]
    assert get(styles.merge(F.lit("w"), F.lit(None).cast("string"))) == "w"
    tab = lambda at, clear=False: F.struct(F.lit(float(at)).alias("at"), F.lit(clear).alias("clear"))
    assert [t.at for t in get(styles.merge_tabs(F.array(tab(10), tab(20)), F.array(tab(20, True), tab(5))))] == [5.0, 10.0]
    step = lambda s=None, p=None: F.struct(F.lit(s).cast("double").alias("size"), F.lit(p).cast("double").alias("percent"))
    assert get(styles.relative_size(F.array(step(10), step(p=150), step()), F.lit(12.0))) == 15.0
    assert [get(styles.toggle(F.lit(True), F.lit(k))) for k in (0, 1, 128, 129)] == [False, True, True, False]


def test_lcs_and_overlap(spark):
    rng = random.Random(4)

    def plain(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    pairs = [([rng.choice("abcd") for _ in range(rng.randrange(12))], [rng.choice("abcd") for _ in range(rng.randrange(12))]) for _ in range(60)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = dict(rows(df, "i", fidelity.lcs_length(F.col("a"), F.col("b")).alias("n")))
    assert all(got[i] == plain(a, b) for i, (a, b) in enumerate(pairs))
    a = spark.createDataFrame([(1, "The the cat"), (2, ""), (3, None)], "k int, text string")
    b = spark.createDataFrame([(1, "the cat dog dog"), (2, "x")], "k int, text string")
    got = {r.k: (r.hit, r.recall, r.precision) for r in fidelity.recall_precision(a, b, ["k"]).collect()}
    assert got == {1: (2, 2 / 3, 0.5), 2: (0, 1.0, 0.0), 3: (0, 1.0, 1.0)}
    assert rows(spark.createDataFrame([("ﬁ A‑b",)], "t string"), fidelity.nfkc(F.col("t")).alias("x")) == [("fi A-b",)]


def test_lookups(spark):
    cell = spark.createDataFrame([(1, "shared", 1.0, None), (1, "shared", 9.0, None), (2, "number", 1.0, None)], "doc_id int, kind string, num double, txt string")
    table = spark.createDataFrame([(1, 1, "one"), (2, 1, "other")], "doc_id int, idx int, text string")
    assert sorted(rows(lookups.shared_strings(cell, table), "doc_id", "kind", "num", "txt"), key=str) == [(1, "empty", None, None), (1, "text", None, "one"), (2, "number", 1.0, None)]
    runs = spark.createDataFrame([(1, 0, 5, "a"), (1, 8, 9, "b")], "d int, s int, e int, v string")
    at = spark.createDataFrame([(1, x) for x in (-1, 0, 4, 5, 8, 9)], "d int, at int")
    assert [v for _, v in sorted(rows(lookups.nearest_run(at, runs, ["d"], "at", "s", "e", "v"), "at", "v"))] == [None, "a", "a", None, "b", None]
    shapes = spark.createDataFrame([(1, "ctrTitle", None, None), (1, "body", 3, None), (1, "dt", None, 9.0)], "doc_id int, type string, idx int, x double")
    lay = spark.createDataFrame([(1, "title", None, 1.0, 0), (1, "body", 3, None, 1), (1, "title", None, 5.0, 2)], "doc_id int, type string, idx int, x double, ordinal int")
    mas = spark.createDataFrame([(1, "obj", 3, 2.0, 0)], "doc_id int, type string, idx int, x double, ordinal int")
    assert sorted(rows(lookups.placeholders(shapes, lay, mas, ["x"]), "type", "x")) == [("body", 2.0), ("ctrTitle", 1.0), ("dt", 9.0)]


def test_aggregates_of_nothing(spark):
    none = spark.createDataFrame([], "kind string, num double, flag boolean")
    x = aggregates.numeric(F.col("kind"), F.col("num"), F.col("flag"))
    got = none.agg(aggregates.sheet_sum(x), aggregates.sheet_average(x), aggregates.sheet_min(x), aggregates.sheet_max(x), aggregates.sheet_and(F.col("flag"))).first()
    assert got[:] == (0.0, None, float("inf"), float("-inf"), True)


def test_charts(spark):
    df = spark.createDataFrame([("x", "b", 1.0), ("x", "a", 2.0), ("y", "a", -4.0)], "s string, c string, v double")
    points = charts.chart_points(df, [], "c", "s", "v")
    assert sorted(rows(points, "s", "pos", "value"), key=str) == [("x", 1, 2.0), ("x", 2, 1.0), ("y", 1, -4.0), ("y", 2, None)]
    assert rows(charts.pie_angles(points, ["s"], "pos").orderBy("pos"), "s", "share") == [("x", 2 / 3), ("x", 1 / 3)]
    get = lambda c: spark.range(1).select(c).first()[0]
    assert get(charts.chart_title(F.lit(None).cast("string"), F.array(F.lit("only")), F.lit(False))) == "only"
    assert [get(charts.table_band(F.lit(r), F.lit(True), F.lit(True))) for r in range(3)] == ["header", "band1", "band2"]


def test_drawing(spark):
    from quire.functions import drawing as D

    value = D.equation_value
    eq = {"f0": "?f1*2", "f1": "$0+1", "loop": "?loop+1"}
    assert value("?f0-width/2", eq, [4.0], {"width": 6.0}) == 7.0 and value("1/0") == 0.0 and value("if(1,2,3)+if(0,2,3)") == 5.0
    assert value("-2*-(3+1)") == 8.0 and value("min(3,max(1,2))") == 2.0 and value("atan2(0,1)+sqrt(-4)") == 0.0 and value("?loop", eq) == DEPTH_OF_LOOP
    get = lambda c: spark.range(1).select(c).first()[0]
    mods = lambda *m: F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).alias("val")) for n, v in m])
    assert get(D.modified_colour(F.lit("#4472c4"), mods(("lumMod", 0.0)))) == "#000000"
    assert get(D.modified_colour(F.lit("#4472c4"), mods(("lumMod", 0.4), ("lumOff", 0.6)))) == "#b4c7e7"
    assert get(D.modified_colour(F.lit("#808080"), mods(("tint", 0.0)))) == "#ffffff" and get(D.modified_colour(F.lit("#808080"), mods(("shade", 1.0)))) == "#808080"
    assert get(D.preset_colour(F.lit("Orange"))) == "#ffa500" and get(D.preset_colour(F.lit("nope"))) is None
    box = F.struct(*[F.lit(v).alias(k) for k, v in zip("xywh", (10.0, 10.0, 4.0, 4.0), strict=True)])
    group = lambda *v: F.struct(*[F.lit(float(x)).alias(k) for k, x in zip(("x", "y", "w", "h", "cx", "cy", "cw", "ch"), v, strict=True)])
    assert tuple(get(D.placed(box, F.array(group(100, 0, 50, 50, 0, 0, 100, 100), group(0, 0, 100, 100, 0, 0, 50, 50))))) == (110.0, 10.0, 4.0, 4.0)
    parts = [(p["zone"], p["kind"], p["text"], p["bold"]) for p in D.header_parts('mid&L&BA&&&A&RPage &P of &N&"Arial,Bold"x&14y', "S1")]
    assert parts == [("left", "text", "A&S1", True), ("center", "text", "mid", None), ("right", "text", "Page ", True), ("right", "page", None, True), ("right", "text", " of ", True), ("right", "pages", None, True), ("right", "text", "x", True), ("right", "text", "y", True)]
    assert [x.kind for x in get(D.header_runs(F.lit("&P"), F.lit("s")))] == ["page"]
    assert get(D.encode_style_name(F.lit("My Sty.le-é"))) == "My_20_Sty.le-_e9_"
    assert get(D.vml_style(F.lit("width: 5pt; height:6pt;width:7pt;junk"))) == {"height": "6pt", "width": "7pt"}


#: A circle of equations counts up to the depth allowed.
DEPTH_OF_LOOP = 65.0


def test_decompiled_formulas():
    import struct

    from quire.sources.biff_formula import decompile

    assert decompile(b"\x24" + struct.pack("<HH", 0, 0x4001) + b"\x1f" + struct.pack("<d", 2.5) + b"\x05", (1, 1)) == "B$1*2.5"
    assert decompile(b"\x25" + struct.pack("<HHHH", 0, 4, 0xC000, 0xC001) + b"\x22\x01" + struct.pack("<H", 4) + b"\x14", (1, 1)) == "SUM(A1:B5)/100"
    assert decompile(b"\x4c" + struct.pack("<HH", 0xFFFF, 0xC0FF), (3, 3)) == "B2"
    assert decompile(b"\x17\x02\x00a\"", (1, 1)) == '"a"""' and decompile(b"\x1d\x01\x21" + struct.pack("<H", 38), (1, 1)) == "NOT(TRUE)"
    assert decompile(b"\x03", (1, 1)) is None and decompile(b"\x3f", (1, 1)) is None and decompile(b"\x1e\x01", (1, 1)) is None


def test_pages_fit_and_break(spark):
    from quire.operators import pages

    rows = spark.createDataFrame([("s", r, 10.0, r == 3, r == 4) for r in range(1, 9)], "k string, r int, height double, hidden boolean, break_after boolean")
    cols = spark.createDataFrame([("s", c, 30.0, False) for c in range(1, 4)], "k string, c int, width double, break_after boolean")
    make = lambda fit, over: spark.createDataFrame([("s", 60.0, 40.0, 1.0, fit, 1, 1, over)], "k string, printable_w double, printable_h double, scale double, fit_to_page boolean, fit_width int, fit_height int, over_then_down boolean")
    got = sorted(rows_of for rows_of in rows_as(pages.sheet_pages(rows, cols, make(False, True), ["k"]), "page", "r1", "r2", "c1", "c2"))
    assert got == [(1, 1, 4, 1, 2), (2, 1, 4, 3, 3), (3, 5, 8, 1, 2), (4, 5, 8, 3, 3)]
    assert rows_as(pages.sheet_pages(rows, cols, make(True, False), ["k"]), "page", "scale", "r2") == [(1, 40 / 70, 4), (2, 40 / 70, 8)]
    notes = spark.createDataFrame([("s", 6, 2, "n")], "k string, r int, c int, text string")
    found = pages.page_notes(notes, pages.sheet_pages(rows, cols, make(False, True), ["k"]), rows, cols, ["k"])
    assert rows_as(found, "page", "x", "y") == [(3, 60.0, 10.0)]


rows_as = rows


def test_typesetting(spark):
    from quire.functions import typeset as T
    from quire.sources.sniff import jpeg_dimensions

    get = lambda c: spark.range(1).select(c).first()[0]
    assert [get(T.font_alias(F.lit(n))) for n in ("Calibri", " ARIAL ", "Georgia", "My Mono", "Sans Serif", "Old Roman", "What")] == ["Carlito", T.SANS, T.SERIF, T.MONO, T.SANS, T.SERIF, T.SANS]
    assert get(T.font_alias(F.lit("What"), F.lit("serif"))) == T.SERIF
    assert get(T.keep_space_tokens(F.lit("a  bc d"))) == ["a ", " ", "bc ", "d"]
    assert get(T.hyphen_breaks(F.lit("A-1 1-2 b-c"))) == "A-​1 1-2 b-c"
    assert [get(T.points_text(F.lit(v))) for v in (0.0001, 12.0, 1234.5678, -0.5)] == ["0pt", "12pt", "1234.568pt", "-0.5pt"]
    assert get(T.quoted(F.lit('a"b\\c\n\x7f'))) == '"a\\"b\\\\c\\u{a}\\u{7f}"'
    spacing = lambda k, v: F.struct(F.lit(k).alias("kind"), F.lit(v).alias("value"))
    assert tuple(get(T.line_edges(F.lit(10.0), spacing("multiple", 1.0)))) == (10.0, 2.0) and tuple(get(T.line_edges(F.lit(10.0), spacing("exact", 8.0)))) == (6.0, 2.0)
    font = F.struct(F.lit(0.9).alias("ascender"), F.lit(0.2).alias("descender"), F.lit(0.0).alias("line_gap"))
    assert [round(x, 6) for x in get(T.line_edges(F.lit(10.0), spacing("multiple", 2.0), font))] == [9.0, 13.0]
    slots = F.struct(F.lit("d").alias("default"), F.lit(None).cast("string").alias("first"), F.lit("e").alias("even"))
    assert [get(T.margin_slot(F.lit(p), F.lit(1), F.lit(True), F.lit(True), slots)) for p in (1, 2, 3)] == ["", "e", "d"]
    table = spark.createDataFrame([(1, 0, 2), (1, 0, 1), (1, 1, 1)], "t int, r int, span int")
    assert rows(T.grid_width(table, ["t"])) == [(1, 3)]
    text = spark.createDataFrame([(1, 1, 2, "text", "x" * 10, 10.0, False, None), (1, 2, 1, "text", "x" * 10, 10.0, False, "left"), (1, 2, 3, "number", None, 10.0, False, None)], "s int, r int, c int, kind string, txt string, size double, wrap boolean, align string")
    widths = spark.range(1, 201).selectExpr("1 s", "cast(id as int) c", "20.0D width")
    assert rows(T.overflow_extent(text, widths, ["s"])) == [(1, 4)]
    assert jpeg_dimensions(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x05\x00\x07rest") == (7, 5) and jpeg_dimensions(b"\x89PNG") is None


def test_other_labels(spark):
    counts = F.array(*[F.lit(x).cast("long") for x in (2, 0, 3)])
    get = lambda c: spark.range(1).select(c).first()[0]
    assert get(numbering.odf_label(counts, 2, ("decimal", "decimal", "lowerLetter"), "(", ")", 2)) == "(1.c)"
    assert get(numbering.doc_label(counts, "\x00-\x02)", ("upperRoman", "decimal", "decimal"))) == "II-3)"
    data = [(1, 1, "a", None, False, "S"), (1, 2, None, "a", False, "T"), (1, 3, None, None, True, "T"), (1, 4, None, None, False, "S"), (1, 5, None, None, True, "U")]
    got = rows(numbering.list_keys(spark.createDataFrame(data, "doc_id int, ord int, list_id string, continue_list string, continue_numbering boolean, style string")).orderBy("ord"), "key")
    assert [k for (k,) in got] == ["list-1", "list-1", "list-1", "list-4", "list-5"]


def test_lists_without_overrides_are_counted_alike(spark):
    rng = random.Random(5)
    items = [(d, i, f"{rng.choice('ab')}{d}", rng.randrange(4)) for d in (1, 2) for i in range(60)]
    starts = {"x": [1, 5, 2], "y": [3, 1, 1]}
    state, want = {}, {}
    for d, i, num, level in items:
        abstract = "x" if num[0] == "a" or d == 2 else "y"
        first = starts[abstract]
        now = state.setdefault((d, abstract), [x - 1 for x in first])
        if level < 3:
            now[level] += 1
            now[level + 1 :] = [x - 1 for x in first[level + 1 :]]
        want[d, i] = list(now) if level < 3 else None
    inst = [(d, f"{n}{d}", "x" if n == "a" or d == 2 else "y", starts["x" if n == "a" or d == 2 else "y"], None) for d in (1, 2) for n in "ab"]
    got = numbering.counters_with_overrides(
        spark.createDataFrame(items, "doc_id int, ord int, num_id string, level int"),
        spark.createDataFrame(inst, "doc_id int, num_id string, abstract_id string, starts array<long>, overrides map<int,long>"),
    )
    assert {(r.doc_id, r.ord): r.counts for r in got.collect()} == want


def test_lcs_of_long_texts_by_blocks():
    rng = random.Random(6)
    for _ in range(40):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(50))] for _ in range(2))
        assert {fidelity._lcs(a, b, block) for block in (1, 2, 7, 16, 1 << 14)} == {fidelity._lcs(b, a, 3)}
    a = [str(k % 997) for k in range(30_000)]
    assert fidelity._lcs(a, a[::2] + ["x"] * 10) == 15_000


def test_large_sheets_pack_in_linear_time(spark):
    n = 200_000
    df = spark.range(n).selectExpr("1 sheet", "id r", "10.0D size")
    got = layout.pack_rows(df, ["sheet"], ["r"], "size", 500.0)
    assert got.where(F.col("page") != F.floor(F.col("r") / 50)).count() == 0 and got.count() == n


def test_points_take_the_first_end(spark):
    spans = spark.createDataFrame([(1, 1, 0.0, 10.0), (1, 2, 10.0, 0.0), (1, 3, 10.0, 5.0)], "k int, ord int, start double, size double")
    points = spark.createDataFrame([(1, x) for x in (0.0, 10.0, 10.005, 10.02, 15.0, 99.0)] + [(2, 1.0)], "k int, x double")
    got = {(r.k, r.x): r.cell for r in layout.point_to_cell(points, spans, ["k"], "x").collect()}
    assert got == {(1, 0.0): 1, (1, 10.0): 1, (1, 10.005): 1, (1, 10.02): 3, (1, 15.0): 3, (1, 99.0): None, (2, 1.0): None}


def test_defaults_keep_every_row(spark):
    df = spark.createDataFrame([(1, 0), (2, 7), (3, None)], "k int, i int")
    table = spark.createDataFrame([(0, "a"), (5, "b"), (0, "z")], "idx int, v string")
    assert sorted(rows(lookups.with_default(df, "i", table, [], "idx", ["v"]), "k", "v")) == [(1, "a"), (2, "a"), (3, "a")]
    assert sorted(rows(lookups.with_default(df, "i", table, [], "idx", ["v"], default=9), "k", "v"), key=str) == [(1, "a"), (2, None), (3, None)]
    assert sorted(rows(lookups.with_default(df, "i", table.limit(0), [], "idx", ["v"]), "k", "v"), key=str) == [(1, None), (2, None), (3, None)]


def test_row_heights_follow_the_largest_font(spark):
    from quire.operators import pages

    cells = spark.createDataFrame([(1, 0, 1, 0), (1, 0, 2, 1), (1, 0, 3, 1)], "doc_id int, sheet_idx int, r int, xf int")
    xfs = spark.createDataFrame([(1, 0, 11.0), (1, 1, 20.0)], "doc_id int, idx int, size double")
    heights = spark.createDataFrame([(1, 0, 1, None), (1, 0, 2, None), (1, 0, 3, 50.0), (1, 0, 4, None)], "doc_id int, sheet_idx int, r int, height double")
    got = {r.r: round(r.height, 3) for r in pages.auto_row_heights(cells, xfs, heights, 15.0).collect()}
    assert got == {1: 15.0, 2: 24.34, 3: 50.0, 4: 15.0}


def test_media_and_header_codes():
    from quire.sources import drawings, spreadsheets
    from quire.sources.parsed import Parsed
    from quire.sources.xmltree import parse

    assert sorted(["image10.png", "image9.png", "a.gif", "image2.png"], key=drawings.part_order) == ["a.gif", "image2.png", "image9.png", "image10.png"]
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452000000100000000A")
    import builders as B

    out = Parsed()
    rel = lambda t: B.rels(i=("image", t, ""))
    drawings.read_media(B.package({"ppt/slides/_rels/s.xml.rels": rel("../media/a.png"), "ppt/media/a.png": png, "ppt/media/unused.png": png, "Pictures/x.gif": b"GIF8", "Pictures/y.txt": b"no"}), out)
    assert [(m["part"], m["format"], m["width"], m["height"], m["data"]) for m in out.rows["media"]] == [("Pictures/x.gif", "gif", None, None, b"GIF8"), ("ppt/media/a.png", "png", 16, 10, png)]
    code = lambda inner: spreadsheets.odf_header_code(parse(f'<style:header {B.OFFICE}>{inner}</style:header>'.encode()))
    assert code("<text:p>a &amp; b</text:p><text:p><text:page-number>3</text:page-number></text:p>") == "&Ca && b\n&P"
    assert code("<style:region-left><text:p>x</text:p></style:region-left><style:region-right/>") == "&Lx&R" and code("<text:p> </text:p>") is None
