"""What larger tables showed: results beyond a sheet's rows, groups that one task held, groups that cost a frame each."""

import random

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quire.operators import lookups, numbering


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_range_rules_reach_lines_beyond_a_sheets_rows(spark, tmp_path):
    lines = spark.range(3 * 1_048_576 + 90).selectExpr("id l_orderkey", "id l_partkey", "id l_suppkey", "1 l_linenumber", "cast(id % 50 as double) l_quantity", "1.0D l_extendedprice")
    lines.repartition(4).write.parquet(f"{tmp_path}/lineitem.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = [tuple(r) for r in entry.queries()["condfmt_range_rule"](spark, str(tmp_path)).select("doc_id", "dxf", "n", "total").collect()]
    assert sorted(got, key=str) == sorted(duck.execute(f"SELECT doc_id, dxf, n, total FROM ({entry.oracle_sql()['condfmt_range_rule']})").fetchall(), key=str)


def test_lists_with_overrides_take_no_frame_each(spark):
    r = random.Random(7)
    items = [(d, o, r.choice("ab"), r.choice([0, 0, 1, 2])) for d in range(6) for o in range(30)]
    instances = [(d, n, "x", [1, 3], {0: 10} if n == "b" else {}) for d in range(6) for n in "ab"]
    left = spark.createDataFrame(items, "doc_id long, ord long, num_id string, level int").repartition(3)
    out = numbering.counters_with_overrides(left, spark.createDataFrame(instances, "doc_id long, num_id string, abstract_id string, starts array<bigint>, overrides map<int, bigint>"))
    assert "FlatMapGroupsInPandas" not in plan(out)
    want = {}
    for d in range(6):
        now, used = [0, 2], set()
        for _, o, n, k in sorted(x for x in items if x[0] == d):
            if k > 1:
                want[d, o] = None
                continue
            if (n, k) not in used and n == "b" and k == 0:
                now[0] = 9
            used.add((n, k))
            now[k] += 1
            if k == 0:
                now[1] = 2
            want[d, o] = list(now)
    assert {(x.doc_id, x.ord): x.counts for x in out.collect()} == want


def test_points_of_one_document_are_cut_into_ranges(spark):
    r = random.Random(3)
    runs = [(0, 10 * k, 10 * k + r.randint(1, 10), f"v{k}") for k in range(60) if k % 7]
    points = [(0, n, r.randint(-5, 640)) for n in range(800)]
    found = lookups.nearest_run(spark.createDataFrame(points, "d int, n int, at int"), spark.createDataFrame(runs, "d int, s int, e int, v string"), ["d"], "at", "s", "e", "v", parts=9)
    want = {n: next((v for _, s, e, v in runs if s <= at < e), None) for _, n, at in points}
    assert {x.n: x.v for x in found.collect()} == want
    assert "_part" in plan(found)
    one = [(None, 1, 55)]
    same = lookups.nearest_run(spark.createDataFrame(one, "d int, n int, at int"), spark.createDataFrame([(None, 50, 60, "v")], "d int, s int, e int, v string"), ["d"], "at", "s", "e", "v")
    assert [tuple(x) for x in same.select("n", "v").collect()] == [(1, "v")]


def test_equations_of_one_file_are_several_tasks(spark, tmp_path):
    spark.range(40).select(F.col("id").alias("p_partkey"), F.col("id").cast("int").alias("p_size")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    out = entry.queries()["drawing_equations"](spark, str(tmp_path))
    assert out.rdd.getNumPartitions() > 1
    assert {x.p_partkey: (x.plain, x.chosen, x.modified) for x in out.collect()} == {k: (2.0 * k + 100, max(k - 25.0, 0.0), k / 2) for k in range(40)}


def test_tasks_of_line_items_grow_with_the_table(spark):
    from quire.plans import sheets

    assert sheets.by_order(spark.range(9), "id", 256 * sheets.TASK_BYTES).rdd.getNumPartitions() == 256
    assert sheets.by_order(spark.range(9), "id", sheets.TASK_BYTES).rdd.getNumPartitions() <= 4


def test_cells_of_pages_and_charts_stay_in_their_task(spark):
    sf = "/root/testdata/sf0.001"
    for name in ("page_cells", "chart_areas"):
        found = plan(entry.queries()[name](spark, sf)).split("Initial Plan")[-1]
        # Line items by order for each set of columns that is read, orders once; before, each join moved the cells.
        assert not [x for x in found.splitlines() if "Exchange hashpartitioning" in x and any(f" {k}" in x or f"({k}" in x for k in ("bc#", "br#", "r#", "xf#", "page#"))]
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
