"""Profiles by sketches: exact parts, error bounds, merging, odd tables."""

import random

from graphloom.operators import sketches


def by_property(frame):
    return {r["property"]: r for r in frame.collect()}


def test_profile_is_exact_where_small(spark):
    rows = [(i, f"t{i % 7}", None if i % 5 == 0 else i / 4, [1.0] * (i % 3), i % 2 == 0) for i in range(1, 501)]
    df = spark.createDataFrame(rows, "id long, kind string, part double, list array<double>, flag boolean")
    got = by_property(sketches.profile(df))
    assert all(r["exact"] and r["n"] == 500 for r in got.values())
    assert (got["id"]["n_distinct"], got["id"]["least"], got["id"]["greatest"], got["id"]["type"]) == (500, "1", "500", "INTEGER")
    assert (got["part"]["n_null"], got["part"]["n_distinct"], got["part"]["least"]) == (100, 400, "0.25")
    assert got["kind"]["options"] == [f"t{i}" for i in range(7)] and got["kind"]["quantiles"] is None
    assert (got["list"]["shortest"], got["list"]["longest"], got["list"]["n_distinct"]) == (0, 2, 3)
    assert (got["flag"]["least"], got["flag"]["greatest"]) == ("false", "true")
    low, mid, high = got["id"]["quantiles"]
    assert abs(low - 125) < 15 and abs(mid - 250) < 15 and abs(high - 375) < 15


def test_error_bounds_of_large_groups(spark):
    n = 60_000
    df = spark.range(n).selectExpr("id % 20011 as a", "id * 1.5D as b", "concat('v', id) as c")
    got = by_property(sketches.profile(df))
    for name, true in (("a", 20011), ("b", n), ("c", n)):
        assert not got[name]["exact"] and abs(got[name]["n_distinct"] - true) <= 0.03 * true
    assert got["c"]["options"] is None
    for q, found in zip(sketches.QUANTILES, got["b"]["quantiles"], strict=True):
        assert abs(found / (n * 1.5) - q) < 0.03


def test_parts_merge_to_the_whole(spark):
    random.seed(5)
    rows = [(random.choice("xyz"), random.randrange(3000), random.choice(["red", "blue"]), None) for _ in range(9000)]
    df = spark.createDataFrame(rows, "day string, v int, colour string, none double")
    parts = sketches.sketch(df, ["day"])
    whole, merged = by_property(sketches.read(sketches.sketch(df.drop("day")))), by_property(sketches.read(sketches.merge(parts)))
    for name in ("v", "colour", "none"):
        for c in ("type", "n", "n_null", "least", "greatest", "options"):
            assert whole[name][c] == merged[name][c], (name, c)
        assert abs(whole[name]["n_distinct"] - merged[name]["n_distinct"]) <= 0.02 * whole[name]["n_distinct"]
    assert merged["colour"]["options"] == ["blue", "red"] and merged["none"]["quantiles"] is None


def test_types_widen_when_merged(spark):
    a, b, c = spark.sql("select 5 as x"), spark.sql("select 2.5D as x"), spark.sql("select 'q' as x")
    both = by_property(sketches.read(sketches.merge(sketches.sketch(a).unionByName(sketches.sketch(b)))))["x"]
    assert (both["type"], both["least"], both["greatest"]) == ("FLOAT", "2.5", "5.0")
    assert by_property(sketches.read(sketches.merge(sketches.sketch(a).unionByName(sketches.sketch(c)))))["x"]["type"] == "STRING"


def test_groups_null_groups_empty_tables(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, None)], "label string, v int")
    got = {r["label"]: r for r in sketches.profile(df, ["label"]).collect()}
    assert (got["a"]["n_distinct"], got[None]["n_distinct"], got[None]["n_null"]) == (2, 1, 1)
    assert sketches.profile(df.limit(0), ["label"]).count() == 0
    empty = by_property(sketches.profile(df.where("v > 99")))
    assert (empty["v"]["n"], empty["v"]["n_distinct"], empty["v"]["exact"], empty["v"]["least"]) == (0, 0, True, None)
    mixed = by_property(sketches.profile(df, ["label"], exact_below=3).where("label = 'a'"))
    assert mixed["v"]["exact"]


def test_one_scan_and_no_expanded_rows(spark, tmp_path):
    spark.range(10).selectExpr("id", "cast(id as string) s").write.parquet(f"{tmp_path}/t")
    plan = sketches.sketch(spark.read.parquet(f"{tmp_path}/t"))._jdf.queryExecution().toString()
    assert "Expand" not in plan and plan.split("== Physical Plan ==")[1].count("FileScan") == 1


def test_properties_of_generic_rows(spark):
    rows = [("P", {"age": "3", "name": "x", "size": "1.5", "none": None}), ("P", {"age": "40", "name": "y", "size": "2"}), ("Q", {"age": "old"}), ("Q", {}), ("Q", None)]
    got = {(r["label"], r["property"]): r for r in sketches.property_profile(spark.createDataFrame(rows, "label string, props map<string,string>"), "label").collect()}
    assert {k: r["type"] for k, r in got.items()} == {("P", "age"): "INTEGER", ("P", "name"): "STRING", ("P", "size"): "FLOAT", ("P", "none"): "STRING", ("Q", "age"): "STRING"}
    assert (got["P", "age"]["least"], got["P", "age"]["greatest"]) == ("3", "40") and got["P", "name"]["options"] == ["x", "y"]
    assert got["P", "none"]["n_null"] == 1 and got["P", "none"]["options"] == []


def test_long_texts_of_one_beginning_are_no_options(spark):
    df = spark.range(50).selectExpr("concat(repeat('x', 60), id) as long", "concat(repeat('y', 60), id % 3) as few")
    got = by_property(sketches.profile(df))
    assert got["long"]["options"] is None and got["long"]["n_distinct"] == 50
    assert got["few"]["options"] == ["y" * 50]
