"""Graph export in two writes: types, unions of keys, keys, odd names and values."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators.prune import Constraint
from graphloom.sources import export

JSON = [
    ("1", "A", '{"age": 1, "name": "x", "v": [1, 2], "none": null, "mixed": 1, "flag": true}'),
    ("2", "A", '{"age": 2.5, "v": [], "mixed": "t", "deep": {"k": [1]}}'),
    ("3", "B", '{"age": "old", "b": true, "b2": 9007199254740993}'),
    ("4", "B", '{"b": 1}'),
    ("5", None, None),
]


def make(spark, rows=JSON):
    return spark.createDataFrame(rows, "id string, label string, j string").selectExpr("id", "label", "parse_json(j) as props")


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, type string, dst string, w string").selectExpr("src", "type", "dst", "parse_json(w) as props")


def test_types_follow_the_values(spark, tmp_path):
    out = export.export_graph(make(spark), edges(spark, [("1", "R", "3", '{"w": 1}'), ("2", "R", "4", '{"w": 2.5}'), ("1", "S", "2", None), (None, "R", "2", None)]), str(tmp_path))
    kinds = {(r["label"], r["type"], r["property"]): (r["kind"], r["dimensions"]) for r in export.read_schema(spark, str(tmp_path)).collect()}
    want = {"age": "FLOAT", "name": "STRING", "none": "STRING", "mixed": "STRING", "deep": "STRING", "flag": "BOOLEAN"}
    assert all(kinds["A", None, k] == (v, None) for k, v in want.items()) and kinds["A", None, "v"] == ("FLOAT_ARRAY", 2)
    assert kinds["B", None, "age"][0] == "STRING" and kinds["B", None, "b"][0] == "STRING" and kinds["B", None, "b2"][0] == "INTEGER"
    assert kinds["A", "R", "w"][0] == "FLOAT" and kinds["A", "S", None] == (None, None) and out.skipped == 0
    a = {r["__id__"]: r for r in export.read_export(spark, str(tmp_path), "A").collect()}
    assert (a["1"]["age"], a["2"]["age"], a["1"]["mixed"], a["2"]["mixed"], a["2"]["deep"]) == (1.0, 2.5, "1", "t", '{"k":[1]}')
    assert (a["1"]["v"], a["2"]["v"], a["1"]["none"], a["2"]["name"], a["1"]["labels"]) == ([1.0, 2.0], [], None, None, ["A", "__Entity__"])
    b = export.read_export(spark, str(tmp_path), "B")
    assert set(b.columns) == {"__id__", "label", "labels", "age", "b", "b2"}
    assert {r["__id__"]: (r["age"], r["b"], r["b2"]) for r in b.collect()} == {"3": ("old", "true", 9007199254740993), "4": (None, "1", None)}
    assert [r["__id__"] for r in export.read_export(spark, str(tmp_path), "").collect()] == ["5"]
    assert sorted(r["w"] for r in export.read_export(spark, str(tmp_path), ("A", "R", "B")).collect()) == [1.0, 2.5]
    with pytest.raises(ValueError):
        export.read_export(spark, str(tmp_path), "Z")


def test_key_properties_name_the_ends(spark, tmp_path):
    nodes = spark.createDataFrame([("1", "A", "x"), ("2", "A", None), ("3", "B", "y")], "id string, label string, name string")
    rules = [Constraint("key", ("name", "other"), node="A"), Constraint("key", ("name",), node="A"), Constraint("existence", ("name",), node="B"), Constraint("uniqueness", ("name",), node="B")]
    rows = spark.createDataFrame([("1", "R", "3"), ("2", "R", "3")], "src string, type string, dst string")
    out = export.export_graph(nodes, rows, str(tmp_path), constraints=rules, lexical=("B",))
    assert out.skipped == 1
    assert [(r["from"], r["to"]) for r in export.read_export(spark, str(tmp_path), ("A", "R", "B")).collect()] == [("x", "3")]
    marks = {(r["label"], r["property"]): (r["is_join_key"], r["is_key"], r["is_unique"], r["is_required"]) for r in export.read_schema(spark, str(tmp_path)).where("what = 'node'").collect()}
    assert marks["A", "name"] == (True, True, False, True) and marks["B", "name"] == (False, False, True, True) and marks["B", "__id__"][0]
    assert [r["labels"] for r in export.read_export(spark, str(tmp_path), "B").collect()] == [["B"]]


def test_maps_columns_and_clashing_names(spark, tmp_path):
    nodes = spark.createDataFrame([("1", "A", {"k k": "1", "to_label": "z"}, [1]), ("2", "A b", {}, None)], "id string, label string, props map<string,string>, list array<int>").withColumn("a.b", F.lit(1)).withColumn("labels", F.lit("old"))
    rows = spark.createDataFrame([("1", "R", "2", 5, "q")], "src string, type string, dst string, n int, from_label string")
    export.export_graph(nodes, rows, str(tmp_path))
    a = export.read_export(spark, str(tmp_path), "A").first().asDict()
    assert (a["k k"], a["to_label"], a["list"], a["a.b"], a["labels"]) == ("1", "z", [1.0], 1, ["A", "__Entity__"])
    e = export.read_export(spark, str(tmp_path), ("A", "R", "A b")).first().asDict()
    assert (e["n"], e["from_label"]) == (5, "A")


def test_empty_graphs_and_unknown_ends(spark, tmp_path):
    none = make(spark, [])
    out = export.export_graph(none, edges(spark, []), f"{tmp_path}/none")
    assert out.folders == {} and export.read_schema(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(ValueError):
        export.export_graph(make(spark), edges(spark, [("1", "R", "99", None)]), f"{tmp_path}/bad")


def test_a_write_scans_the_nodes_once(spark, tmp_path):
    make(spark).write.parquet(f"{tmp_path}/n")
    nodes = spark.read.parquet(f"{tmp_path}/n")
    spark.sparkContext.setJobGroup("export", "export")
    seen = []
    write = export._write
    export._write = lambda spark, rows, *rest: (seen.append(rows._jdf.queryExecution().toString()), write(spark, rows, *rest))[1]
    try:
        export.export_graph(nodes, edges(spark, [("1", "R", "3", None)]), f"{tmp_path}/out")
    finally:
        export._write = write
    assert [p.split("== Physical Plan ==")[1].count("FileScan") for p in seen] == [1, 1]
