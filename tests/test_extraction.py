"""Answers mended, retried, kept and asked for again."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.operators import extraction


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('```json\n{"a": 1}\n```', {"a": 1}),
        ("{'a': 'it's', 'b': \"x\"}", {"a": "it's", "b": "x"}),
        ('{"a": 1}}} tail', {"a": 1}),
        ('{"a": [1, 2}, "b": 3}', {"a": [1, 2], "b": 3}),
        ('{"a": [{"x": 1}}, {"x": 2}}], "b": 3}', {"a": [{"x": 1}, {"x": 2}], "b": 3}),
        ('{"a": [{"x": [1}', {"a": [{"x": [1]}]}),
        ('{"a": ]1, "b": 2}', {"a": 1, "b": 2}),
        ('{"a": "cut off', {"a": "cut off"}),
        ('{"a": {"b": [1, {"c": "d', {"a": {"b": [1, {"c": "d"}]}}),
        ('{"a": 1,, "b": 2,}', {"a": 1, "b": 2}),
        ('{"a": "he said "no" twice", "b": 1}', {"a": 'he said "no" twice', "b": 1}),
        ("{a: b c, d: True, e: None, f: -1.5e3, g: 007}", {"a": "b c", "d": True, "e": None, "f": -1500.0, "g": "007"}),
        ('[{"a": 1} {"a": 2}', [{"a": 1}, {"a": 2}]),
        ('{"a": "\\u00e9\\n\\q", b', {"a": "é\nq", "b": None}),
        ('{"a":, "b": 1}', {"a": None, "b": 1}),
        ("", {}), (None, {}), ("no", {}), ("}{", {}), ('{"k', {"k": None}),
    ],
)
def test_repair(text, want):
    assert json.loads(extraction.repair_json(text)) == want


_JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(), c, max_size=4), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text(), _JSON, max_size=4), st.text(max_size=8).filter(lambda t: "{" not in t and "[" not in t))
def test_valid_answers_stay(value, before):
    assert json.loads(extraction.repair_json(before + json.dumps(value))) == value


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="{}[]\",:'\\ab1 \n", max_size=40))
def test_anything_becomes_json(text):
    json.loads(extraction.repair_json(text))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.dictionaries(st.sampled_from("abc"), st.integers(0, 9), min_size=1), min_size=1, max_size=4), st.integers(0, 60))
def test_what_was_whole_before_a_cut_is_kept(rows, at):
    text = json.dumps(rows)
    whole = [r for i, r in enumerate(rows) if len(json.dumps(rows[: i + 1])) - 1 <= at]
    got = json.loads(extraction.repair_json(text[:at]))
    assert (got or [])[: len(whole)] == whole if whole else True


def test_depth_is_bounded():
    with pytest.raises(extraction.UnreadableAnswerError):
        extraction.repair_json("[" * 5000 + "x")


def test_asking_again():
    waits, calls = [], []

    def flaky(text):
        calls.append(text)
        if len(calls) < 3:
            raise OSError("busy")
        return '{"nodes": []'

    assert extraction.ask(flaky, "t", sleep=waits.append) == ('{"nodes": []}', None, 3)
    assert len(waits) == 2 and 0.5 <= waits[0] <= 1 and 1 <= waits[1] <= 2
    answer, error, n = extraction.ask(lambda t: "sorry", "t", attempts=2, sleep=waits.append)
    assert answer is None and "UnreadableAnswerError" in error and n == 2
    assert extraction.ask(lambda t: None, "t", attempts=1)[0] is None


def test_a_second_run_asks_only_for_what_failed(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()

    def model(down):
        def say(text):
            (log / f"{down}-{text or 'empty'}").write_text("x")
            if down and text.startswith("b"):
                raise OSError("down")
            return json.dumps({"nodes": [{"id": "0", "label": "P", "properties": {"name": text, "n": 3, "deep": {"k": [1]}}}, {"label": "no id"}], "relationships": [{"type": "R", "start_node_id": "0"}]})

        return say

    path = f"{tmp_path}/answers"
    chunks = spark.createDataFrame([("1", "a"), ("2", "b1"), ("3", "b2"), ("3", "b2"), ("4", None), (None, "c")], "chunk_id string, chunk string")
    first = extraction.run(chunks, model(True), path, waves=2, attempts=1)
    assert sorted(r["chunk_id"] for r in first.where("answer is null").collect()) == ["2", "3"] and first.count() == 5
    assert {r["error"] for r in extraction.failed(spark, path).collect()} == {"OSError: down"}
    changed = chunks.where("chunk_id <> '1' or chunk_id is null").unionByName(spark.createDataFrame([("1", "a2")], chunks.schema))
    second = extraction.run(changed, model(False), path, attempts=1)
    assert second.where("answer is null").count() == 0 and second.count() == 5
    assert sorted(p.name for p in log.iterdir() if p.name.startswith("False")) == ["False-a2", "False-b1", "False-b2"]
    assert {r["chunk_id"]: r["runs"] for r in second.collect()} == {"1": 1, "2": 2, "3": 2, "4": 1, None: 1}
    nodes, edges = extraction.graph_of(second)
    got = {r["id"]: r["props"] for r in nodes.collect()}
    assert got["2:0"] == {"name": "b1", "n": "3", "deep": '{"k":[1]}'} and len(got) == 5 and edges.count() == 0
    again = extraction.run(changed, model(True), path, attempts=1)
    assert again.where("answer is null").count() == 0  # nothing is asked, an answer is not lost to a later failure
    assert extraction.run(chunks.limit(0), model(True), f"{tmp_path}/none").count() == 0


def test_raise_ends_the_job(spark):
    from graphloom.operators.answers import extract_graph

    chunks = spark.createDataFrame([("c1", "t")], "chunk_id string, chunk string")
    nodes, _ = extract_graph(chunks, lambda t: '{"nodes": [{"id": "0"}]}', "RAISE")
    assert nodes.count() == 1
