import json

import pytest

from graphloom.errors import SchemaValidationError
from graphloom.operators.prune import GraphSchema, TypeRule
from graphloom.operators.schema_text import parse_answer, schema_from_text
from graphloom.operators.text import hash_embedder
from graphloom.plans import build
from graphloom.sources import documents


def numbered(path):
    for i in range(2):
        yield f"{path}/{i}", f"text {i}"


def test_documents_to_graph(spark):
    def model(text):
        names = [w for w in text.split() if w[0].isupper()]
        nodes = [{"id": str(i), "label": "Person", "properties": {"name": n, "mood": "x"}} for i, n in enumerate(names)]
        rels = [{"type": "KNOWS", "start_node_id": "0", "end_node_id": str(i)} for i in range(1, len(names))]
        return "Here: " + json.dumps({"nodes": nodes, "relationships": rels})

    docs = spark.createDataFrame([(1, "Ann met Bob"), (2, "Bob met Cid and Ann")], "doc_id long, text string")
    schema = GraphSchema((TypeRule("Person", ("name",)),), (TypeRule("KNOWS"),), (("Person", "KNOWS", "Person"),))
    g = build.build_graph(docs, model, schema, 100, 0, hash_embedder(4))
    assert sorted(r["name"] for r in g.nodes.collect()) == ["Ann", "Bob", "Cid"]
    assert g.edges.count() == 3
    assert all(r["props"] == {"name": r["name"]} for r in g.nodes.collect())
    assert g.lexical_edges.where("type = 'FROM_CHUNK'").count() == 3
    assert g.chunks.count() == 2 and len(g.chunks.first()["embedding"]) == 4


def test_chapters_and_context(spark):
    chunks = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", None)], "chunk_id string, chapter int")
    n, e = build.chapter_layer(chunks)
    assert sorted(r["number"] for r in n.collect()) == [1, 2] and e.count() == 3
    old = spark.createDataFrame([(1, "one"), (2, "two"), (3, None), (4, "four"), (5, "five")], "number int, summary string")
    new = build.set_summaries(old, spark.createDataFrame([(2, "TWO")], "number int, summary string"))
    assert build.context_of("story", new) == "story\n\n2: TWO\n4: four\n5: five"
    assert build.context_of(None, old.limit(0)) == ""
    calls = spark.createDataFrame([("extract", 5, 2), ("extract", 7, 1)], "step string, prompt_tokens int, answer_tokens int")
    assert tuple(build.token_report(calls).first()) == ("extract", 2, 12, 3)


def test_schema_from_text():
    answer = """```json
    [1, {"node_types": ["Place", {"label": "Person", "properties": [{"name": "name", "required": true}, "age"]}, {"label": "Bare", "properties": []}, {"x": 1}],
     "relationship_types": ["LIVES_IN", {"label": "LIVES_IN", "properties": ["since"]}, {"properties": []}],
     "patterns": [["Person", "LIVES_IN", "Place"], ["Person", "LIVES_IN", "Bare"], {"source": "Person", "relationship": "LIVES_IN", "target": "Place"}, "x"],
     "constraints": [{"node_type": "Person", "property_name": "age"}, {"node_type": "Person", "property_name": "gone"}],}]
    ```"""
    s = schema_from_text("some text", lambda p: answer)
    assert [n.name for n in s.nodes] == ["Place", "Person"] and s.nodes[0].open
    assert s.relationships == (TypeRule("LIVES_IN", ("since",)),)
    assert s.patterns == (("Person", "LIVES_IN", "Place"),)
    assert [c.properties for c in s.constraints] == [("age",)]
    assert s.mandatory(s.nodes[1], True) == ("name",)
    assert parse_answer("nothing") == {}
    with pytest.raises(SchemaValidationError):
        schema_from_text("x", lambda p: '{"node_types": ["__bad"]}')


def test_own_loader(spark):
    documents.register(spark)
    df = spark.read.format("documents").option("loader", "math:nothing").option("paths", "a;b").load()
    assert df.columns == ["path", "text", "document_type"]
    assert len(documents._Reader({"loader": "x:y", "paths": "a;b"}).partitions()) == 2
    rows = [r for p in documents._Reader({"loader": f"{__name__}:numbered", "paths": "a;b"}).partitions() for r in documents._Reader({"loader": f"{__name__}:numbered", "paths": "a;b"}).read(p)]
    assert rows[0] == ("a/0", "text 0", "custom") and len(rows) == 4
