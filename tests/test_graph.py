import pytest

from graphloom.errors import IndexExistsError, SchemaValidationError, SearchValidationError
from graphloom.graph import PropertyGraph
from graphloom.operators import expand, introspect, prune, resolve, state, text
from graphloom.operators.history import InMemoryHistory, append_message, clear, last_messages
from graphloom.operators.prune import Constraint, GraphSchema, TypeRule
from graphloom.sources import readers, writers


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, type string, dst string")


def nodes(spark, rows):
    return spark.createDataFrame(rows, "id string, label string, name string")


def got(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_closure_survives_cycles(spark):
    e = edges(spark, [("a", "IN", "b"), ("b", "IN", "c"), ("c", "IN", "a"), ("x", "IN", "a")])
    assert got(expand.closure(e, spark.createDataFrame([("x",)], "id string")), "id", "reached", "hops") == [("x", "a", 1), ("x", "b", 2), ("x", "c", 3)]
    assert ("a", "a", 3) in got(expand.closure(e), "id", "reached", "hops")
    with pytest.raises(RuntimeError):
        expand.closure(e, max_rounds=1)


def test_retrieve_keeps_chunks_without_facts(spark):
    g = PropertyGraph(
        nodes(spark, [("e", "Event", "duel"), ("p", "Character", "Ann"), ("q", "Character", "Bob"), ("l", "Location", "inn"), ("t", "Location", "town")]),
        edges(spark, [("p", "JOINED", "e"), ("p", "RELATED_TO", "q"), ("p", "LOCATED_IN", "l"), ("l", "LOCATED_IN", "t")]),
    )
    anchors = spark.createDataFrame([("c1", 1), ("c2", 2)], "chunk string, chapter int")
    evidence = spark.createDataFrame([("c1", "e")], "chunk string, fact string")
    rows = {r["chunk"]: r for r in expand.retrieve(g, anchors, evidence, ("RELATED_TO",), ("LOCATED_IN",)).collect()}
    assert rows["c2"]["facts"] == [] and rows["c2"]["subgraph"] == [] and rows["c2"]["edges"] == []
    assert [n["id"] for n in rows["c1"]["subgraph"]] == ["e", "l", "p", "q", "t"]
    assert len(rows["c1"]["edges"]) == 4


def test_states(spark):
    s = spark.createDataFrame([("a", 1, "poor"), ("a", 3, "rich"), ("a", None, "unknown"), ("b", 2, "ill")], "who string, chapter int, state string")
    assert [r["state"] for r in state.history(s, s.who == "a", "chapter", "state").collect()] == ["poor", "rich", "unknown"]
    assert [r["state"] for r in state.history(s, s.who == "a", "chapter", "state", up_to=2).collect()] == ["poor"]
    assert got(state.as_of(s, ["who"], "chapter", "state", up_to=2), "who", "state") == [("a", "poor"), ("b", "ill")]
    assert got(state.as_of(s, ["who"], "chapter", "state"), "who", "state") == [("a", "rich"), ("b", "ill")]
    assert [r["chapter"] for r in state.recent(s.where("chapter is not null").select("chapter"), "chapter", 2).collect()] == [2, 3]
    aliased = spark.createDataFrame([("x, y,,z ",), (None,)], "a string").select(state.alias_list("a").alias("l"))
    assert [r["l"] for r in aliased.collect()] == [["x", "y", "z"], []]


def test_state_lines(spark):
    rows = [
        (7, "king", "of all", ["b", None, "", "a"], [("Ann", "SISTER"), ("Bo", None), (None, "FOE"), ("Cy", "")]),
        (None, "lost", "", [], []),
        (1, "odd", None, [None, ""], [(None, None)]),
        (2, "bare", "x", None, None),
    ]
    frame = spark.createDataFrame(rows, "ch int, name string, text string, targets array<string>, others array<struct<name:string,type:string>>")
    columns = [frame[c] for c in frame.columns]
    got = [r[0] for r in frame.select(state.format_state(*columns).alias("line")).collect()]
    assert got == ["7: king (of all) [about: a, b] [with: Ann (SISTER), Bo, Cy]", "?: lost", "1: odd", "2: bare (x)"]
    assert [r[0] for r in frame.select(state.format_state(*columns[:4]).alias("line")).collect()][0] == "7: king (of all) [about: a, b]"


def test_whole_split(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in text.split_whole(docs).orderBy("doc_id").collect()] == [(1, 0, "a b"), (2, 0, "")]


def test_word_safe_split_of_a_table(spark):
    """Without overlap the chunks are the text, and a cut inside a word means that the chunk is part of one word."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, "x" * 95), (-2, None), (-3, "")], "doc_id long, text string"))
    chunks = {}
    for r in text.split_fixed(docs, 40, 0, approximate=True).orderBy("doc_id", "index").collect():
        assert r["index"] == len(chunks.setdefault(r["doc_id"], []))
        chunks[r["doc_id"]].append(r["chunk"])
    whole = {r["doc_id"]: r["text"] for r in docs.collect() if r["text"]}
    assert {k: "".join(v) for k, v in chunks.items()} == whole
    for parts in chunks.values():
        assert all(0 < len(c) <= 40 for c in parts)
        for c, after in zip(parts[:-1], parts[1:], strict=True):
            assert c[-1].isspace() or after[0].isspace() or not any(x.isspace() for x in c)


@pytest.mark.parametrize(
    ("body", "size", "overlap", "want"),
    [
        ("may thy knife chip and shatter", 5, 0, ["may t", "hy kn", "ife c", "hip a", "nd sh", "atter"]),
        ("may thy knife chip and shatter", 10, 2, ["may thy kn", "knife chip", "ip and sha", "hatter"]),
        ("Hello World, this is a test message.", 10, 2, ["Hello Worl", "rld, this ", "s is a tes", "est messag", "age."]),
        ("", 5, 1, []),
    ],
)
def test_fixed_split(spark, body, size, overlap, want):
    docs = spark.createDataFrame([(1, body)], "doc_id long, text string")
    assert [r["chunk"] for r in text.split_fixed(docs, size, overlap).orderBy("index").collect()] == want


@pytest.mark.parametrize(
    ("body", "size", "overlap", "want"),
    [
        ("Hello World, this is a test message.", 10, 2, ["Hello ", "World, ", "this is a ", "a test ", "message."]),
        ("1234567890", 5, 1, ["12345", "56789", "90"]),
        ("a" * 20, 5, 1, ["aaaaa"] * 4 + ["aaaa"]),
    ],
)
def test_word_safe_split(body, size, overlap, want):
    assert text.word_safe_chunks(body, size, overlap) == want
    for bad in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            text.word_safe_chunks(body, *bad)


def test_sentence_groups():
    assert text.group_sentences(["aaaa", "bbbb", "cc"], 8) == ["aaaa bbbb", "cc"]
    assert text.group_sentences(["aaaa", "bbbb", "cc"], 8, overlap=4) == ["aaaa bbbb", "bbbb cc"]
    assert text.group_sentences(["x" * 30], 8) == ["x" * 30]
    assert text.group_sentences([], 8) == []
    assert text.group_sentences([" aaaa ", "  ", "bbbb", "", "c" * 12, "dd", "ee"], 8, overlap=4) == ["aaaa bbbb", "bbbb " + "c" * 12, "dd ee"]


def test_lexical_graph_and_evidence(spark):
    chunks = text.chunk_ids(spark.createDataFrame([(1, 0, "one"), (1, 1, "two")], "doc_id long, index int, chunk string"))
    n, e = text.lexical_graph(chunks)
    assert (n.count(), e.count()) == (3, 3)
    n, e = text.lexical_graph(chunks, with_document=False)
    assert (n.count(), e.count()) == (2, 1)
    facts = spark.createDataFrame([("f", 1, "C0, C1 ,C7,C0;C1,x")], "id string, chapter long, evidence_chunk string")
    linked, rejects = text.evidence_links(facts, chunks.withColumnRenamed("doc_id", "chapter"))
    assert got(linked, "src", "dst") == [("f", "1:0"), ("f", "1:1")]
    assert got(rejects, "token") == [("C0;C1",), ("C7",), ("x",)]
    body = text.marker_text(chunks, "doc_id").first()["body"]
    assert body == "[chapter:1]\n[C0] one [C1] two"
    embedded = text.embed(chunks, text.hash_embedder(8)).first()["embedding"]
    assert len(embedded) == 8


def props(spark, rows):
    return spark.createDataFrame(rows, "id string, label string, props map<string,string>")


def test_pruning(spark):
    n = props(spark, [("1", "Person", {"name": "John"}), ("2", "Person", {"height": "180"}), ("3", "Person", {"name": "Jane", "weight": "90"}), ("10", "Organization", {"name": "o"}), ("4", "", {"name": "x"}), ("", "Person", {"name": "y"}), ("c", "Chunk", {"text": "t"})])
    schema = GraphSchema(nodes=(TypeRule("Person", ("name",)), TypeRule("Organization", ("name",))), relationships=(TypeRule("KNOWS"), TypeRule("WORKS_FOR")), patterns=(("Person", "KNOWS", "Person"), ("Person", "WORKS_FOR", "Organization")), additional_patterns=False, additional_relationships=False)
    e = spark.createDataFrame([("1", "KNOWS", "3", {"x": "1"}), ("1", "KNOWS", "2", {}), ("10", "WORKS_FOR", "1", {}), ("1", "MANAGES", "10", {}), ("1", "KNOWS", "10", {})], "src string, type string, dst string, props map<string,string>")
    kept, wired, stats = prune.prune_graph(n, e, schema, lexical=("Chunk",))
    assert got(kept, "id") == [("1",), ("10",), ("3",), ("c",)]
    assert {r["id"]: r["props"] for r in kept.collect()}["3"] == {"name": "Jane"}
    assert got(wired, "src", "type", "dst", "turned") == [("1", "KNOWS", "3", False), ("1", "WORKS_FOR", "10", True)]
    assert got(stats, "what", "reason", "n") == [("node", "MISSING_LABEL", 1), ("node", "MISSING_REQUIRED_PROPERTY", 1), ("node", "NO_PROPERTY_LEFT", 1), ("relationship", "INVALID_PATTERN", 1), ("relationship", "INVALID_START_OR_END_NODE", 1), ("relationship", "NOT_IN_SCHEMA", 1)]
    free, _ = prune.prune_nodes(n.where("id = '2'"), GraphSchema())
    assert free.count() == 1


@pytest.mark.parametrize(
    "make",
    [
        lambda: GraphSchema(nodes=(TypeRule("__x"),)),
        lambda: GraphSchema(relationships=(TypeRule("R"), TypeRule("R"))),
        lambda: GraphSchema(nodes=(TypeRule("A"),), patterns=(("A", "R", "A"),)),
        lambda: GraphSchema(nodes=(TypeRule("A"),), relationships=(TypeRule("R"),), patterns=(("A", "R", "B"),)),
        lambda: GraphSchema(relationships=(TypeRule("R"),), additional_relationships=True, additional_patterns=False),
        lambda: GraphSchema(nodes=(TypeRule("A", ("p",)),), constraints=(Constraint("key", ("q",), node="A"),)),
        lambda: GraphSchema(nodes=(TypeRule("A", ("p", "q")),), constraints=(Constraint("existence", ("p", "q"), node="A"),)),
        lambda: GraphSchema(nodes=(TypeRule("A", ("p",)),), constraints=(Constraint("key", ("p",), node="A"), Constraint("existence", ("p",), node="A"))),
        lambda: GraphSchema(nodes=(TypeRule("A", ("p",)),), constraints=(Constraint("key", ("p",), node="A"), Constraint("uniqueness", ("p",), node="A"))),
    ],
)
def test_schema_rules(make):
    with pytest.raises(SchemaValidationError):
        make()


def test_exact_resolution(spark):
    n = nodes(spark, [("1", "Person", "Alice"), ("2", "Person", "Alice"), ("3", "Country", "Sweden"), ("4", "Human", "Alice"), ("5", "Person", None)])
    groups = resolve.exact_groups(n)
    assert resolve.stats(groups).first().asDict() == {"nodes_to_resolve": 4, "created_nodes": 3}
    e = edges(spark, [("1", "LIVES_IN", "3"), ("2", "LIVES_IN", "3"), ("1", "KNOWS", "2"), ("4", "SEES", "4")])
    merged, moved = resolve.apply_groups(n, e, groups)
    assert got(merged, "id") == [("1",), ("3",), ("4",), ("5",)]
    assert got(moved, "src", "type", "dst") == [("1", "LIVES_IN", "3"), ("4", "SEES", "4")]


def test_similarity_resolution(spark):
    n = nodes(spark, [("1", "P", "John Smith"), ("2", "P", "Jon Smith"), ("3", "P", "  JOHN  smith! "), ("4", "P", "Bob"), ("5", "Q", "John Smith")])
    pairs = resolve.fuzzy_pairs(n, threshold=0.85)
    assert got(resolve.components(pairs), "id", "canonical") == [("1", "1"), ("2", "1"), ("3", "1")]
    norm = resolve.normalised_groups(nodes(spark, [("1", "I", "(old) sword"), ("2", "I", "old sword"), ("3", "I", "()")]))
    assert got(norm, "id", "canonical") == [("1", "1"), ("2", "1")]
    v = spark.createDataFrame([("1", "P", [1.0, 0.0]), ("2", "P", [0.9, 0.1]), ("3", "P", [0.0, 0.0])], "id string, label string, embedding array<double>")
    assert got(resolve.vector_pairs(v), "a", "b") == [("1", "2")]
    routed = resolve.route(n, {("P",): resolve.normalised_groups})
    assert got(routed, "id") == [("1",), ("2",), ("3",), ("4",)]


def test_components_of_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    out = dict(got(resolve.components(chain), "id", "canonical"))
    assert all(out[i] == 0 for i in range(41)) and out[101] == 100


def test_edge_merge_and_upsert(spark):
    n = nodes(spark, [("a", "X", "a"), ("b", "X", "b")])
    e = spark.createDataFrame([("a", "R", "b", 1, "old"), ("a", "R", "b", 2, "new"), ("a", "R", "gone", 3, "x")], "src string, type string, dst string, seq int, note string")
    assert got(writers.merge_edges(e, n), "src", "dst", "note") == [("a", "b", "new")]
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert got(writers.upsert(old, new, ["k"]), "k", "v") == [(1, "a"), (2, "c"), (3, "d")]
    assert {r["id"]: r["labels"] for r in writers.with_labels(n.union(nodes(spark, [("c", "Chunk", "c")])), ("Chunk",)).collect()} == {"a": ["X", "__Entity__"], "b": ["X", "__Entity__"], "c": ["Chunk"]}
    bad = spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "id string, embedding array<float>")
    with pytest.raises(SearchValidationError):
        writers.upsert_vectors(n, bad)


def test_export(spark, tmp_path):
    n = spark.createDataFrame([("1", "My Label", [1, 2]), ("2", "My_Label", None), ("3", "가", [3])], "id string, label string, scores array<int>")
    e = edges(spark, [("1", "R", "2"), (None, "R", "2")])
    folders = writers.export_graph(n, e, str(tmp_path))
    assert len(set(folders.values())) == 4
    back = spark.read.parquet(folders["My Label"])
    assert dict(back.dtypes)["scores"] == "array<float>" and "__id__" in back.columns
    assert spark.read.parquet(folders["My Label", "R", "My_Label"]).count() == 1
    n2 = spark.createDataFrame([("1", "A"), ("2", "C"), ("3", "A_R_C")], "id string, label string")
    folders = writers.export_graph(n2, edges(spark, [("1", "R", "2")]), f"{tmp_path}/clash")
    assert len(folders) == len(set(folders.values())) == 4
    assert "__id__" in spark.read.parquet(folders["A_R_C"]).columns and "from" in spark.read.parquet(folders["A", "R", "C"]).columns
    with pytest.raises(ValueError):
        writers.export_graph(n, edges(spark, [("1", "R", "9")]), str(tmp_path))
    a, b = writers.coerce_numbers([spark.sql("select 1 as x"), spark.sql("select 1.5D as x")], "x")
    assert a.dtypes == b.dtypes == [("x", "double")]
    a, b = writers.coerce_numbers([spark.sql("select true as x"), spark.sql("select 1 as x")], "x")
    assert a.dtypes == b.dtypes == [("x", "string")]


def test_index_catalog(spark):
    c = writers.IndexCatalog()
    c.create_vector_index("v", "Chunk", "embedding", 8, filterable=("year",))
    c.create_fulltext_index("t", "Chunk", ("text",))
    c.create_vector_index("v", "Chunk", "embedding", 8)
    with pytest.raises(IndexExistsError):
        c.create_vector_index("v", "Chunk", "embedding", 8, fail_if_exists=True)
    with pytest.raises(SearchValidationError):
        c.create_vector_index("w", "Chunk", "embedding", 0)
    assert [r["name"] for r in c.show(spark).collect()] == ["t", "v"]
    assert c.find("VECTOR", "other", "Chunk", "embedding") == "v"
    c.drop_index_if_exists("v")
    c.drop_index_if_exists("v")
    assert c.show(spark, "VECTOR").count() == 0


def test_introspection(spark):
    n = props(spark, [("1", "LabelA", {"property_a": "a"}), ("2", "LabelB", {}), ("3", "LabelC", {})])
    e = spark.createDataFrame([("1", "REL", "2", "LabelA", "LabelB"), ("1", "REL", "3", "LabelA", "LabelC")], "src string, type string, dst string, src_label string, dst_label string")
    s = introspect.inferred_schema(n, e)
    assert s.patterns == (("LabelA", "REL", "LabelB"), ("LabelA", "REL", "LabelC"))
    shown = introspect.format_schema({"LabelA": {"property_a": "STRING"}}, {"REL": {"p": "STRING"}}, list(s.patterns))
    assert shown.splitlines() == ["Node properties:", "LabelA {property_a: STRING}", "Relationship properties:", "REL {p: STRING}", "The relationships:", "(:LabelA)-[:REL]->(:LabelB)", "(:LabelA)-[:REL]->(:LabelC)"]
    df = spark.createDataFrame([(["x"] * 200, ["y"])], "long array<string>, short array<string>")
    assert introspect.without_long_lists(df).first().asDict() == {"long": None, "short": ["y"]}
    assert introspect.enhanced_options(spark.createDataFrame([("b",), ("a",), (None,)], "v string"), "v") == ["a", "b"]


def test_history(spark):
    m = spark.createDataFrame([("s", i, "user", f"m{i}") for i in range(5)] + [("t", 0, "user", "other")], "session_id string, seq int, role string, content string")
    assert [r["content"] for r in last_messages(m.where("session_id = 's'"), 5).collect()] == [f"m{i}" for i in range(5)]
    assert [r["content"] for r in last_messages(m, 1).collect()] == ["m4", "other"]
    assert last_messages(append_message(m, "s", "assistant", "new"), 1).first()["seq"] == 5
    assert append_message(m, "fresh", "user", "x").where("session_id = 'fresh'").first()["seq"] == 0
    assert clear(m, "s").count() == 1
    h = InMemoryHistory(window=1)
    h.add("user", "a")
    h.add("user", "b")
    assert [x["content"] for x in h.messages] == ["b"]
    h.clear()
    assert h.messages == []
    with pytest.raises(ValueError):
        last_messages(m, 0)


def test_readers(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Title\n\ntext", encoding="utf-8")
    assert readers.read_markdown(spark, str(tmp_path / "a.md")).first()["text"] == "# Title\n\ntext"
    for name in ("c.json", "c.yaml"):
        readers.write_config({"a": [1, "ü"]}, str(tmp_path / name))
        assert readers.read_config(str(tmp_path / name)) == {"a": [1, "ü"]}
        with pytest.raises(FileExistsError):
            readers.write_config({}, str(tmp_path / name))
    rows = spark.createDataFrame([("0", None, None), ("1", "x", 1)], "id string, text string, index int")
    assert [tuple(r) for r in readers.read_chunks(rows).collect()] == [("", -1, "0"), ("x", 1, "1")]
