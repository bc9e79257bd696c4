import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.errors import FilterValidationError, QueryParseError, SearchValidationError
from graphloom.functions.similarity import safe_stem, unique_names, weighted_ratio
from graphloom.operators import fulltext, hybrid, vector
from graphloom.operators.filters import compile_filter, filter_fields, index_compatible
from graphloom.operators.vector_index import VectorIndex

DOCS = [
    ("doc1", "science", 2020, [1.0, 0.0, 0.0, 0.0, 0.0]),
    ("doc2", "science", 2023, [0.9, 0.1, 0.0, 0.0, 0.0]),
    ("doc3", "history", 2020, [0.8, 0.2, 0.0, 0.0, 0.0]),
    ("doc4", "history", 2023, [0.7, 0.3, 0.0, 0.0, 0.0]),
    ("doc5", "science", 2021, [0.6, 0.4, 0.0, 0.0, 0.0]),
    ("doc6", None, None, None),
]
Q = [1.0, 0.0, 0.0, 0.0, 0.0]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id string, category string, year int, embedding array<double>").cache()


def ids(df):
    return [r["id"] for r in df.collect()]


@pytest.mark.parametrize(
    ("spec", "want"),
    [
        (None, ["doc1", "doc2", "doc3", "doc4", "doc5"]),
        ({"category": "science"}, ["doc1", "doc2", "doc5"]),
        ({"year": {"$gt": 2020}}, ["doc2", "doc4", "doc5"]),
        ({"category": "science", "year": {"$gte": 2021}}, ["doc2", "doc5"]),
        ({"$or": [{"category": "history"}, {"year": 2021}]}, ["doc3", "doc4", "doc5"]),
        ({"category": {"$nin": ["science"]}}, ["doc3", "doc4"]),
        ({"category": {"$ne": "science"}}, ["doc3", "doc4"]),
        ({"category": {"$like": "sci%"}}, ["doc1", "doc2", "doc5"]),
        ({"category": {"$like": "%sci"}}, []),
        ({"category": {"$ilike": "HIST"}}, ["doc3", "doc4"]),
        ({"year": {"$between": [2021, 2023]}}, ["doc2", "doc4", "doc5"]),
        ({"year": {"$in": [1999]}}, []),
    ],
)
def test_filtered_search(docs, spec, want):
    assert ids(vector.knn(docs, Q, filters=spec)) == want


@pytest.mark.parametrize(
    "spec",
    [{}, {"$and": []}, {"$or": []}, {"$or": {"a": 1}}, {"$x": 1}, {"f": {"$and": [1]}}, {"f": {}}, {"f": {"$eq": 1, "$ne": 2}}, {"f": {"$near": 1}}, {"f": {"$between": [1]}}, {"f": {"$in": []}}, {"f": {"$in": [None]}}, {"f": {"$like": 3}}, [1]],
)
def test_malformed_filters_raise(spark, spec):
    with pytest.raises(FilterValidationError):
        compile_filter(spec)


def test_filter_analysis():
    assert filter_fields({"a": 1, "$or": [{"b": 2}, {"a": {"$gt": 3}}]}) == ["a", "b"]
    assert index_compatible({"a": 1, "b": {"$between": [1, 2]}})
    assert not index_compatible({"$or": [{"a": 1}, {"b": 2}]})
    assert not index_compatible({"a": {"$like": "x"}})


def test_filter_reaches_the_scan(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "t"))
    plan = vector.knn(spark.read.parquet(str(tmp_path / "t")), Q, filters={"year": {"$gt": 2020}})._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThan(year,2020)" in plan
    assert "TakeOrderedAndProject" in plan


def test_vector_retriever(docs):
    r = vector.VectorRetriever(docs, embedder=lambda t: Q, return_columns=["id"])
    assert ids(r.search(query_text="x", top_k=2)) == ["doc1", "doc2"]
    assert "embedding" not in vector.VectorRetriever(docs).search(query_vector=Q).columns
    expanded = vector.VectorRetriever(docs, expand=lambda hits: hits.groupBy("category").count())
    assert {r["category"]: r["count"] for r in expanded.search(query_vector=Q).collect()} == {"science": 3, "history": 2}
    for bad in ({}, {"query_text": "a", "query_vector": Q}, {"query_vector": Q, "top_k": 0}, {"query_vector": Q, "effective_search_ratio": 0}):
        with pytest.raises(SearchValidationError):
            r.search(**bad)


def test_vector_index_opens_few_files_and_finds_the_same(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(10, 8))
    v = centres[np.arange(1000) % 10] + rng.normal(size=(1000, 8)) * 0.1
    rows = [(i, int(i % 10), [float(x) for x in r], None if i % 7 else "odd") for i, r in enumerate(v)] + [(2000, 1, None, "a"), (2001, 1, [1.0], "a"), (2002, 1, [0.0] * 8, "b"), (2003, 3, list(map(float, v[3])), "tie")]
    table = spark.createDataFrame(rows, "id long, kind int, embedding array<double>, note string")
    hits = lambda df: [(r["id"], None if r["score"] is None else round(r["score"], 9)) for r in df.collect()]
    for similarity in ("cosine", "euclidean"):
        index = VectorIndex.create(table, str(tmp_path / similarity), 8, similarity=similarity, filterable=("kind", "id"), file_rows=50)
        every = index.plan(v[3].tolist())
        for q, k, filters in ((v[3], 5, None), (v[8] * 2, 40, {"kind": 8}), (v[5], 7, {"id": {"$gt": 500}}), (v[1], 3, {"note": "odd", "kind": {"$in": [1, 2]}}), (v[0], 2000, None), (np.ones(8), 3, {"kind": {"$between": [20, 30]}})):
            want = vector.knn(table, q.tolist(), k, similarity=similarity, filters=filters)
            assert hits(index.search(q.tolist(), k, filters)) == hits(want)
        assert len(every) >= 15 and len(index.files_for(v[3].tolist(), 5)) < len(every) / 3
        assert len(index.plan(v[3].tolist(), {"id": {"$lt": 0}})) == 0
        read = {r["f"] for r in index.rows(index.files_for(v[3].tolist(), 5)).select(F.input_file_name().alias("f")).distinct().collect()}
        assert len(read) < len(every) / 3
        with pytest.raises(SearchValidationError):
            index.search([1.0])
    none = VectorIndex.create(table.limit(0), str(tmp_path / "none"), 8)
    assert none.search([1.0] * 8).count() == 0
    for bad in ({"similarity": "dot"}, {"filterable": ("nothing",)}):
        with pytest.raises(SearchValidationError):
            VectorIndex.create(table, str(tmp_path / "bad"), 8, **bad)


def test_bm25_ranks_and_index_agrees(spark, tmp_path):
    rows = spark.createDataFrame([(1, "red fox red"), (2, "red dog"), (3, "blue cat"), (4, None), (5, "東京都 tower")], "doc_id long, text string")
    got = fulltext.bm25(rows, "red fox", 5).collect()
    assert [r["doc_id"] for r in got] == [1, 2]
    postings = fulltext.build_postings(rows)
    avgdl = rows.select(F.avg(F.size(fulltext.tokens(F.coalesce("text", F.lit("")))))).first()[0]
    again = fulltext.search_postings(postings, 5, avgdl, "red fox", 5).collect()
    assert [(r["doc_id"], round(r["score"], 9)) for r in again] == [(r["doc_id"], round(r["score"], 9)) for r in got]
    assert fulltext.query_tokens("東京都 Tower") == ["tower", "京都", "東京"]
    assert [r["doc_id"] for r in fulltext.bm25(rows, "京都").collect()] == [5]
    index = fulltext.FullTextIndex.create(rows, str(tmp_path / "index"))
    find = lambda q: sorted(r["doc_id"] for r in index.search(q).collect())
    assert [(r["doc_id"], round(r["score"], 9)) for r in index.search("red fox", 5).collect()] == [(r["doc_id"], round(r["score"], 9)) for r in got]
    assert find('"red fox"') == [1] and find('"fox red"') == [1] and find('"dog red"') == [] and find("red AND fox") == [1]
    assert find("red NOT fox") == [2] and find("red AND NOT dog") == [1] and find("(fox OR cat) AND (blue OR dog)") == [3]
    assert find("red OR (blue AND cat)") == [1, 2, 3] and find('"東京都"') == [5] and find("nothing") == []
    assert sorted(r["doc_id"] for r in fulltext.bm25(rows, "red NOT fox").collect()) == [2]
    assert index.search("red NOT fox").first()["score"] == index.search("red").where("doc_id = 2").first()["score"]
    for bad in ('"open', "(a", "AND", "a AND", "OR a", "a OR", "NOT a", "()", "a AND OR b", "a)"):
        with pytest.raises(QueryParseError):
            fulltext.parse_query(bad)


def test_fields_wildcards_fuzzy_words_and_signs(spark, tmp_path):
    rows = spark.createDataFrame([(1, "the license text", "red"), (2, "licence of a licenser", "blue red"), (3, "red licorice", None), (4, None, "red"), (5, "plain", "green"), (5, "license again", "green")], "id long, body string, colour string")
    index = fulltext.FullTextIndex.create(rows, str(tmp_path / "index"), "id", {"body": "body", "colour": "colour"})
    scores = lambda q, k=None: {r["id"]: round(r["score"], 6) for r in index.search(q, k).collect()}
    find = lambda q: sorted(scores(q))
    assert find("red") == [3] and find("colour:red") == [1, 2, 4] and find("body:red OR colour:green") == [3, 5]
    assert scores("lic*") == {1: 1.0, 2: 1.0, 3: 1.0, 5: 1.0} and scores("licen?e^2") == {1: 2.0, 2: 2.0, 5: 2.0}
    assert find("lic*r") == [2] and find("*ce") == [2, 3] and find("li_ense") == []
    assert find("licenze~1") == [1, 2, 5] and find("licenze~") == [1, 2, 5] and find("licorize~1") == [3] and find("xyzzy~") == []
    assert scores("licenze~1")[1] == round(scores("license")[1] * (1 - 1 / 7), 6)
    assert find("+license text") == [1, 5] and scores("+license text")[1] == scores("license text")[1]
    assert find("license -text") == [5] and find("+license -again") == [1] and find("lic* -(text OR licorice)") == [2, 5]
    assert find('colour:"blue red"') == [2] and find('"red blue"') == [] and find("other:license") == [1, 5]
    assert abs(scores("license^3")[1] - 3 * scores("license")[1]) < 1e-5 and scores("license license") == scores("license")
    assert index.dictionary().where("term = 'license'").first()["df"] == 2
    without = {r["id"]: round(r["score"], 6) for r in fulltext.bm25(rows, "licenze~1 +red", key="id", text="body").collect()}
    assert sorted(without) == [3]
    for bad in ("+", "-", "+(a", "a^2)", '+"open'):
        with pytest.raises(QueryParseError):
            fulltext.parse(bad)
    empty = fulltext.FullTextIndex.create(rows.limit(0), str(tmp_path / "empty"), "id", "body")
    assert empty.search("license", 5).count() == 0 and empty.search("lic*").count() == 0


def test_top_k_opens_few_parts_and_blocks(spark, tmp_path, monkeypatch):
    """A word of all documents is many blocks in many parts; a search opens its parts only, a top-k few blocks."""
    monkeypatch.setattr(fulltext, "BLOCK", 16)
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('common ', repeat('x ', int(id % 60)), 'w', id % 500, IF(id % 2 = 0, ' half', ''), repeat(' common', int(id % 997 = 0) * 5)) AS text").repartition(3)
    index = fulltext.FullTextIndex.create(docs, str(tmp_path / "index"), parts=12)
    sizes = sorted(r["postings"] for r in spark.read.parquet(str(tmp_path / "index" / "parts")).collect())
    assert 11 <= len(sizes) <= 13 and sizes[-1] <= 3 * sizes[6]
    parts = index.parts_of(fulltext.parse("common"))
    assert 1 < len(parts) < 12 and len(index.parts_of(fulltext.parse("w77"))) <= 2
    opened = index._search("w77").blocks
    every = lambda q: [(r["doc_id"], round(r["score"], 9)) for r in fulltext.bm25(docs, q, 10).collect()]
    read = lambda df: len({r["f"] for r in df.select(F.input_file_name().alias("f")).distinct().collect()})
    assert read(opened) < read(index.blocks()) / 2
    for q in ("common", "common half", "w77 common", "w77 w78 half"):
        search = index._search(q)
        got = search.run(fulltext.parse(q), 10)
        assert [(r["doc_id"], round(r["score"], 9)) for r in got.collect()] == every(q)
        if q == "common":
            wanted = search.blocks.where("term = 'common'")
            n, a = index._sizes["text"]
            most = fulltext._weight(F.lit(float(n)), F.lit(4000.0), F.col("max_tf"), F.col("min_dl"), F.lit(a))
            assert search.pruned_below > 0 and wanted.where(most >= search.pruned_below).count() < wanted.count() / 4


def test_repeated_keys_add_up(spark, tmp_path):
    rows = spark.createDataFrame([(1, "red fox"), (1, "red"), (2, "red dog here")], "doc_id long, text string")
    index = fulltext.FullTextIndex.create(rows, str(tmp_path / "index"))
    table = {r["doc_id"]: round(r["score"], 9) for r in fulltext.bm25(rows, "red").collect()}
    assert {r["doc_id"]: round(r["score"], 9) for r in index.search("red").collect()} == table
    assert {r["doc_id"]: round(r["score"], 9) for r in index.search("red", 5).collect()} == table


def test_hybrid(spark):
    v = spark.createDataFrame([(1, 2.0), (2, 1.0)], "id long, score double")
    t = spark.createDataFrame([(1, 10.0), (3, 5.0)], "id long, score double")
    scores = lambda df: {r["id"]: r["score"] for r in df.collect()}
    assert scores(hybrid.fuse(v, t, 5, "id")) == {1: 1.0, 2: 0.5, 3: 0.5}
    assert scores(hybrid.fuse(v, t, 5, "id", "linear", 0.5)) == {1: 0.5, 2: 0.25, 3: 0.25}
    assert scores(hybrid.fuse(v, t, 5, "id", "linear", 0.5, dedupe=False)) == {1: 1.0, 2: 0.25, 3: 0.25}
    assert scores(hybrid.fuse(v, t, 5, "id", "linear", 0.0)) == {1: 1.0, 2: 0.0, 3: 0.5}
    zero = spark.createDataFrame([(1, 0.0)], "id long, score double")
    assert scores(hybrid.fuse(zero, t.limit(0), 5, "id")) == {1: 0.0}
    for bad in ({"ranker": "linear"}, {"ranker": "linear", "alpha": 2.0}, {"ranker": "best"}):
        with pytest.raises(SearchValidationError):
            hybrid.fuse(v, t, 5, "id", **bad)


def test_names():
    assert weighted_ratio("alice", "alice") == 1.0
    assert weighted_ratio("john smith", "jon smith") > 0.9
    assert weighted_ratio("alice", "bob") < 0.5
    assert weighted_ratio("", "bob") == 0.0
    assert safe_stem("Café au lait!") == "Cafe_au_lait"
    assert unique_names(["가", "나", "a b", "a_b"]) == ["unnamed", "unnamed_1", "a_b", "a_b_1"]
