"""Named queries over the supplied tables, one for each operator, with SQL that must agree."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.similarity import cosine, euclidean_score, vector_literal
from graphloom.graph import PropertyGraph, node_id, relational_graph, table
from graphloom.operators import dump, expand, fulltext, hybrid, introspect, prune, resolve, sketches, state, text, vector
from graphloom.operators.filters import compile_filter
from graphloom.operators.history import append_message, clear, last_messages
from graphloom.operators.vector_index import VectorIndex
from graphloom.plans import build
from graphloom.operators.prune import Constraint, GraphSchema, TypeRule
from graphloom.sources import export, readers, writers
from graphloom.sources.merged import MergedTable
from graphloom.sources.scratch import file_state, shared_dir
from graphloom.streaming.incremental import upsert_stream, windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# ---- filters

FILTERS = {
    "filter_eq": ({"lang": "fr"}, "lang = 'fr'"),
    "filter_ne": ({"lang": {"$ne": "en"}}, "lang <> 'en'"),
    "filter_range": ({"$and": [{"n_chars": {"$gte": 500}}, {"n_chars": {"$lt": 2000}}]}, "n_chars >= 500 AND n_chars < 2000"),
    "filter_between": ({"n_chars": {"$between": [300, 900]}}, "n_chars BETWEEN 300 AND 900"),
    "filter_in": ({"source": {"$in": ["src1", "src7"]}}, "source IN ('src1', 'src7')"),
    "filter_nin": ({"lang": {"$nin": ["en", "de"]}}, "lang NOT IN ('en', 'de')"),
    "filter_like": ({"text": {"$like": "License%"}}, "contains(text, 'License')"),
    "filter_ilike": ({"text": {"$ilike": "LICENSE%"}}, "contains(lower(text), 'license')"),
    "filter_capitals": ({"$AND": [{"n_chars": {"$GT": 500}}, {"lang": {"$IN": ["fr", "de"]}}]}, "n_chars > 500 AND lang IN ('fr', 'de')"),
    "filter_and_or": ({"$or": [{"lang": "es", "n_chars": {"$gt": 1000}}, {"source": {"$eq": "src3"}}]}, "(lang = 'es' AND n_chars > 1000) OR source = 'src3'"),
}


def _filter_query(spec: dict) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: table(spark, d, "documents").where(compile_filter(spec)).select("doc_id", "lang", "source", "n_chars")


for _name, (_spec, _sql) in FILTERS.items():
    QUERIES[_name] = _filter_query(_spec)
    ORACLE_SQL[_name] = f"SELECT doc_id, lang, source, n_chars FROM documents WHERE {_sql}"


# ---- vectors


def _vector(spark: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    return table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()["embedding"]


_Q = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"
_COS = f"list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_Q})"


def _scores(hits: DataFrame) -> DataFrame:
    return hits.select("vec_id", F.round("score", 5).alias("score"))


@query(f"SELECT vec_id, round((1 + {_COS}) / 2, 5) AS score FROM embeddings ORDER BY (1 + {_COS}) / 2 DESC, vec_id LIMIT 10")
def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _scores(vector.knn(table(spark, d, "embeddings"), _vector(spark, d), 10, "vec_id"))


@query(f"SELECT vec_id, round(1 / (1 + list_distance(CAST(embedding AS DOUBLE[]), {_Q}) ^ 2), 5) AS score FROM embeddings ORDER BY list_distance(CAST(embedding AS DOUBLE[]), {_Q}), vec_id LIMIT 10")
def knn_euclidean(spark: SparkSession, d: str) -> DataFrame:
    return _scores(vector.knn(table(spark, d, "embeddings"), _vector(spark, d), 10, "vec_id", similarity="euclidean"))


@query(f"SELECT vec_id, round((1 + {_COS}) / 2, 5) AS score FROM embeddings WHERE label = 1 AND vec_id > 20 ORDER BY {_COS} DESC, vec_id LIMIT 10")
def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _scores(vector.knn(table(spark, d, "embeddings"), _vector(spark, d), 10, "vec_id", filters={"label": 1, "vec_id": {"$gt": 20}}))


_VECTOR_INDEXES: dict[tuple, VectorIndex] = {}


def _vector_index(spark: SparkSession, d: str) -> VectorIndex:
    """The written index of a folder's vectors, made once for their files as they are."""
    key = (spark.sparkContext.applicationId, d, file_state(spark, f"{d}/embeddings.parquet"))
    if key not in _VECTOR_INDEXES or not file_state(spark, f"{_VECTOR_INDEXES[key].path}/files"):
        rows = table(spark, d, "embeddings")
        _VECTOR_INDEXES[key] = VectorIndex.create(rows, f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}", 64, "vec_id", filterable=("label", "vec_id"), file_rows=64)
    return _VECTOR_INDEXES[key]


@query(f"SELECT vec_id, round((1 + {_COS}) / 2, 5) AS score FROM embeddings ORDER BY (1 + {_COS}) / 2 DESC, vec_id LIMIT 10")
def knn_indexed(spark: SparkSession, d: str) -> DataFrame:
    return _scores(_vector_index(spark, d).search(_vector(spark, d), 10))


@query(f"SELECT vec_id, round((1 + {_COS}) / 2, 5) AS score FROM embeddings WHERE label = 1 AND vec_id > 20 ORDER BY {_COS} DESC, vec_id LIMIT 10")
def knn_indexed_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _scores(_vector_index(spark, d).search(_vector(spark, d), 10, {"label": 1, "vec_id": {"$gt": 20}}))


@query("SELECT count(*) AS n FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64")
def knn_dimension_guard(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return rows.where(F.col("embedding").isNotNull() & (F.size("embedding") == 64)).agg(F.count("*").alias("n"))


@query(f"SELECT 'vec:' || vec_id AS src, 'label:' || label AS dst, round((1 + {_COS}) / 2, 5) AS score FROM embeddings ORDER BY {_COS} DESC, 1 LIMIT 7")
def knn_relationship(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "embeddings").select(node_id("vec", "vec_id").alias("src"), node_id("label", "label").alias("dst"), "embedding")
    return vector.knn(edges, _vector(spark, d), 7, "src").select("src", "dst", F.round("score", 5).alias("score"))


@query(f"SELECT vec_id, round({_COS}, 5) AS raw, round(1 / (1 + list_distance(CAST(embedding AS DOUBLE[]), {_Q}) ^ 2), 5) AS euclidean FROM embeddings")
def similarity_functions(spark: SparkSession, d: str) -> DataFrame:
    q = vector_literal(_vector(spark, d))
    return table(spark, d, "embeddings").select("vec_id", F.round(cosine("embedding", q), 5).alias("raw"), F.round(euclidean_score("embedding", q), 5).alias("euclidean"))


@query("SELECT vec_id, len(embedding) AS dims, label, CASE WHEN vec_id % 7 = 0 THEN 'new' ELSE 'old' END AS origin FROM embeddings")
def vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    new = rows.where("id % 7 = 0").select("id", F.transform("embedding", lambda x: x * 0 + 2).alias("embedding"))
    out = writers.upsert_vectors(rows, new)
    return out.select(F.col("id").alias("vec_id"), F.size("embedding").alias("dims"), "label", F.when(F.element_at("embedding", 1) == 2, "new").otherwise("old").alias("origin"))


# ---- full text and hybrid

#: Common syllables of the invented prose, so that both branches have hits at every scale.
TEXT_QUERY = "license thing idiot"


_INDEXES: dict[tuple, fulltext.FullTextIndex] = {}


def _text_index(spark: SparkSession, d: str, anew: bool = False) -> fulltext.FullTextIndex:
    """The written index of a folder's documents: made once for their files as they are, then only searched."""
    key = (spark.sparkContext.applicationId, d, file_state(spark, f"{d}/documents.parquet"))
    if anew or key not in _INDEXES or not file_state(spark, f"{_INDEXES[key].path}/parts"):
        texts = {"text": "text", "source": "source", "lang": "lang"}
        _INDEXES[key] = fulltext.FullTextIndex.create(table(spark, d, "documents"), f"{shared_dir(spark)}/fulltext-{uuid.uuid4().hex}", text=texts)
    return _INDEXES[key]


def _bm25_sql(text_query: str) -> str:
    terms = fulltext.query_tokens(text_query)
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    stats = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(terms)))
    hit = " OR ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""tok AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS t FROM documents),
cut AS (SELECT doc_id, CAST(len(t) AS DOUBLE) AS dl, {tf} FROM tok),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl, {stats} FROM cut),
bm AS (SELECT doc_id, {score} AS score FROM cut, st WHERE {hit})"""


@query(f"WITH {_bm25_sql(TEXT_QUERY)} SELECT doc_id, round(score, 5) AS score FROM bm")
def fulltext_bm25(spark: SparkSession, d: str) -> DataFrame:
    return _text_index(spark, d).search(TEXT_QUERY).select("doc_id", F.round("score", 5).alias("score"))


@query(f"WITH {_bm25_sql(TEXT_QUERY)} SELECT doc_id, round(score, 5) AS score FROM bm")
def fulltext_without_index(spark: SparkSession, d: str) -> DataFrame:
    return fulltext.bm25(table(spark, d, "documents"), TEXT_QUERY).select("doc_id", F.round("score", 5).alias("score"))


@query(f"""WITH {_bm25_sql("license idiot")}, p AS (SELECT doc_id, t FROM tok)
SELECT doc_id, round(score, 5) AS score FROM bm JOIN p USING (doc_id) WHERE (list_contains(t, 'license') OR list_contains(t, 'idiot')) AND NOT list_contains(t, 'mit')""")
def fulltext_boolean(spark: SparkSession, d: str) -> DataFrame:
    return _text_index(spark, d).search("(license OR idiot) AND NOT mit").select("doc_id", F.round("score", 5).alias("score"))


@query(f"""WITH {_bm25_sql("mit license")}, p AS (SELECT doc_id, ' ' || array_to_string(t, ' ') || ' ' AS t FROM tok)
SELECT doc_id, round(score, 5) AS score FROM bm JOIN p USING (doc_id) WHERE contains(t, ' mit license ')""")
def fulltext_phrase(spark: SparkSession, d: str) -> DataFrame:
    return _text_index(spark, d).search('"MIT License"').select("doc_id", F.round("score", 5).alias("score"))


def _postings_sql() -> str:
    return r"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term"


@query(_postings_sql())
def fulltext_index(spark: SparkSession, d: str) -> DataFrame:
    postings = _text_index(spark, d, anew=True).postings().where("field = 'text'")
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("cf"))


@query(r"""WITH f AS (SELECT 'text' AS field, doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) AS term FROM documents
UNION ALL SELECT 'source', doc_id, unnest(regexp_extract_all(lower(coalesce(source, '')), '[\p{L}\p{N}]+')) FROM documents UNION ALL SELECT 'lang', doc_id, unnest(regexp_extract_all(lower(coalesce(lang, '')), '[\p{L}\p{N}]+')) FROM documents)
SELECT field, term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM f GROUP BY field, term""")
def fulltext_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return _text_index(spark, d).dictionary()


_TOKENS = r"tk AS (SELECT doc_id, lang, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents)"


@query(f"""WITH {_bm25_sql(TEXT_QUERY)}, {_TOKENS}, wild AS (SELECT doc_id FROM tk WHERE len(list_filter(w, lambda x: starts_with(x, 'lic') AND x LIKE 'lic%se')) > 0)
SELECT doc_id, CAST(1.5 AS DOUBLE) AS score FROM wild""")
def fulltext_wildcard(spark: SparkSession, d: str) -> DataFrame:
    return _text_index(spark, d).search("lic*se^1.5")


@query(rf"""WITH {_bm25_sql("license")}, {_TOKENS}, l AS (SELECT doc_id, count(*) AS m FROM documents WHERE lower(lang) = 'en' GROUP BY doc_id),
df AS (SELECT count(*) AS df FROM documents WHERE lower(lang) = 'en'), ll AS (SELECT avg(len(regexp_extract_all(lower(coalesce(lang, '')), '[\p{{L}}\p{{N}}]+'))) AS a, count(*) AS n FROM documents)
SELECT bm.doc_id, round(score + 2 * ln(1 + (ll.n - df + 0.5) / (df + 0.5)) / (1 + 1.2 * (0.25 + 0.75 / a)), 5) AS score FROM bm JOIN l USING (doc_id), df, ll""")
def fulltext_fields(spark: SparkSession, d: str) -> DataFrame:
    return _text_index(spark, d).search("+license +lang:en^2").select("doc_id", F.round("score", 5).alias("score"))


@query(f"""WITH {_TOKENS}, u AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM tk), n AS (SELECT count(*) AS n, avg(len(w)) AS a FROM tk),
near AS (SELECT term, count(DISTINCT doc_id) AS df, 1 - levenshtein(term, 'licence') / CAST(least(length(term), 7) AS DOUBLE) AS boost FROM u WHERE length(term) BETWEEN 5 AND 9 AND levenshtein(term, 'licence') <= 2 GROUP BY term),
tf AS (SELECT doc_id, term, dl, count(*) AS tf FROM u JOIN near USING (term) GROUP BY doc_id, term, dl)
SELECT doc_id, round(sum(boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 5) AS score FROM tf JOIN near USING (term), n GROUP BY doc_id""")
def fulltext_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return _text_index(spark, d).search("licence~").select("doc_id", F.round("score", 5).alias("score"))


@query(f"WITH {_bm25_sql(TEXT_QUERY)} SELECT doc_id, round(score, 5) AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 10")
def fulltext_top(spark: SparkSession, d: str) -> DataFrame:
    return _text_index(spark, d).search(TEXT_QUERY, 10).select("doc_id", F.round("score", 5).alias("score"))


def _branches(spark: SparkSession, d: str, k: int = 20) -> tuple[DataFrame, DataFrame]:
    v = vector.knn(table(spark, d, "embeddings"), _vector(spark, d), k, "vec_id").select(F.col("vec_id").alias("doc_id"), "score")
    return v, _text_index(spark, d).search(TEXT_QUERY, k)


def _hybrid_sql(weight_v: str, weight_t: str, total: str, union: str = "UNION") -> str:
    return f"""WITH {_bm25_sql(TEXT_QUERY)},
v AS (SELECT vec_id AS doc_id, (1 + {_COS}) / 2 AS score FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 20),
t AS (SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 20),
b AS (SELECT doc_id, {weight_v} * score / (SELECT max(score) FROM v) AS score FROM v {union} SELECT doc_id, {weight_t} * score / (SELECT max(score) FROM t) FROM t)
SELECT doc_id, round({total}(score), 5) AS score FROM b GROUP BY doc_id"""


def _fused(spark: SparkSession, d: str, **how) -> DataFrame:
    return hybrid.fuse(*_branches(spark, d), 40, "doc_id", **how).select("doc_id", F.round("score", 5).alias("score"))


@query(_hybrid_sql("1.0", "1.0", "max"))
def hybrid_naive(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d)


@query(_hybrid_sql("0.7", "0.3", "sum"))
def hybrid_linear(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d, ranker="linear", alpha=0.7)


@query(_hybrid_sql("0.5", "0.5", "sum", "UNION ALL"))
def hybrid_linear_all(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d, ranker="linear", alpha=0.5, dedupe=False)


_HYBRID = f"""{_bm25_sql(TEXT_QUERY)},
v AS (SELECT vec_id AS doc_id, (1 + {_COS}) / 2 AS score FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents) ORDER BY {_COS} DESC, vec_id LIMIT 20),
t AS (SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 20),
b AS (SELECT doc_id, score / (SELECT max(score) FROM v) AS score FROM v UNION SELECT doc_id, score / (SELECT max(score) FROM t) FROM t),
h AS (SELECT doc_id, max(score) AS score FROM b GROUP BY doc_id ORDER BY 2 DESC, 1 LIMIT 20)"""


def _hybrid_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")


@query(f"WITH {_HYBRID} SELECT doc_id, round(score, 5) AS score FROM h")
def hybrid_retriever(spark: SparkSession, d: str) -> DataFrame:
    found = hybrid.HybridRetriever(_hybrid_rows(spark, d), "doc_id", "embedding", "text", index=_text_index(spark, d)).search(TEXT_QUERY, _vector(spark, d), 20)
    return found.select("doc_id", F.round("score", 5).alias("score"))


@query(f"SELECT vec_id AS doc_id, source, round(score, 5) AS score FROM (SELECT vec_id, (1 + {_COS}) / 2 AS score FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 15) JOIN documents ON doc_id = vec_id")
def vector_expand(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source")
    expanded = lambda hits: hits.select(F.col("vec_id").alias("doc_id"), "score").join(docs, "doc_id")
    found = vector.VectorRetriever(table(spark, d, "embeddings"), "vec_id", expand=expanded).search(_vector(spark, d), top_k=15)
    return found.select("doc_id", "source", F.round("score", 5).alias("score"))


@query("WITH x(id, s) AS (VALUES (1, 0.5), (1, 0.5), (2, 0.25), (2, 0.1)) SELECT id, round(sum(s), 5) AS score FROM (SELECT DISTINCT id, s FROM x) GROUP BY id")
def hybrid_linear_union_dedup(spark: SparkSession, d: str) -> DataFrame:
    v = spark.sql("SELECT * FROM VALUES (1, 2.0D), (2, 1.0D) AS t(id, score)")
    t = spark.sql("SELECT * FROM VALUES (1, 10.0D), (2, 2.0D) AS t(id, score)")
    return hybrid.fuse(v, t, 10, "id", "linear", 0.5).select("id", F.round("score", 5).alias("score"))


@query(f"WITH {_HYBRID} SELECT doc_id, source, lang, round(score, 5) AS score FROM h JOIN documents USING (doc_id)")
def hybrid_expand(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    expanded = lambda hits: hits.join(docs, "doc_id").select("doc_id", "source", "lang", F.round("score", 5).alias("score"))
    return hybrid.HybridRetriever(_hybrid_rows(spark, d), "doc_id", "embedding", "text", expand=expanded, index=_text_index(spark, d)).search(TEXT_QUERY, _vector(spark, d), 20)


# ---- graph

_NODES = " UNION ALL ".join(f"SELECT '{label}:' || {key} AS id, '{label}' AS label, {name} AS name FROM {t}" for label, t, key, name in (("customer", "customer", "c_custkey", "c_name"), ("supplier", "supplier", "s_suppkey", "s_name"), ("nation", "nation", "n_nationkey", "n_name"), ("region", "region", "r_regionkey", "r_name")))
_PLACES = "SELECT 'customer:' || c_custkey AS src, 'IN_NATION' AS type, 'nation:' || c_nationkey AS dst FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'IN_NATION', 'nation:' || s_nationkey FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, 'LOCATED_IN', 'region:' || n_regionkey FROM nation"


def _places(spark: SparkSession, d: str):
    return relational_graph(spark, d, ("IN_NATION", "LOCATED_IN"), ("customer", "supplier", "nation", "region"))


@query("SELECT 'customer' AS label, count(*) AS n FROM customer UNION ALL SELECT 'order', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'nation', count(*) FROM nation")
def graph_label_counts(spark: SparkSession, d: str) -> DataFrame:
    return introspect.label_counts(relational_graph(spark, d).nodes, hidden=("region",))


@query("""SELECT 'PLACED' AS type, count(*) AS n FROM orders UNION ALL SELECT 'CONTAINS', count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
UNION ALL SELECT 'SUPPLIED_BY', count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) UNION ALL SELECT 'IN_NATION', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'LOCATED_IN', count(*) FROM nation""")
def graph_rel_counts(spark: SparkSession, d: str) -> DataFrame:
    return introspect.type_counts(relational_graph(spark, d).edges)


@query("""SELECT 'customer' AS src_label, 'PLACED' AS type, 'order' AS dst_label FROM orders JOIN customer ON c_custkey = o_custkey UNION SELECT 'order', 'CONTAINS', 'part' FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey
UNION SELECT 'part', 'SUPPLIED_BY', 'supplier' FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey UNION SELECT 'customer', 'IN_NATION', 'nation' FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION SELECT 'supplier', 'IN_NATION', 'nation' FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION SELECT 'nation', 'LOCATED_IN', 'region' FROM nation JOIN region ON r_regionkey = n_regionkey""")
def graph_patterns(spark: SparkSession, d: str) -> DataFrame:
    g = relational_graph(spark, d)
    return introspect.patterns(PropertyGraph(g.nodes, g.edges.select("src", "type", "dst")).typed_edges())


@query("""SELECT 'customer' AS src_label, 'IN_NATION' AS type, 'nation' AS dst_label, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 'supplier', 'IN_NATION', 'nation', count(*) FROM supplier JOIN nation ON n_nationkey = s_nationkey
UNION ALL SELECT 'nation', 'LOCATED_IN', 'region', count(*) FROM nation JOIN region ON r_regionkey = n_regionkey""")
def graph_typed_edges(spark: SparkSession, d: str) -> DataFrame:
    g = _places(spark, d)
    typed = PropertyGraph(g.nodes, g.edges.select("src", "type", "dst")).typed_edges()
    return typed.groupBy("src_label", "type", "dst_label").agg(F.count("*").alias("n"))


@query(f"SELECT id, label, name FROM ({_NODES}) WHERE label NOT IN ('customer', 'region')")
def graph_nodes_without(spark: SparkSession, d: str) -> DataFrame:
    return _places(spark, d).without("customer", "region").select("id", "label", "name")


@query(f"""WITH n AS (SELECT id, label, name FROM ({_NODES})) SELECT id, CASE label WHEN 'region' THEN 'region' ELSE label || ',__Entity__' END AS labels,
CASE label WHEN 'region' THEN 'region' ELSE label END AS domain, 'label=' || label || ', name=' || name AS summary FROM n""")
def node_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = writers.with_labels(_places(spark, d).nodes, ("region",))
    props = F.create_map(F.lit("name"), F.col("name"), F.lit("label"), F.col("label"), F.lit("none"), F.lit(None).cast("string"))
    return rows.select("id", F.array_join("labels", ",").alias("labels"), expand.domain_label("labels").alias("domain"), expand.props_summary(props).alias("summary"))


@query("SELECT 'label' AS kind, t AS name, n FROM (SELECT 'customer' AS t, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'region', count(*) FROM region) UNION ALL SELECT 'pattern', t, n FROM (SELECT 'customer IN_NATION nation' AS t, count(*) AS n FROM customer UNION ALL SELECT 'supplier IN_NATION nation', count(*) FROM supplier UNION ALL SELECT 'nation LOCATED_IN region', count(*) FROM nation)")
def graph_export(spark: SparkSession, d: str) -> DataFrame:
    """What is read back from an export: rows by label, and by pattern with the ends' labels."""
    g = _places(spark, d)
    folders = writers.export_graph(g.nodes, g.edges.select("src", "type", "dst"), f"{shared_dir(spark)}/export-{uuid.uuid4().hex}")
    out = None
    for key, folder in folders.items():
        rows = spark.read.parquet(folder)
        if isinstance(key, tuple):
            part = rows.groupBy(F.concat_ws(" ", "from_label", "type", "to_label").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("pattern"))
        else:
            part = rows.where("__id__ is not null").groupBy(F.col("label").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("label"))
        out = part if out is None else out.unionByName(part)
    return out.select("kind", "name", "n")


@query("""WITH p AS (SELECT 'customer' AS label, 'name' AS property, 'STRING' AS kind, true AS is_key FROM customer UNION ALL SELECT 'customer', 'balance', 'FLOAT', false FROM customer UNION ALL SELECT 'customer', 'code', 'INTEGER', false FROM customer
UNION ALL SELECT 'supplier', 'balance', 'FLOAT', false FROM supplier UNION ALL SELECT 'supplier', 'code', 'STRING', false FROM supplier UNION ALL SELECT 'nation', 'code', 'INTEGER', false FROM nation UNION ALL SELECT 'nation', 'vector', 'FLOAT_ARRAY', false FROM nation)
SELECT 'property' AS what, label || '.' || property AS name, kind, count(*) AS n, bool_or(is_key) AS is_key, CASE property WHEN 'vector' THEN 2 END AS dimensions, NULL AS total FROM p GROUP BY label, property, kind
UNION ALL SELECT 'sum', 'customer.code', 'INTEGER', count(*), NULL, NULL, sum(c_custkey * 2) FROM customer UNION ALL SELECT 'sum', 'supplier.code', 'STRING', count(*), NULL, NULL, sum(length('S' || s_suppkey)) FROM supplier
UNION ALL SELECT 'sum', 'customer IN_NATION nation', NULL, count(*), NULL, NULL, sum(length(c_name) + length('nation:' || c_nationkey)) FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def graph_export_schema(spark: SparkSession, d: str) -> DataFrame:
    """Nodes whose properties differ by label and row: kinds, keys and sizes of the schema table, and what is read back."""
    props = lambda **kw: F.to_variant_object(F.struct(*(v.alias(k) for k, v in kw.items())))
    node = lambda t, label, key, **kw: table(spark, d, t).select(node_id(label, key).alias("id"), F.lit(label).alias("label"), props(**kw).alias("props"))
    nodes = node("customer", "customer", "c_custkey", name=F.col("c_name"), balance=F.col("c_acctbal"), code=F.col("c_custkey") * 2)
    nodes = nodes.unionByName(node("supplier", "supplier", "s_suppkey", balance=F.col("s_acctbal"), code=F.concat(F.lit("S"), F.col("s_suppkey"))))
    nodes = nodes.unionByName(node("nation", "nation", "n_nationkey", code=F.col("n_nationkey"), vector=F.array(F.col("n_nationkey"), F.col("n_regionkey"))))
    edges = table(spark, d, "customer").select(node_id("customer", "c_custkey").alias("src"), F.lit("IN_NATION").alias("type"), node_id("nation", "c_nationkey").alias("dst"))
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    export.export_graph(nodes, edges, path, constraints=[Constraint("key", ("name",), node="customer")])
    schema = export.read_schema(spark, path).where("what = 'node' and property <> '__id__'")
    none = lambda kind: F.lit(None).cast(kind)
    rows = schema.select(F.lit("property").alias("what"), F.concat_ws(".", "label", "property").alias("name"), "kind", F.col("n_rows").alias("n"), "is_key", "dimensions", none("bigint").alias("total"))

    def total(key, name: str, kind: str | None, value) -> DataFrame:
        got = export.read_export(spark, path, key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
        return got.select(F.lit("sum").alias("what"), F.lit(name).alias("name"), F.lit(kind).cast("string").alias("kind"), "n", none("boolean").alias("is_key"), none("int").alias("dimensions"), F.col("total").cast("bigint").alias("total"))

    rows = rows.unionByName(total("customer", "customer.code", "INTEGER", F.col("code"))).unionByName(total("supplier", "supplier.code", "STRING", F.length("code")))
    return rows.unionByName(total(("customer", "IN_NATION", "nation"), "customer IN_NATION nation", None, F.length("from") + F.length("to")))


@query(f"WITH e AS ({_PLACES}) SELECT DISTINCT id, type, neighbour FROM (SELECT src AS id, type, dst AS neighbour FROM e UNION ALL SELECT dst, type, src FROM e) WHERE id IN ('nation:3', 'region:1')")
def graph_one_hop(spark: SparkSession, d: str) -> DataFrame:
    g = _places(spark, d)
    return expand.one_hop(g, g.nodes.where(F.col("id").isin("nation:3", "region:1")))


@query(f"""WITH RECURSIVE e AS ({_PLACES}), r(id, reached, hops) AS (SELECT src, dst, 1 FROM e UNION SELECT r.id, e.dst, r.hops + 1 FROM r JOIN e ON r.reached = e.src WHERE r.hops < 5)
SELECT id, reached, min(hops) AS hops FROM r GROUP BY id, reached""")
def graph_closure(spark: SparkSession, d: str) -> DataFrame:
    return expand.closure(_places(spark, d).edges)


@query(f"WITH e AS ({_PLACES}), s AS (SELECT 'nation:' || n_nationkey AS id FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'customer:' || c_custkey FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'region:2') SELECT src, type, dst FROM e WHERE src IN (SELECT id FROM s) AND dst IN (SELECT id FROM s)")
def graph_induced_subgraph(spark: SparkSession, d: str) -> DataFrame:
    members = table(spark, d, "nation").where("n_regionkey = 2").select(node_id("nation", "n_nationkey").alias("id")).unionByName(table(spark, d, "customer").where("c_custkey % 3 = 0").select(node_id("customer", "c_custkey").alias("id"))).unionByName(spark.sql("SELECT 'region:2' AS id"))
    return expand.induced_edges(_places(spark, d).edges.select("src", "type", "dst"), members)


def _retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Documents near vector 0 are the anchors; a document's fact is the customer of its number."""
    near = vector.knn(table(spark, d, "embeddings"), _vector(spark, d), 10, "vec_id").select(F.col("vec_id").alias("doc_id"), "score")
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    anchors = near.join(docs, "doc_id").select(node_id("doc", "doc_id").alias("chunk"), "doc_id", F.col("source").alias("chapter"), "text", "score")
    evidence = table(spark, d, "customer").select(node_id("doc", "c_custkey").alias("chunk"), node_id("customer", "c_custkey").alias("fact"))
    return expand.retrieve(_places(spark, d), anchors, evidence, upward=("LOCATED_IN",))


@query(f"""WITH near AS (SELECT vec_id AS doc_id, (1 + {_COS}) / 2 AS score FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 10),
f AS (SELECT n.doc_id, c_custkey, c_nationkey, n_regionkey FROM near n JOIN customer ON c_custkey = n.doc_id JOIN nation ON n_nationkey = c_nationkey)
SELECT d.doc_id, d.source AS chapter, round(score, 5) AS score, coalesce('customer:' || c_custkey, '') AS facts,
    CASE WHEN c_custkey IS NULL THEN '' ELSE array_to_string(list_sort(['customer:' || c_custkey, 'nation:' || c_nationkey, 'region:' || n_regionkey]), ',') END AS subgraph,
    CASE WHEN c_custkey IS NULL THEN '' ELSE array_to_string(list_sort(['customer:' || c_custkey || '-IN_NATION-nation:' || c_nationkey, 'nation:' || c_nationkey || '-LOCATED_IN-region:' || n_regionkey]), ',') END AS edges
FROM near JOIN documents d USING (doc_id) LEFT JOIN f USING (doc_id)""")
def retrieve_expand(spark: SparkSession, d: str) -> DataFrame:
    found = _retrieval(spark, d)
    return found.select(
        "doc_id", "chapter", F.round("score", 5).alias("score"), F.array_join("facts", ",").alias("facts"),
        F.array_join(F.array_sort(F.transform("subgraph", lambda n: n.id)), ",").alias("subgraph"),
        F.array_join(F.array_sort(F.transform("edges", lambda e: F.concat_ws("-", e.src, e.type, e.dst))), ",").alias("edges"),
    )


_WIDE = f"""({_PLACES} UNION ALL SELECT 'nation:' || n_nationkey, 'RELATED_TO', 'nation:' || (n_nationkey + 1) % 25 FROM nation
UNION ALL SELECT 'nation:' || n_nationkey, 'PART_OF', 'org:' || n_nationkey % 3 FROM nation UNION ALL SELECT 'org:' || i, 'PART_OF', 'org:9' FROM range(3) t(i))"""


@query(f"""WITH RECURSIVE e AS {_WIDE}, near AS (SELECT vec_id AS doc_id FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 10),
f AS (SELECT doc_id, 'customer:' || c_custkey AS id FROM near JOIN customer ON c_custkey = doc_id), both_ways AS (SELECT src AS a, type, dst AS b FROM e UNION ALL SELECT dst, type, src FROM e),
nb AS (SELECT DISTINCT doc_id, b AS id FROM f JOIN both_ways ON a = id),
up(doc_id, type, id) AS (SELECT doc_id, type, dst FROM nb JOIN e ON src = id WHERE type IN ('LOCATED_IN', 'PART_OF') UNION SELECT up.doc_id, up.type, e.dst FROM up JOIN e ON e.src = up.id AND e.type = up.type),
m AS (SELECT doc_id, id FROM f UNION SELECT doc_id, id FROM nb UNION SELECT doc_id, id FROM up UNION SELECT doc_id, b FROM nb JOIN both_ways ON a = id WHERE type = 'RELATED_TO')
SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 2 = 0 THEN d.source END, 'ch' || d.doc_id % 5) AS chapter, coalesce((SELECT string_agg(id, ',' ORDER BY id) FROM m WHERE m.doc_id = d.doc_id), '') AS subgraph,
coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT src || '-' || type || '-' || dst AS x FROM e WHERE src IN (SELECT id FROM m WHERE m.doc_id = d.doc_id) AND dst IN (SELECT id FROM m WHERE m.doc_id = d.doc_id))), '') AS edges
FROM near JOIN documents d USING (doc_id)""")
def retrieve_wide(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval with all its surroundings: chapter by join, related nodes, two ways upward."""
    near = vector.knn(table(spark, d, "embeddings"), _vector(spark, d), 10, "vec_id").select(F.col("vec_id").alias("doc_id"), "score")
    docs = near.join(table(spark, d, "documents"), "doc_id")
    anchors = docs.select(node_id("doc", "doc_id").alias("chunk"), "doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("chapter"), "text", "score")
    chapters = table(spark, d, "documents").select(node_id("doc", "doc_id").alias("chunk"), F.concat(F.lit("ch"), (F.col("doc_id") % 5).cast("string")).alias("number"))
    g, n = _places(spark, d), table(spark, d, "nation")
    org = spark.range(10).where("id in (0, 1, 2, 9)").select(node_id("org", "id").alias("id"), F.lit("org").alias("label"), F.lit("o").alias("name"))
    more = n.select(node_id("nation", "n_nationkey").alias("src"), F.lit("RELATED_TO").alias("type"), F.concat(F.lit("nation:"), ((F.col("n_nationkey") + 1) % 25).cast("string")).alias("dst"))
    part_of = n.select(node_id("nation", "n_nationkey").alias("src"), F.lit("PART_OF").alias("type"), F.concat(F.lit("org:"), (F.col("n_nationkey") % 3).cast("string")).alias("dst"))
    top = spark.range(3).select(node_id("org", "id").alias("src"), F.lit("PART_OF").alias("type"), F.lit("org:9").alias("dst"))
    wide = PropertyGraph(g.nodes.select("id", "label", "name").unionByName(org), g.edges.select("src", "type", "dst").unionByName(more).unionByName(part_of).unionByName(top))
    evidence = table(spark, d, "customer").select(node_id("doc", "c_custkey").alias("chunk"), node_id("customer", "c_custkey").alias("fact"))
    found = expand.retrieve(wide, anchors, evidence, related=("RELATED_TO",), upward=("LOCATED_IN", "PART_OF"), chapters=chapters)
    return found.select(
        "doc_id", "chapter", F.array_join(F.array_sort(F.transform("subgraph", lambda n: n.id)), ",").alias("subgraph"),
        F.array_join(F.array_sort(F.transform("edges", lambda e: F.concat_ws("-", e.src, e.type, e.dst))), ",").alias("edges"),
    )


@query(f"WITH n AS ({_NODES}) SELECT label, string_agg('- ' || name, chr(10) ORDER BY '- ' || name) AS body FROM n GROUP BY label")
def graph_dump_text(spark: SparkSession, d: str) -> DataFrame:
    return expand.dump_text(_places(spark, d))


PAGE = 4000
_DUMP_STATES = """WITH st AS (SELECT 'order:' || o_orderkey AS state, 'order ' || o_orderkey AS sname, o_custkey, o_orderstatus, day(ts) AS est FROM orders LEFT JOIN events ON event_id = o_orderkey),
held AS (SELECT st.*, c_name, 'customer:' || c_custkey AS owner FROM st JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'P'),
orphan AS (SELECT * FROM st WHERE state NOT IN (SELECT state FROM held)), since AS (SELECT state, CASE WHEN est IS NULL THEN '' ELSE ' (since ' || est || ')' END AS since FROM st)"""
#: Lines of the dump with their keys: section, k1, k2, k3, owner, part, s1, s2, s3, sub, t, line.
_DUMP_LINES = """SELECT 1 AS section, 0 AS k1, 0 AS k2, c_name AS k3, 'customer:' || c_custkey AS owner, 0 AS part, 0 AS s1, '' AS s2, '' AS s3, 0 AS sub, '' AS t, '- (Character) ' || c_name || ' — segment=' || c_mktsegment AS line FROM customer
UNION ALL SELECT 1, 0, 0, c_name, owner, 1, coalesce(est, 0), sname, state, 0, '', '  · state: ' || sname || since FROM held JOIN since USING (state)
UNION ALL SELECT 1, 0, 0, c_name, owner, 1, coalesce(est, 0), sname, state, 1, n_name, '    · about: ' || n_name FROM held JOIN nation ON n_nationkey = o_custkey % 25
UNION ALL SELECT 1, 0, 0, c_name, 'customer:' || c_custkey, 9, 0, 'IN_NATION', n_name, 0, 'nation:' || n_nationkey, '  · IN_NATION → Location:' || n_name FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT 1, 1, 0, '', '', 0, 0, sname, state, 0, '', '- (CharacterState, of nobody) ' || sname || since FROM orphan JOIN since USING (state)
UNION ALL SELECT 1, 1, 0, '', '', 0, 0, sname, state, 1, n_name, '    · about: ' || n_name FROM orphan JOIN nation ON n_nationkey = o_custkey % 25
UNION ALL SELECT 2, day(ts), event_id, event_type, 'event:' || event_id, 0, 0, '', '', 0, '', '- (Event) ' || event_type || ' (' || day(ts) || ' #' || event_id || ')' FROM events
UNION ALL SELECT 2, day(ts), event_id, event_type, 'event:' || event_id, 1, 0, n_name, 'nation:' || n_nationkey, 0, '', '  · at: ' || n_name FROM events JOIN nation ON n_nationkey = user_id % 25
UNION ALL SELECT 2, day(ts), event_id, event_type, 'event:' || event_id, 2, 0, c_name, 'customer:' || c_custkey, 0, '', '  · with: ' || c_name FROM events JOIN customer ON c_custkey = user_id
UNION ALL SELECT 3, 0, 0, 'Location' || chr(9) || n_name, 'nation:' || n_nationkey, 0, 0, '', '', 0, '', '- (Location) ' || n_name FROM nation
UNION ALL SELECT 3, 0, 0, 'Location' || chr(9) || r_name, 'region:' || r_regionkey, 0, 0, '', '', 0, '', '- (Location) ' || r_name FROM region
UNION ALL SELECT 3, 0, 0, 'Location' || chr(9) || n_name, 'nation:' || n_nationkey, 1, 0, r_name, 'region:' || r_regionkey, 0, 'LOCATED_IN', '  · in: ' || r_name FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT section, -4611686018427387904, 0, '', '', -1, 0, '', '', 0, '', line FROM (VALUES (1, '## Characters'), (2, '## Events'), (3, '## Items, locations, organisations')) h(section, line)"""


@query(f"""{_DUMP_STATES}, l AS ({_DUMP_LINES}), p AS (SELECT section, line, sum(length(line) + 1) OVER (ORDER BY section, k1, k2, k3, owner, part, s1, s2, s3, sub, t, line ROWS UNBOUNDED PRECEDING) - length(line) - 1 AS start FROM l)
SELECT section, CAST(start // {PAGE - PAGE // 2} AS BIGINT) AS page, string_agg(line || chr(10), '' ORDER BY start) AS body FROM p GROUP BY 1, 2""")
def graph_dump_pages(spark: SparkSession, d: str) -> DataFrame:
    """Customers as characters, orders as their states (some of nobody), events, nations and regions."""
    t = lambda name: table(spark, d, name)
    none, no_props = (lambda kind: F.lit(None).cast(kind)), F.lit(None).cast("map<string,string>")

    def nodes(rows: DataFrame, label: str, prefix: str, key: str, name, chapter=none("int"), order=none("bigint"), props=no_props) -> DataFrame:
        return rows.select(node_id(prefix, key).alias("id"), F.lit(label).alias("label"), name.alias("name"), chapter.alias("chapter"), order.alias("story_order"), props.alias("props"))

    parts = [
        nodes(t("customer"), "Character", "customer", "c_custkey", F.col("c_name"), props=F.create_map(F.lit("segment"), F.col("c_mktsegment"))),
        nodes(t("orders"), "CharacterState", "order", "o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))),
        nodes(t("events"), "Event", "event", "event_id", F.col("event_type"), F.dayofmonth("ts"), F.col("event_id")),
        nodes(t("nation"), "Location", "nation", "n_nationkey", F.col("n_name")), nodes(t("region"), "Location", "region", "r_regionkey", F.col("r_name")),
    ]
    orders, events = t("orders").withColumn("_n", F.col("o_custkey") % 25), t("events").withColumn("_n", F.col("user_id") % 25)
    edge = lambda rows, a, a_key, kind, b, b_key: rows.select(node_id(a, a_key).alias("src"), F.lit(kind).alias("type"), node_id(b, b_key).alias("dst"))
    edges = [
        edge(orders.where("o_orderstatus <> 'P'"), "customer", "o_custkey", "HAS_STATE", "order", "o_orderkey"), edge(orders, "order", "o_orderkey", "ESTABLISHED_IN", "event", "o_orderkey"), edge(orders, "order", "o_orderkey", "ABOUT", "nation", "_n"),
        edge(events, "nation", "_n", "HOSTS", "event", "event_id"), edge(events, "customer", "user_id", "APPEARS_IN", "event", "event_id"),
        edge(t("customer"), "customer", "c_custkey", "IN_NATION", "nation", "c_nationkey"), edge(t("nation"), "nation", "n_nationkey", "LOCATED_IN", "region", "n_regionkey"),
    ]
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    return dump.pages(dump.lines(PropertyGraph(union(parts), union(edges))), PAGE)


@query("SELECT DISTINCT o.o_orderkey, o.o_custkey FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE n.n_nationkey = 5")
def member_distinct(spark: SparkSession, d: str) -> DataFrame:
    members = table(spark, d, "customer").where("c_nationkey = 5").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(members, "o_custkey").select("o_orderkey", "o_custkey").distinct()


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS story_rank FROM events")
def range_events_ordered(spark: SparkSession, d: str) -> DataFrame:
    return state.ranked_story(table(spark, d, "events"), "user_id", "ts", "event_id").select("event_id", "user_id", "story_rank")


@query("SELECT doc_id, source, round((1 + c) / 2, 5) AS score FROM (SELECT vec_id, " + _COS + " AS c FROM embeddings) JOIN documents ON vec_id = doc_id")
def external_id_join(spark: SparkSession, d: str) -> DataFrame:
    q = vector_literal(_vector(spark, d))
    matches = table(spark, d, "embeddings").select(F.col("vec_id").alias("external"), ((cosine("embedding", q) + 1) / 2).alias("score"))
    return readers.external_matches(matches, table(spark, d, "documents"), "external", "doc_id").select("doc_id", "source", F.round("score", 5).alias("score"))


# ---- states: a user is a character, an event its state, the day its chapter

_EV = "SELECT event_id, user_id, event_type, value, date_diff('day', DATE '2020-01-01', CAST(ts AS DATE)) AS chapter FROM events"


def _states(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.datediff(F.to_date("ts"), F.lit("2020-01-01").cast("date")).cast("long").alias("chapter"))


@query(f"SELECT event_id, event_type, chapter FROM ({_EV}) WHERE user_id = 7")
def state_history(spark: SparkSession, d: str) -> DataFrame:
    return state.history(_states(spark, d), F.col("user_id") == 7, "chapter", "event_id").select("event_id", "event_type", "chapter")


@query(f"SELECT event_id, event_type, chapter FROM ({_EV}) WHERE user_id = 7 AND chapter <= (SELECT min(chapter) + 10 FROM ({_EV}))")
def state_history_upto(spark: SparkSession, d: str) -> DataFrame:
    rows = _states(spark, d)
    up_to = rows.agg(F.min("chapter")).first()[0] + 10
    return state.history(rows, F.col("user_id") == 7, "chapter", "event_id", up_to).select("event_id", "event_type", "chapter")


_ENTITY_STATES = """WITH c AS (SELECT c_custkey FROM customer WHERE c_name = 'alias-7' OR c_custkey = 7), s AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c))
SELECT 'Customer#000000007' AS "character", coalesce((SELECT string_agg(c_name, ',' ORDER BY c_name) FROM (SELECT DISTINCT c_name FROM customer WHERE c_custkey IN (6, 8))), '') AS related, o_orderstatus AS content, o_orderpriority AS source_desc,
coalesce(e.ch, k.ch) AS chapter, coalesce(targets, '') AS targets, coalesce(n, 0) AS n_evidence FROM s
LEFT JOIN (SELECT l_orderkey AS o_orderkey, min(l_linenumber) AS ch FROM lineitem WHERE l_linenumber > 2 GROUP BY 1) e USING (o_orderkey)
LEFT JOIN (SELECT l_orderkey AS o_orderkey, min(l_linenumber) AS ch, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY 1) k USING (o_orderkey)
LEFT JOIN (SELECT l_orderkey AS o_orderkey, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS targets FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) t USING (o_orderkey)
WHERE coalesce(e.ch, k.ch) <= 4"""


def _entity_states(spark: SparkSession, d: str) -> DataFrame:
    """A customer found by an alias is the character, its orders are the states, their lines events and evidence."""
    c, o, lines = (table(spark, d, t) for t in ("customer", "orders", "lineitem"))
    who = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.array(F.concat(F.lit("alias-"), F.col("c_custkey").cast("string"))).alias("aliases"))
    related = c.select(F.col("c_custkey").alias("src"), F.lit("RELATED_TO").alias("type"), (F.col("c_custkey") + 1).alias("dst"), F.lit("next").alias("description"))
    key = F.col("l_orderkey").alias("state")
    return state.entity_history(
        who, related, o.select(F.col("o_custkey").alias("character"), F.col("o_orderkey").alias("state")),
        o.select(F.col("o_orderkey").alias("state"), F.col("o_orderstatus").alias("name"), F.col("o_orderpriority").alias("description")),
        lines.where("l_linenumber > 2").select(key, F.col("l_linenumber").alias("chapter")),
        lines.select(key, F.col("l_linenumber").alias("chapter"), F.col("l_returnflag").alias("text")),
        lines.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(key, F.col("p_brand").alias("target")),
        "alias-7", up_to=4,
    )


@query(_ENTITY_STATES)
def entity_state_history(spark: SparkSession, d: str) -> DataFrame:
    found = _entity_states(spark, d)
    names = F.array_join(F.transform("related", lambda r: r["name"]), ",")
    return found.select("character", names.alias("related"), "content", "source_desc", "chapter", F.array_join("targets", ",").alias("targets"), F.size("evidence").cast("long").alias("n_evidence"))


@query(f"""SELECT chapter || ': ' || content || ' (' || source_desc || ')' || CASE WHEN targets <> '' THEN ' [about: ' || replace(targets, ',', ', ') || ']' ELSE '' END
|| CASE WHEN related <> '' THEN ' [with: ' || replace(related, ',', ' (RELATED_TO), ') || ' (RELATED_TO)]' ELSE '' END AS line FROM ({_ENTITY_STATES})""")
def state_lines(spark: SparkSession, d: str) -> DataFrame:
    """The same history as lines of text."""
    return _entity_states(spark, d).select(state.format_state(F.col("chapter"), F.col("content"), F.col("source_desc"), F.col("targets"), F.col("related")).alias("line"))


@query(f"SELECT user_id, event_type, event_id, chapter FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY chapter DESC, event_id DESC) AS n FROM ({_EV})) WHERE n = 1")
def state_asof(spark: SparkSession, d: str) -> DataFrame:
    return state.as_of(_states(spark, d), ["user_id", "event_type"], "chapter", "event_id").select("user_id", "event_type", "event_id", "chapter")


@query("SELECT e.user_id AS state, coalesce(min(e.event_id), min(o.o_custkey)) AS est FROM events e LEFT JOIN orders o ON o.o_custkey = e.user_id GROUP BY e.user_id")
def state_established(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(F.col("user_id").alias("state"), F.col("event_id").alias("chapter"))
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("state"), F.col("o_custkey").alias("chapter"))
    return state.established(events, events, orders)


@query(f"SELECT chapter, n FROM (SELECT chapter, count(*) AS n FROM ({_EV}) GROUP BY chapter ORDER BY chapter DESC LIMIT 3)")
def recent_window(spark: SparkSession, d: str) -> DataFrame:
    return state.recent(_states(spark, d).groupBy("chapter").agg(F.count("*").alias("n")), "chapter", 3)


# ---- text

SIZE, OVERLAP = 400, 50
_CHUNKS = f"""SELECT doc_id, CAST(i AS INTEGER) AS "index", substr(text, i * {SIZE - OVERLAP} + 1, {SIZE}) AS chunk, doc_id || ':' || i AS chunk_id
FROM (SELECT doc_id, text, unnest(range(CAST(greatest(1, ceil((length(text) - {OVERLAP}) / {SIZE - OVERLAP}.0)) AS BIGINT))) AS i FROM documents WHERE length(text) > 0)"""


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return text.chunk_ids(text.split_fixed(table(spark, d, "documents"), SIZE, OVERLAP))


@query(f'SELECT doc_id, "index", chunk FROM ({_CHUNKS})')
def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("doc_id", "index", "chunk")


FAILS = 17


def first_and_last(chunk: str) -> str:
    """A stand-in for a language model: the first and the last word, in broken JSON; some chunks always fail."""
    if len(chunk) % FAILS == 0:
        raise OSError("no answer")
    words = chunk.split(" ")
    a, b = (json.dumps("w:" + w, ensure_ascii=False) for w in (words[0], words[-1]))
    noise = "{'id': '2', 'label': 'Noise',}}"
    return f"Here: {{'nodes': [{{'id': 0, label: First, 'properties': {{'name': {a}, 'mood': None}}}} {{'id': 1, 'label': 'Last', 'properties': {{'name': {b}}}}}, {noise}], 'relationships': [{{'type': 'ENDS_WITH', 'start_node_id': '0', 'end_node_id': '1'"


@query(f"""WITH c AS ({_CHUNKS}), w AS (SELECT 'w:' || string_split(chunk, ' ')[1] AS a, 'w:' || string_split(chunk, ' ')[-1] AS b FROM c WHERE length(chunk) % {FAILS} <> 0)
SELECT 'First' AS what, a, NULL AS b FROM w UNION SELECT 'Last', b, NULL FROM w UNION SELECT 'ENDS_WITH', a, b FROM w UNION SELECT 'failed', chunk_id, '2' FROM c WHERE length(chunk) % {FAILS} = 0 UNION SELECT 'node NOT_IN_SCHEMA', CAST(count(*) AS VARCHAR), NULL FROM w""")
def build_graph_documents(spark: SparkSession, d: str) -> DataFrame:
    """All documents through chunks, answers, repair, pruning and merging; the second run asks again for what failed."""
    schema = GraphSchema((TypeRule("First", ("name",)), TypeRule("Last", ("name",))), (TypeRule("ENDS_WITH"),), (("First", "ENDS_WITH", "Last"),), additional_nodes=False)
    answers = f"{shared_dir(spark)}/answers-{uuid.uuid4().hex}"
    again = lambda: build.build_graph(table(spark, d, "documents"), first_and_last, schema, SIZE, OVERLAP, approximate=False, answers=answers, attempts=1)
    again()
    g = again()
    names = g.nodes.select("id", "name")
    edges = g.edges.join(names.toDF("src", "a"), "src").join(names.toDF("dst", "b"), "dst").select(F.col("type").alias("what"), "a", "b")
    none = F.lit(None).cast("string").alias("b")
    rows = g.nodes.select(F.col("label").alias("what"), F.col("name").alias("a"), none).unionByName(edges)
    rows = rows.unionByName(g.failed.select(F.lit("failed").alias("what"), F.col("chunk_id").alias("a"), F.col("runs").cast("string").alias("b")))
    return rows.unionByName(g.pruned.where("what = 'node'").select(F.concat_ws(" ", "what", "reason").alias("what"), F.col("n").cast("string").alias("a"), none))


@query('SELECT doc_id, CAST(0 AS INTEGER) AS "index", text AS chunk FROM documents WHERE text IS NOT NULL')
def chunk_whole(spark: SparkSession, d: str) -> DataFrame:
    return text.split_whole(table(spark, d, "documents"))


def _moved_back(at: str) -> str:
    """A cut moved to behind the last blank before it, -1 if there is none; a cut beside a blank stays."""
    blank = f"({at} - 1 - length(regexp_extract(substr(t, 1, {at} - 1), '[^\\s]*$')))"
    return f"CASE WHEN {at} <= 0 OR {at} >= n OR regexp_matches(substr(t, {at}, 2), '\\s') THEN {at} WHEN {blank} > 0 THEN {blank} ELSE -1 END"


def _word_safe_sql() -> str:
    stop = lambda s: f"CASE WHEN {s} + {SIZE} >= n THEN n ELSE greatest({_moved_back(f'({s} + {SIZE})')}, CASE WHEN ({_moved_back(f'({s} + {SIZE})')}) > {s} THEN 0 ELSE {s} + {SIZE} END) END"
    nominal = f"(s + {SIZE} - {OVERLAP})"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, text AS t, length(text) AS n FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, t, n, 0 AS i, 0 AS s, CAST({stop("0")} AS BIGINT) AS e FROM d
UNION ALL SELECT doc_id, t, n, i, s, CAST({stop("s")} AS BIGINT) FROM (SELECT doc_id, t, n, i + 1 AS i, CAST(CASE WHEN ({_moved_back(nominal)}) > s THEN {_moved_back(nominal)} ELSE {nominal} END AS INTEGER) AS s FROM c WHERE e < n) WHERE s < n)
SELECT doc_id, CAST(i AS INTEGER) AS "index", substr(t, s + 1, e - s) AS chunk FROM c"""


@query(_word_safe_sql())
def chunk_word_safe(spark: SparkSession, d: str) -> DataFrame:
    """Slices in order, none of which cuts a word that fits."""
    return text.split_fixed(table(spark, d, "documents"), SIZE, OVERLAP, approximate=True)


@query(f'SELECT src, dst FROM (SELECT chunk_id AS src, lead(chunk_id) OVER (PARTITION BY doc_id ORDER BY "index") AS dst FROM ({_CHUNKS})) WHERE dst IS NOT NULL')
def chunk_next(spark: SparkSession, d: str) -> DataFrame:
    return text.next_chunks(_chunks(spark, d))


@query(f"WITH c AS ({_CHUNKS}) SELECT 'FROM_DOCUMENT' AS type, count(*) AS n FROM c UNION ALL SELECT 'NEXT_CHUNK', count(*) - count(DISTINCT doc_id) FROM c UNION ALL SELECT 'Chunk', count(*) FROM c UNION ALL SELECT 'Document', count(DISTINCT doc_id) FROM c")
def lexical_graph(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = text.lexical_graph(_chunks(spark, d))
    return introspect.type_counts(edges).unionByName(introspect.label_counts(nodes).withColumnRenamed("label", "type"))


@query(f"""SELECT doc_id, '[chapter:' || doc_id || ']' || chr(10) || string_agg('[C' || "index" || '] ' || chunk, ' ' ORDER BY "index") AS body FROM ({_CHUNKS}) GROUP BY doc_id""")
def marker_text(spark: SparkSession, d: str) -> DataFrame:
    return text.marker_text(_chunks(spark, d), "doc_id")


@query(f"""WITH c AS ({_CHUNKS}), f AS (SELECT 'fact:' || doc_id AS id, doc_id, unnest(['C0', 'C' || (n_chars % 4), 'C9;C1']) AS token FROM documents)
SELECT DISTINCT f.id AS src, c.chunk_id AS dst FROM f JOIN c ON c.doc_id = f.doc_id AND 'C' || c."index" = f.token""")
def evidence_link(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "documents").select(node_id("fact", "doc_id").alias("id"), F.col("doc_id").alias("chapter"), F.concat(F.lit("C0, C"), (F.col("n_chars") % 4).cast("string"), F.lit(" ,C9;C1")).alias("evidence_chunk"))
    edges, _ = text.evidence_links(facts, _chunks(spark, d).withColumnRenamed("doc_id", "chapter"))
    return edges


@query(r"""WITH RECURSIVE t AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') AS s FROM documents WHERE text <> ''),
w AS (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM t),
r AS (SELECT doc_id, i, 0 AS g, length(x) AS n FROM w WHERE i = 1 UNION ALL SELECT w.doc_id, w.i, CASE WHEN r.n + length(w.x) > 300 THEN r.g + 1 ELSE r.g END, CASE WHEN r.n + length(w.x) > 300 THEN length(w.x) ELSE r.n + length(w.x) END FROM r JOIN w ON w.doc_id = r.doc_id AND w.i = r.i + 1)
SELECT doc_id, g AS "index", string_agg(x, ' ' ORDER BY i) AS chunk FROM r JOIN w USING (doc_id, i) GROUP BY doc_id, g""")
def sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    return text.split_with(table(spark, d, "documents"), lambda t: text.group_sentences(text.sentences(t), 300))


# ---- pruning: customers are nodes with a segment, some without a balance; orders with odd ends

SCHEMA = prune.GraphSchema(
    nodes=(prune.TypeRule("Customer", ("name", "segment"), ("segment",)), prune.TypeRule("Nation", ("name",))),
    relationships=(prune.TypeRule("LIVES_IN", ("since",)),),
    patterns=(("Customer", "LIVES_IN", "Nation"),),
    additional_nodes=False, additional_relationships=False, additional_patterns=False,
)
_PN = """SELECT 'customer:' || c_custkey AS id, CASE c_custkey % 11 WHEN 0 THEN '' WHEN 1 THEN 'Stranger' ELSE 'Customer' END AS label, c_name AS name,
CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer"""
_KEPT = f"SELECT id FROM ({_PN}) WHERE label = 'Customer' AND segment IS NOT NULL"
_PE = "SELECT CASE WHEN c_custkey % 3 = 0 THEN 'nation:' || c_nationkey ELSE 'customer:' || c_custkey END AS src, CASE WHEN c_custkey % 7 = 0 THEN 'KNOWS' ELSE 'LIVES_IN' END AS type, CASE WHEN c_custkey % 3 = 0 THEN 'customer:' || c_custkey ELSE 'nation:' || c_nationkey END AS dst, 'customer:' || c_custkey AS c, 'nation:' || c_nationkey AS n FROM customer"


def _extracted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "customer")
    label = F.when(F.col("c_custkey") % 11 == 0, "").when(F.col("c_custkey") % 11 == 1, "Stranger").otherwise("Customer")
    props = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")), F.lit("balance"), F.col("c_acctbal").cast("string"))
    nodes = c.select(node_id("customer", "c_custkey").alias("id"), label.alias("label"), props.alias("props"))
    nations = table(spark, d, "nation").select(node_id("nation", "n_nationkey").alias("id"), F.lit("Nation").alias("label"), F.create_map(F.lit("name"), F.col("n_name")).alias("props"))
    a, b, back = node_id("customer", "c_custkey"), node_id("nation", "c_nationkey"), F.col("c_custkey") % 3 == 0
    edges = c.select(F.when(back, b).otherwise(a).alias("src"), F.when(F.col("c_custkey") % 7 == 0, "KNOWS").otherwise("LIVES_IN").alias("type"), F.when(back, a).otherwise(b).alias("dst"), F.create_map(F.lit("since"), F.lit("1999"), F.lit("mood"), F.lit("x")).alias("props"))
    return nodes.unionByName(nations), edges


@query(f"SELECT id, label, name, segment, CAST(2 AS INTEGER) AS n_props FROM ({_PN}) WHERE label = 'Customer' AND segment IS NOT NULL UNION ALL SELECT 'nation:' || n_nationkey, 'Nation', n_name, NULL, 1 FROM nation")
def prune_nodes(spark: SparkSession, d: str) -> DataFrame:
    kept, _ = prune.prune_nodes(_extracted(spark, d)[0], SCHEMA)
    return kept.select("id", "label", F.col("props")["name"].alias("name"), F.try_element_at("props", F.lit("segment")).alias("segment"), F.size("props").alias("n_props"))


@query(f"SELECT c AS src, type, n AS dst, src <> c AS turned, '1999' AS since FROM ({_PE}) WHERE type = 'LIVES_IN' AND c IN ({_KEPT})")
def prune_rels_reverse(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _extracted(spark, d)
    kept, _ = prune.prune_edges(edges, prune.prune_nodes(nodes, SCHEMA)[0], SCHEMA)
    return kept.select("src", "type", "dst", "turned", F.array_join(F.map_values("props"), ",").alias("since"))


@query(f"""SELECT 'node' AS what, reason, count(*) AS n FROM (SELECT CASE WHEN label = '' THEN 'MISSING_LABEL' WHEN label = 'Stranger' THEN 'NOT_IN_SCHEMA' ELSE 'MISSING_REQUIRED_PROPERTY' END AS reason FROM ({_PN}) WHERE id NOT IN ({_KEPT})) GROUP BY reason
UNION ALL SELECT 'relationship', reason, count(*) FROM (SELECT CASE WHEN c NOT IN ({_KEPT}) THEN 'INVALID_START_OR_END_NODE' WHEN type = 'KNOWS' THEN 'NOT_IN_SCHEMA' END AS reason FROM ({_PE})) WHERE reason IS NOT NULL GROUP BY reason""")
def prune_stats(spark: SparkSession, d: str) -> DataFrame:
    return prune.prune_graph(*_extracted(spark, d), SCHEMA)[2]


@query(f"SELECT label, count(*) AS n, sum(has) AS with_balance FROM (SELECT label, CASE WHEN label = 'Stranger' THEN 1 ELSE 0 END AS has FROM ({_PN}) WHERE label = 'Stranger' OR label = 'Customer' AND segment IS NOT NULL UNION ALL SELECT 'Nation', 0 FROM nation) GROUP BY label")
def prune_lexical(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of a lexical label pass unchecked, with all their properties."""
    kept, _ = prune.prune_nodes(_extracted(spark, d)[0], SCHEMA, lexical=("Stranger",))
    return kept.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.map_contains_key("props", "balance").cast("long")).alias("with_balance"))


@query(f"SELECT 'Customer' AS name, 'balance' AS property, count(*) AS n FROM ({_PN}) WHERE label = 'Customer' UNION ALL SELECT 'LIVES_IN', 'mood', count(*) FROM ({_PE}) WHERE type = 'LIVES_IN'")
def prune_properties(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _extracted(spark, d)
    return prune.pruned_properties(nodes, SCHEMA).unionByName(prune.pruned_properties(edges, SCHEMA, nodes=False))


# ---- resolution


def _parts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(node_id("part", "p_partkey").alias("id"), F.col("p_brand").alias("label"), F.col("p_name").alias("name"))


_P = "SELECT 'part:' || p_partkey AS id, p_brand AS label, p_name AS name FROM part"


@query(f"SELECT id, min(id) OVER (PARTITION BY label, name) AS canonical FROM ({_P}) WHERE name IS NOT NULL")
def resolve_exact(spark: SparkSession, d: str) -> DataFrame:
    return resolve.exact_groups(_parts(spark, d))


@query(r"SELECT id, min(id) OVER (PARTITION BY label, k) AS canonical FROM (SELECT id, label, regexp_replace(name, '[\s<>《》「」『』【】()\[\]“”‘’""'']', '', 'g') AS k FROM (SELECT 'part:' || p_partkey AS id, p_type AS label, '【' || substr(p_name, 1, 6) || ' }' AS name FROM part)) WHERE k <> ''")
def resolve_normalized(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return resolve.normalised_groups(p.select(node_id("part", "p_partkey").alias("id"), F.col("p_type").alias("label"), F.concat(F.lit("【"), F.substring("p_name", 1, 6), F.lit(" }")).alias("name")))


_LEV = """SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey
WHERE 1 - levenshtein(a.c_name, b.c_name) / greatest(length(a.c_name), length(b.c_name), 1.0) >= 0.94"""


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"), F.col("c_name").alias("name"), F.col("c_nationkey"))


@query(_LEV)
def resolve_levenshtein(spark: SparkSession, d: str) -> DataFrame:
    return resolve.levenshtein_pairs(_customers(spark, d), "name", 0.94, F.col("c_nationkey"))


@query(f"""WITH RECURSIVE p AS ({_LEV}), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r(id, m) AS (SELECT a, a FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.m = e.a)
SELECT id, min(m) AS canonical FROM r GROUP BY id""")
def resolve_components(spark: SparkSession, d: str) -> DataFrame:
    return resolve.components(resolve.levenshtein_links(_customers(spark, d), "name", 0.94, F.col("c_nationkey")))


@query("SELECT count(*) AS nodes_to_resolve, count(DISTINCT (label, name)) AS created_nodes FROM (" + _P + ")")
def resolve_stats(spark: SparkSession, d: str) -> DataFrame:
    return resolve.stats(resolve.exact_groups(_parts(spark, d)))


@query(None)
def resolve_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of a nation with like names, all names of a nation against each other."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("label"), F.col("s_name").alias("name"))
    return resolve.fuzzy_pairs(s, threshold=0.9)


@query("SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.45")
def resolve_vectors_all(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all labels against each other."""
    return resolve.vector_pairs(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit("vector").alias("label"), "embedding"), threshold=0.45)


@query("""WITH g AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_type) AS c FROM part)
SELECT DISTINCT 'part:' || g.c AS src, 'SUPPLIED_BY' AS type, 'supplier:' || l_suppkey AS dst FROM lineitem JOIN g ON g.p_partkey = l_partkey""")
def resolve_merge_edges(spark: SparkSession, d: str) -> DataFrame:
    g = relational_graph(spark, d, ("SUPPLIED_BY",), ("part", "supplier"))
    return resolve.apply_groups(g.nodes, g.edges.select("src", "type", "dst"), _part_groups(spark, d))[1]


def _part_groups(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    least = p.groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("c"))
    return p.join(least, ["p_brand", "p_type"]).select(node_id("part", "p_partkey").alias("id"), node_id("part", "c").alias("canonical"))


@query("""SELECT 'part:' || min(p_partkey) AS id, count(DISTINCT p_name) AS n_names, string_agg(DISTINCT p_name, '|' ORDER BY p_name) AS names FROM part GROUP BY p_brand, p_type""")
def resolve_merge_nodes(spark: SparkSession, d: str) -> DataFrame:
    g = relational_graph(spark, d, ("SUPPLIED_BY",), ("part",))
    merged = resolve.apply_groups(g.nodes, g.edges, _part_groups(spark, d), ("name",))[0]
    return merged.select("id", F.size("name").cast("long").alias("n_names"), F.array_join("name", "|").alias("names"))


@query("""SELECT id, min(id) OVER (PARTITION BY k) AS canonical FROM (SELECT 'part:' || p_partkey AS id, replace(p_name, ' ', '') AS k FROM part) UNION ALL SELECT id, min(id) OVER (PARTITION BY s_name) FROM (SELECT 'supplier:' || s_suppkey AS id, s_name FROM supplier)""")
def resolve_route(spark: SparkSession, d: str) -> DataFrame:
    """Parts by normalised names, suppliers by exact ones, others not at all."""
    nodes = relational_graph(spark, d, ("LOCATED_IN",), ("part", "supplier", "nation")).nodes
    return resolve.route(nodes, {("part",): resolve.normalised_groups, ("supplier",): resolve.exact_groups})


@query("SELECT p_brand, string_agg(DISTINCT p_type, ' / ' ORDER BY p_type) AS description FROM part GROUP BY p_brand")
def resolve_collapse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand").agg(resolve.collapse(F.collect_list("p_type")).alias("description"))


@query("SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.35")
def resolve_vectors(spark: SparkSession, d: str) -> DataFrame:
    return resolve.vector_pairs(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding"), threshold=0.35)


# ---- writers, introspection, history


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))


_MSG = "SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, role, text AS content FROM conversations"


@query(f"{_MSG} UNION ALL SELECT '1', coalesce(max(turn), -1) + 1, 'user', 'one more' FROM conversations WHERE conv_id = 1")
def message_append(spark: SparkSession, d: str) -> DataFrame:
    return append_message(_messages(spark, d), "1", "user", "one more")


@query(f"SELECT * FROM ({_MSG}) WHERE session_id <> '2'")
def message_clear(spark: SparkSession, d: str) -> DataFrame:
    return clear(_messages(spark, d), "2")


@query("SELECT event_type AS step, count(*) AS calls, CAST(sum(event_id) AS BIGINT) AS prompt_tokens, CAST(sum(user_id) AS BIGINT) AS answer_tokens FROM events GROUP BY event_type")
def token_sums(spark: SparkSession, d: str) -> DataFrame:
    return build.token_report(table(spark, d, "events").select(F.col("event_type").alias("step"), F.col("event_id").alias("prompt_tokens"), F.col("user_id").alias("answer_tokens")))


@query("SELECT n_nationkey AS number, CASE WHEN n_regionkey = 1 THEN 'new of ' || n_name ELSE n_name END AS summary FROM nation")
def chapter_summaries(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("number"), F.col("n_name").alias("summary"), "n_regionkey")
    return build.set_summaries(n.drop("n_regionkey"), n.where("n_regionkey = 1").select("number", F.concat(F.lit("new of "), "summary").alias("summary")))


@query("SELECT n_nationkey AS k, n_name AS name, n_regionkey AS region FROM nation")
def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A stream of files written by micro-batch into a table, twice: the replay changes nothing."""
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows.write.parquet(f"{base}/in")
    for run in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        upsert_stream(stream, f"{base}/out", ["k"], f"{base}/checkpoint{run}").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'late' ELSE o_orderstatus END AS status, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS run FROM orders")
def merge_on_read(spark: SparkSession, d: str) -> DataFrame:
    """Orders, then new states of a third of them, as two batches of a table that merges when it is read; the first comes twice."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.lit(0).alias("run"))
    merged = MergedTable(spark, f"{shared_dir(spark)}/merged-{uuid.uuid4().hex}", o.schema, ("k",))
    merged.write(o, "orders", 0)
    merged.compact()
    merged.write(o.where("k % 3 = 0").withColumn("status", F.lit("late")).withColumn("run", F.lit(1)), "orders", 1)
    merged.write(o, "orders", 0)
    return merged.read()


@query("SELECT l_partkey AS src, l_suppkey AS dst, arg_max(l_quantity, l_orderkey * 10 + l_linenumber + l_quantity / 1000.0) AS quantity FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier) AND l_partkey IN (SELECT p_partkey FROM part) GROUP BY l_partkey, l_suppkey")
def edge_upsert_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(node_id("part", "l_partkey").alias("src"), F.lit("SUPPLIED_BY").alias("type"), node_id("supplier", "l_suppkey").alias("dst"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_quantity").alias("quantity"))
    merged = writers.merge_edges(rows, relational_graph(spark, d, ("SUPPLIED_BY",), ("part", "supplier")).nodes)
    key = lambda c: F.element_at(F.split(c, ":"), 2).cast("long").alias(c)
    return merged.select(key("src"), key("dst"), "quantity")


@query("SELECT what, name, n FROM (SELECT 'node' AS what, 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'node', 'supplier', count(*) FROM supplier UNION ALL SELECT 'node', 'nation', count(*) FROM nation UNION ALL SELECT 'node', 'region', count(*) FROM region UNION ALL SELECT 'relationship', 'IN_NATION', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'relationship', 'LOCATED_IN', count(*) FROM nation)")
def write_statistics(spark: SparkSession, d: str) -> DataFrame:
    g = _places(spark, d)
    return writers.statistics(g.nodes, g.edges)


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE c_name END AS name FROM customer UNION ALL SELECT -1, 'added'")
def table_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    new = old.where("id % 4 = 0").select("id", F.lit("new").alias("name")).unionByName(spark.sql("SELECT -1L AS id, 'added' AS name"))
    return writers.upsert(old, new, ["id"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS property, '{t}' AS type, count(DISTINCT {c}) AS n_distinct, CAST(min({c}) AS VARCHAR) AS least, CAST(max({c}) AS VARCHAR) AS greatest FROM orders" for c, t in (("o_orderkey", "INTEGER"), ("o_custkey", "INTEGER"), ("o_orderstatus", "STRING"), ("o_orderpriority", "STRING"))))
def schema_profile(spark: SparkSession, d: str) -> DataFrame:
    return introspect.profile(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))


#: table -> (column, kind)
PROFILED = {
    "customer": (("c_custkey", "INTEGER"), ("c_name", "STRING"), ("c_nationkey", "INTEGER"), ("c_acctbal", "FLOAT"), ("c_mktsegment", "STRING")),
    "orders": (("o_orderkey", "INTEGER"), ("o_custkey", "INTEGER"), ("o_orderstatus", "STRING"), ("o_totalprice", "FLOAT"), ("o_orderpriority", "STRING")),
    "events": (("event_id", "INTEGER"), ("user_id", "INTEGER"), ("event_type", "STRING"), ("value", "FLOAT"), ("props", "STRING")),
    "documents": (("doc_id", "INTEGER"), ("text", "STRING"), ("lang", "STRING"), ("source", "STRING"), ("n_chars", "INTEGER")),
    "pages": (("page_id", "INTEGER"), ("url", "STRING"), ("html", "STRING")),
    "conversations": (("conv_id", "INTEGER"), ("turn", "INTEGER"), ("role", "STRING"), ("text", "STRING")),
    "lineitem": (("l_orderkey", "INTEGER"), ("l_linenumber", "INTEGER"), ("l_quantity", "FLOAT"), ("l_tax", "FLOAT"), ("l_returnflag", "STRING")),
}


def _profile_sql(t: str, c: str, kind: str) -> str:
    ends = {"STRING": "substr({c}, 1, 50)", "FLOAT": "CAST(round({c} * 100) AS BIGINT)", "INTEGER": "{c}"}[kind].format(c=c)
    options = f"CASE WHEN count(DISTINCT {c}) <= 10 THEN array_to_string(list_sort(list(DISTINCT substr({c}, 1, 50)) FILTER ({c} IS NOT NULL)), '|') END" if kind == "STRING" else "CAST(NULL AS VARCHAR)"
    return f"""SELECT '{t}' AS label, '{c}' AS property, '{kind}' AS type, count(*) AS n, count(*) - count({c}) AS n_null, CASE WHEN count(*) < 10000 THEN count(DISTINCT {c}) END AS n_distinct,
CAST(min({ends}) AS VARCHAR) AS least, CAST(max({ends}) AS VARCHAR) AS greatest, {options} AS options FROM {t}"""


@query(" UNION ALL ".join(_profile_sql(t, c, kind) for t, columns in PROFILED.items() for c, kind in columns))
def schema_profile_tables(spark: SparkSession, d: str) -> DataFrame:
    """Columns of seven tables; ``n_distinct`` only where it is exact, for the sketch's has no SQL (its error is tested)."""
    out = None
    for t, columns in PROFILED.items():
        part = sketches.profile(table(spark, d, t).select(*(c for c, _ in columns))).withColumn("label", F.lit(t))
        out = part if out is None else out.unionByName(part)
    end = lambda c: F.when(F.col("type") == "FLOAT", F.round(F.col(c).cast("double") * 100).cast("bigint").cast("string")).otherwise(F.col(c)).alias(c)
    return out.select("label", "property", "type", "n", "n_null", F.when(F.col("exact"), F.col("n_distinct")).alias("n_distinct"), end("least"), end("greatest"), F.array_join("options", "|").alias("options"))


@query("""SELECT event_type AS label, 'user' AS property, 'INTEGER' AS type, count(*) AS n, 0 AS n_null, CAST(min(user_id) AS VARCHAR) AS least, CAST(max(user_id) AS VARCHAR) AS greatest FROM events GROUP BY event_type
UNION ALL SELECT event_type, 'day', 'STRING', count(*), 0, CAST(min(CAST(ts AS DATE)) AS VARCHAR), CAST(max(CAST(ts AS DATE)) AS VARCHAR) FROM events GROUP BY event_type""")
def relationship_properties(spark: SparkSession, d: str) -> DataFrame:
    """Events as relationships of their type, with a map of properties."""
    day = F.date_format("ts", "yyyy-MM-dd")
    edges = table(spark, d, "events").select(F.col("event_type").alias("label"), F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("day"), day).alias("props"))
    return sketches.property_profile(edges, "label").select("label", "property", "type", "n", "n_null", "least", "greatest")


@query("SELECT 'embedding' AS property, min(len(embedding)) AS least, max(len(embedding)) AS greatest FROM embeddings")
def schema_profile_lists(spark: SparkSession, d: str) -> DataFrame:
    return introspect.profile(table(spark, d, "embeddings").select("embedding")).select("property", F.col("least").cast("long").alias("least"), F.col("greatest").cast("long").alias("greatest"))


@query("SELECT DISTINCT substr(c_mktsegment, 1, 50) AS value FROM customer WHERE c_mktsegment IS NOT NULL")
def schema_options(spark: SparkSession, d: str) -> DataFrame:
    return introspect.text_options(table(spark, d, "customer"), "c_mktsegment")


@query(f"SELECT DISTINCT label, unnest(['name', 'segment', 'balance']) AS property FROM ({_PN}) UNION SELECT 'Nation', 'name' FROM nation")
def property_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return introspect.property_catalogue(_extracted(spark, d)[0])


@query("SELECT vec_id, embedding IS NULL AS hidden, label FROM (SELECT vec_id, CASE WHEN len(embedding) < 64 THEN embedding END AS embedding, label FROM embeddings)")
def hide_long_lists(spark: SparkSession, d: str) -> DataFrame:
    return introspect.without_long_lists(table(spark, d, "embeddings"), 64).select("vec_id", F.col("embedding").isNull().alias("hidden"), "label")


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def message_last_n(spark: SparkSession, d: str) -> DataFrame:
    return last_messages(table(spark, d, "conversations"), 3, "conv_id", "turn")


@query("SELECT text, \"index\", uid FROM (SELECT coalesce(text, '') AS text, CAST(coalesce(turn, -1) AS BIGINT) AS \"index\", conv_id || '/' || turn AS uid FROM conversations)")
def chunk_reader(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text", F.col("turn").alias("index"))
    return readers.read_chunks(rows)


@query("SELECT 'regions' AS tool_name, '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS content FROM region UNION ALL SELECT 'nations', '{\"n\":' || count(*) || '}' FROM nation")
def tool_union(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.operators.answers import Tool, ToolsRetriever

    tools = [Tool("regions", "all regions", lambda: table(spark, d, "region").select("r_regionkey", "r_name")), Tool("nations", "how many nations", lambda: table(spark, d, "nation").agg(F.count("*").alias("n")))]
    return ToolsRetriever(spark, lambda q, t: [(x.name, {}) for x in t], tools).search("regions and nations")[0]


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def text_to_sql(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.operators.answers import TextToSql

    table(spark, d, "nation").createOrReplaceTempView("nation")
    model = lambda prompt: "```sql\nSELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1;\n```"
    return TextToSql(spark, model).search("nations of region 1")[0]


@query("SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return windowed_counts(table(spark, d, "events")).select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
