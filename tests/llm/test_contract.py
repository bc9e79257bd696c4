import os

import oracle
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import queries
from graphloom.llm.simhash import duplicate_groups

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no supplied tables")

COLUMNS = {
    "op1_chat_format": "conv_id:bigint n_turns:bigint turns_sha256:string loss_chars:bigint loss_sha256:string formatted_chars:bigint",
    "op2_ann_ivfpq": "query_id:bigint rank:int vec_id:bigint score:double",
    "op3_url_filters": "page_id:bigint host:string path:string rule:string verdict:string",
    "op4_substring_dedup": "doc_id:bigint n_words:bigint n_removed:bigint kept_sha256:string",
    "op5_language_id": "doc_id:bigint held_out:boolean lang_pred:string score:double",
    "op6_simhash": "doc_id:bigint fingerprint:string component_id:bigint",
    "op7_license_scan": "doc_id:bigint n_sentences:bigint sentence_ids:string licenses:string",
    "op8_toxicity": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op9_decontaminate": "doc_id:bigint n_words:bigint n_hit:bigint n_items:bigint items_sha256:string contaminated:boolean",
    "op10_best_fit_packing": "doc_id:bigint piece:int start:bigint length:bigint ids_crc32:bigint sequence_id:bigint offset:bigint",
    "op11_cross_tokenizer_alignment": "doc_id:bigint n_a:bigint n_b:bigint n_groups:bigint n_links:bigint n_best:bigint count_sum:bigint groups_sha256:string",
    "op12_importance_resampling": "doc_id:bigint n_features:bigint weight:bigint score:bigint rank:bigint",
    "op13_suffix_dedup": "doc_id:bigint n_bytes:bigint n_removed:bigint n_spans:bigint kept_sha256:string",
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    frame = queries.QUERIES[name](spark, DATA)
    assert " ".join(f"{n}:{t}" for n, t in frame.dtypes) == COLUMNS[name]
    if name in queries.ORACLE_SQL:
        assert oracle.found(frame) == oracle.expected(oracle.connect(DATA), queries.ORACLE_SQL[name])
    else:
        assert frame.count() > 0


def test_native_operators_have_no_python(spark):
    for name in ("op1_chat_format", "op7_license_scan", "op9_decontaminate"):
        plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    lang = queries.op5_language_id(spark, folder).where("held_out").join(docs, "doc_id")
    assert lang.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    toxic = queries.op8_toxicity(spark, folder).where("held_out").join(labels, "doc_id")
    assert toxic.agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int"))).first()[0] > 0.9


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 120")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, kept, DATA).cache()
        assert made.dtypes == docs.dtypes, name
        assert ids(made) <= ids(kept), name
        if name == "simhash_near_dedup":
            groups = {r["doc_id"]: r["component"] for r in duplicate_groups(kept).collect()}
            assert ids(made) == {d for d, c in groups.items() if d == c}
        kept = made
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, DATA)
    assert ids(packed) == ids(kept)
    assert len(ids(kept)) > 80


def test_stages_with_odd_rows(spark):
    """Null ids and texts, repeated rows, extra columns with the stages' own names, empty tables."""
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, passage, "en", "s", 1), (1, passage, "en", "s", 1), (2, passage + " own words here", None, None, None), (None, passage, "en", "s", 1), (None, None, None, None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (5, "idiot moron scum " * 9000, "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("_toxicity", "_gone", "component", "kept", "row", "k", "o", "spans", "a.b"):
        docs = docs.withColumn(name, F.lit("extra"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, DATA)
        assert made.dtypes == docs.dtypes, name
        got = made.collect()
        assert all(r["kept"] == "extra" and r["a.b"] == "extra" for r in got)
        assert sum(r["doc_id"] is None for r in got) == 2, name
        assert stage(spark, docs.limit(0), DATA).count() == 0
        if name == "substring_dedup":
            assert {r["doc_id"]: r["text"] for r in got if r["doc_id"] == 2} == {2: "own words here"}
            assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() >= len(rows)
