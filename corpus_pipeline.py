"""From raw documents to packed training sequences: five operators of ``graphloom.llm`` in a row.

Each stage works on all that its predecessor kept. Filtering stages return the columns of
``documents``; rows with a null id are never taken for copies or contaminated. Rows that share an
id are one document to the stages that decide by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import cut, held_out, table
from graphloom.llm.decontaminate import decontaminate
from graphloom.llm.packing import pack
from graphloom.llm.simhash import near_duplicates
from graphloom.llm.substring_dedup import dedup_substrings
from graphloom.llm.toxicity import THRESHOLD, fit_toxicity, score_toxicity

#: Of run()'s rows: trained scores, sketches and tokenizers have no SQL.
ORACLE_SQL = None


def _new_name(docs: DataFrame, name: str) -> str:
    return name if name not in docs.columns else _new_name(docs, f"{name}_")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose id is not among those of ``gone``; null ids stay."""
    mark = _new_name(docs, "_gone")
    ids = gone.select(F.col("doc_id").alias(mark)).distinct()
    return docs.join(ids, docs["doc_id"] == F.col(mark), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold; learns from labelled rows that are not held out."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    mark = _new_name(docs, "_toxicity")
    return score_toxicity(docs, model, out=mark).where(F.col(mark).getField("score") < THRESHOLD).drop(mark)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group whose SimHashes link (operator 6, as its contract words it) the document of smallest id."""
    return _without(docs, near_duplicates(docs).where("doc_id <> component"))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 20 words and more that stood earlier; n_chars follows."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    found = dedup_substrings(docs, keep=rest)
    made = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return found.select(*(made.get(c, F.col("_row").getField(c) if c in rest else F.col("doc_id")).alias(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with under a twentieth of their words in benchmark passages."""
    return _without(docs, decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
