"""Readers: chunks, Markdown and PDF documents, JSON and YAML files."""

from __future__ import annotations

import json
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_chunks(chunks: DataFrame, with_embedding: bool = False) -> DataFrame:
    """text ("" if null), index (-1 if null), uid, in order of index; vectors are not read unless wanted."""
    uid = F.coalesce(F.col("id"), F.expr("uuid()")) if "id" in chunks.columns else F.expr("uuid()")
    out = [F.coalesce("text", F.lit("")).alias("text"), F.coalesce("index", F.lit(-1)).alias("index"), uid.alias("uid")]
    return chunks.select(*out, *(["embedding"] if with_embedding else [])).orderBy("index", "uid")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """path, text, document_type; the text is not parsed."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.lit("markdown").alias("document_type"))


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """path, text (pages joined by line feeds), document_type; needs the optional pypdf on executors."""

    @F.pandas_udf("string")
    def pages(content: pd.Series) -> pd.Series:
        import io

        from pypdf import PdfReader

        return pd.Series(["\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(c)).pages) for c in content])

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", pages("content").alias("text"), F.lit("pdf").alias("document_type"))


def read_config(path: str) -> dict:
    """A JSON or YAML file on the driver, by its ending."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text)
    return json.loads(text)


def write_config(data: dict, path: str, overwrite: bool = False) -> None:
    if Path(path).exists() and not overwrite:
        raise FileExistsError(path)
    if path.endswith((".yaml", ".yml")):
        import yaml

        text = yaml.safe_dump(data, allow_unicode=True)
    else:
        text = json.dumps(data, ensure_ascii=False, indent=2)
    Path(path).write_text(text, encoding="utf-8")


def external_matches(matches: DataFrame, nodes: DataFrame, external: str, internal: str) -> DataFrame:
    """Nodes met by the ids of another store's hits, their score carried, best first."""
    return matches.select(F.col(external).alias(internal), "score").join(nodes, internal).orderBy(F.desc("score"), internal)
