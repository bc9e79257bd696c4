"""From documents to a pruned, resolved graph; answers of the model are a table."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import extraction, prune, resolve, text
from graphloom.sources.scratch import shared_dir
from graphloom.sources.writers import upsert


@dataclass(frozen=True)
class BuiltGraph:
    nodes: DataFrame
    edges: DataFrame
    chunks: DataFrame
    lexical_nodes: DataFrame
    lexical_edges: DataFrame
    pruned: DataFrame
    failed: DataFrame


def build_graph(
    docs: DataFrame,
    model: Callable[[str], str],
    schema: prune.GraphSchema,
    size: int = 4000,
    overlap: int = 200,
    embedder: Callable[[list[str]], list[list[float]]] | None = None,
    resolver: Callable[[DataFrame], DataFrame] | None = resolve.exact_groups,
    approximate: bool = True,
    answers: str | None = None,
    **how,
) -> BuiltGraph:
    """``docs``: doc_id, text. The resolver gets nodes with ``name``; None leaves nodes as they are.

    ``approximate``: chunks end at blanks; else all but the last have ``size`` characters. ``answers``: folder of
    the model's answers, so that a later call asks only for chunks that are new, changed or failed (else a new
    scratch folder); ``how``: waves, attempts, concurrency and waits of ``extraction.run``. Each chunk is asked once.
    """
    chunks = text.chunk_ids(text.split_fixed(docs, size, overlap, approximate=approximate))
    if embedder:
        chunks = text.embed(chunks, embedder)
    found = extraction.run(chunks, model, answers or f"{shared_dir(docs.sparkSession)}/answers-{uuid.uuid4().hex}", **how)
    found_nodes, found_edges = extraction.graph_of(found)
    origin = found_nodes.select("id", "chunk_id")
    nodes, edges, stats = prune.prune_graph(found_nodes.drop("chunk_id"), found_edges, schema)
    nodes = nodes.withColumn("name", F.try_element_at("props", F.lit("name")))
    if resolver:
        nodes, edges = resolve.apply_groups(nodes, edges.select("src", "type", "dst"), resolver(nodes))
    lexical_nodes, lexical_edges = text.lexical_graph(chunks)
    provenance = text.from_chunk_edges(origin.join(nodes.select("id"), "id", "left_semi"))
    return BuiltGraph(nodes, edges, chunks, lexical_nodes, lexical_edges.unionByName(provenance), stats, found.where("answer is null"))


def chapter_layer(chunks: DataFrame, chapter: str = "chapter") -> tuple[DataFrame, DataFrame]:
    """Chapter nodes, one a number, and IN_CHAPTER edges of chunks."""
    nodes = chunks.where(F.col(chapter).isNotNull()).select(F.col(chapter).alias("number")).distinct()
    edges = chunks.where(F.col(chapter).isNotNull()).select(F.col("chunk_id").alias("src"), F.lit("IN_CHAPTER").alias("type"), F.concat(F.lit("chapter:"), F.col(chapter).cast("string")).alias("dst"))
    return nodes, edges.distinct()


def set_summaries(chapters: DataFrame, summaries: DataFrame) -> DataFrame:
    """Chapters (number, summary) with new summaries in place of old ones."""
    return upsert(chapters, summaries.select("number", "summary"), ["number"])


def context_of(story: str | None, chapters: DataFrame, n: int = 3) -> str:
    """The story's summary and those of the last n chapters in order; empty ones are left out."""
    rows = chapters.where("summary is not null").orderBy(F.desc("number")).limit(n).collect()
    parts = [story or "", "\n".join(f"{r['number']}: {r['summary']}" for r in reversed(rows))]
    return "\n\n".join(p for p in parts if p)


def token_report(calls: DataFrame) -> DataFrame:
    """Sums of a log of model calls (step, prompt_tokens, answer_tokens)."""
    return calls.groupBy("step").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("answer_tokens").alias("answer_tokens"))
