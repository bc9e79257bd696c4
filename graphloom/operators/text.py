"""Chunking, lexical graphs, markers and evidence links."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import ship


def _check(size: int, overlap: int) -> None:
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("size must be positive and overlap in 0..size-1")


def split_fixed(docs: DataFrame, size: int = 4000, overlap: int = 200, key: str = "doc_id", text: str = "text", approximate: bool = False) -> DataFrame:
    """key, index, chunk: slices of ``size`` characters every ``size - overlap``; native.

    ``approximate``: ends and starts move back to a blank, so that no word is cut (Arrow batches).
    """
    _check(size, overlap)
    if approximate:
        return split_with(docs, lambda t: word_safe_chunks(t, size, overlap), key, text)
    n, step = F.char_length(text), size - overlap
    count = F.greatest(F.lit(1), F.ceil((n - overlap) / step)).cast("int")
    starts = F.sequence(F.lit(0), count - 1)
    cut = docs.where(n > 0).select(key, F.col(text).alias("_t"), F.posexplode(starts).alias("index", "_i"))
    return cut.select(key, "index", F.substring(F.col("_t"), F.col("_i") * step + 1, F.lit(size)).alias("chunk"))


def split_whole(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, index, chunk: each text, empty ones too, as one chunk; none for null."""
    return docs.where(F.col(text).isNotNull()).select(key, F.lit(0).alias("index"), F.col(text).alias("chunk"))


def word_safe_chunks(text: str, size: int, overlap: int) -> list[str]:
    """Slices whose ends move back to the last blank, unless that leaves nothing."""
    _check(size, overlap)
    out, start, n = [], 0, len(text)

    def back(at: int) -> int:
        if at <= 0 or at >= n or text[at].isspace() or text[at - 1].isspace():
            return at
        p = at - 1
        while p > 0 and not text[p - 1].isspace():
            p -= 1
        return p if p > 0 else -1

    while start < n:
        end = min(start + size, n)
        if end < n:
            moved = back(end)
            end = moved if moved > start else end
        out.append(text[start:end])
        if end >= n:
            break
        nominal = start + size - overlap
        moved = back(nominal)
        start = moved if moved > start else nominal
    return out


def group_sentences(sentences: list[str], size: int, overlap: int = 0) -> list[str]:
    """Runs of whole sentences whose lengths add up to ``size`` at most, or single longer ones.

    Blanks between sentences are free, blank sentences do not count. The next run begins with the
    longest tail of the last one within ``overlap`` and goes on by one sentence at least. Runs are
    found by search in the running totals.
    """
    kept = [s for s in map(str.strip, sentences) if s]
    total = [0, *accumulate(map(len, kept))]
    runs, begin, end = [], 0, 0
    while end < len(kept):
        end = max(end + 1, bisect_right(total, total[begin] + size) - 1)
        runs.append(" ".join(kept[begin:end]))
        begin = bisect_left(total, total[end] - overlap)
    return runs


def sentences(text: str) -> list[str]:
    """The default sentence splitter: an end mark and a blank; any analyser can take its place."""
    import re

    return [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s]


def split_with(docs: DataFrame, splitter: Callable[[str], list[str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, index, chunk by any splitter of a text, in Arrow batches."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, c) for k, t in zip(b[key], b[text], strict=True) if t for i, c in enumerate(splitter(t))]
            yield pd.DataFrame(rows, columns=[key, "index", "chunk"])

    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, index int, chunk string")


@dataclass(frozen=True)
class LexicalNames:
    document: str = "Document"
    chunk: str = "Chunk"
    from_document: str = "FROM_DOCUMENT"
    next_chunk: str = "NEXT_CHUNK"
    from_chunk: str = "FROM_CHUNK"


def chunk_ids(chunks: DataFrame, doc: str = "doc_id") -> DataFrame:
    return chunks.withColumn("chunk_id", F.concat(F.col(doc).cast("string"), F.lit(":"), F.col("index").cast("string")))


def next_chunks(chunks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """src, dst of consecutive chunks of a document."""
    follow = F.lead("chunk_id").over(Window.partitionBy(doc).orderBy("index"))
    return chunks.select(F.col("chunk_id").alias("src"), follow.alias("dst")).where("dst is not null")


def lexical_graph(chunks: DataFrame, doc: str = "doc_id", names: LexicalNames = LexicalNames(), with_document: bool = True) -> tuple[DataFrame, DataFrame]:
    """nodes (id, label) and edges (src, type, dst) of documents and their chunks."""
    nodes = chunks.select(F.col("chunk_id").alias("id"), F.lit(names.chunk).alias("label"))
    edges = next_chunks(chunks, doc).select("src", F.lit(names.next_chunk).alias("type"), "dst")
    if with_document:
        nodes = nodes.unionByName(chunks.select(F.col(doc).cast("string").alias("id"), F.lit(names.document).alias("label")).distinct())
        edges = edges.unionByName(chunks.select(F.col("chunk_id").alias("src"), F.lit(names.from_document).alias("type"), F.col(doc).cast("string").alias("dst")))
    return nodes, edges


def from_chunk_edges(entities: DataFrame, names: LexicalNames = LexicalNames()) -> DataFrame:
    """src (entity), type, dst (chunk) from entities with their chunk."""
    return entities.select(F.col("id").alias("src"), F.lit(names.from_chunk).alias("type"), F.col("chunk_id").alias("dst"))


def marker_text(chunks: DataFrame, chapter: str, text: str = "chunk") -> DataFrame:
    """chapter, body: ``[chapter:N]`` and the chunks marked ``[C0] ...`` in order."""
    part = F.struct(F.col("index").alias("i"), F.concat(F.lit("[C"), F.col("index").cast("string"), F.lit("] "), F.col(text)).alias("t"))
    listed = chunks.groupBy(chapter).agg(F.array_sort(F.collect_list(part)).alias("p"))
    return listed.select(chapter, F.concat(F.lit("[chapter:"), F.col(chapter).cast("string"), F.lit("]\n"), F.array_join(F.transform("p", lambda x: x.t), " ")).alias("body"))


def evidence_links(facts: DataFrame, chunks: DataFrame, evidence: str = "evidence_chunk") -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst) from facts (id, chapter, evidence like ``C3, C4``) to chunks of the chapter,
    and the tokens that name no chunk (id, token)."""
    tokens = facts.where(F.col(evidence).isNotNull()).select("id", "chapter", F.explode(F.transform(F.split(evidence, ","), lambda t: F.trim(t))).alias("token"))
    good = tokens.where(F.col("token").rlike("^C[0-9]+$")).withColumn("index", F.expr("try_cast(substring(token, 2) AS INT)"))
    linked = good.join(chunks.select("chapter", "index", "chunk_id"), ["chapter", "index"])
    edges = linked.select(F.col("id").alias("src"), F.col("chunk_id").alias("dst")).distinct()
    rejects = tokens.join(linked.select("id", "token").distinct(), ["id", "token"], "left_anti").select("id", "token")
    return edges, rejects


def embed(rows: DataFrame, embedder: Callable[[list[str]], list[list[float]]], text: str = "chunk", out: str = "embedding") -> DataFrame:
    """Vectors of texts, a batch at a time."""

    ship(rows.sparkSession)

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(embedder([t or "" for t in texts]))

    return rows.withColumn(out, run(text))


def hash_embedder(dim: int = 16) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic stand-in: signed counts of hashed tokens, at unit length."""

    def run(texts: list[str]) -> list[list[float]]:
        import zlib

        out = []
        for t in texts:
            v = [0.0] * dim
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1.0 if h >> 16 & 1 else -1.0
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else v)
        return out

    return run
