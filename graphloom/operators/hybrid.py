"""Hybrid search: vector and full-text hits, each normalised by its best, fused by maximum or weights."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.errors import SearchValidationError
from graphloom.operators.fulltext import FullTextIndex, bm25
from graphloom.operators.vector import knn


def normalised(hits: DataFrame, key: str) -> DataFrame:
    """Scores over the largest of the branch; 0 where that is 0. The branch, at most top_k rows, is read once."""
    best = hits.withColumn("best", F.max("score").over(Window.partitionBy()))
    return best.select(key, F.coalesce(F.try_divide("score", "best"), F.lit(0.0)).alias("score"))


def fuse(vector_hits: DataFrame, text_hits: DataFrame, top_k: int, key: str, ranker: str = "naive", alpha: float | None = None, dedupe: bool = True) -> DataFrame:
    """key, score. Linear fusion takes the set union of weighted rows before it adds them up, so a
    node with two equal weighted scores counts one of them; ``dedupe=False`` counts both."""
    v, t = normalised(vector_hits, key), normalised(text_hits, key)
    if ranker == "naive":
        both, total = v.unionByName(t), F.max("score")
    elif ranker == "linear":
        if alpha is None or not 0 <= alpha <= 1:
            raise SearchValidationError("alpha must be in 0..1")
        both = v.select(key, (F.col("score") * alpha).alias("score")).unionByName(t.select(key, (F.col("score") * (1 - alpha)).alias("score")))
        total = F.sum("score")
    else:
        raise SearchValidationError(f"unknown ranker {ranker}")
    both = both.distinct() if dedupe else both
    return both.groupBy(key).agg(total.alias("score")).orderBy(F.desc("score"), key).limit(top_k)


class HybridRetriever:
    """``index`` is searched where there is one, else the table's texts. A given vector beats the embedding of the text; ``expand`` as in VectorRetriever."""

    def __init__(self, rows: DataFrame, key: str, vector: str, text: str, embedder: Callable[[str], Sequence[float]] | None = None, expand: Callable[[DataFrame], DataFrame] | None = None, index: FullTextIndex | None = None) -> None:
        self.index = index
        self.rows, self.key, self.vector, self.text, self.embedder, self.expand = rows, key, vector, text, embedder, expand

    def search(self, query_text: str, query_vector: Sequence[float] | None = None, top_k: int = 5, effective_search_ratio: int = 1, ranker: str = "naive", alpha: float | None = None) -> DataFrame:
        if top_k < 1 or effective_search_ratio < 1:
            raise SearchValidationError("top_k and effective_search_ratio must be positive")
        if query_vector is None:
            if self.embedder is None:
                raise SearchValidationError("an embedder or a vector is expected")
            query_vector = self.embedder(query_text)
        v = knn(self.rows, query_vector, top_k, self.key, self.vector).select(self.key, "score")
        t = self.index.search(query_text, top_k) if self.index else bm25(self.rows, query_text, top_k, self.key, self.text)
        fused = fuse(v, t, top_k, self.key, ranker, alpha)
        return self.expand(fused) if self.expand else fused
