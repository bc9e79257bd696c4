"""Exact vector search: a scan with a score expression and a top-k; filters go to the scan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.errors import SearchValidationError
from graphloom.functions.similarity import SCORES, vector_literal
from graphloom.operators.filters import compile_filter


def check_search(query_vector: Sequence[float] | None, query_text: str | None, top_k: int, ratio: int = 1) -> None:
    if (query_vector is None) == (query_text is None):
        raise SearchValidationError("exactly one of query_vector and query_text is expected")
    for name, n in (("top_k", top_k), ("effective_search_ratio", ratio)):
        if isinstance(n, bool) or not isinstance(n, int) or n < 1:
            raise SearchValidationError(f"{name} must be a positive integer")


def knn(rows: DataFrame, query_vector: Sequence[float], top_k: int = 5, key: str = "id", vector: str = "embedding", similarity: str = "cosine", filters: dict[str, Any] | None = None) -> DataFrame:
    """All columns and ``score``, best first, ties by key; vectors of another length take no part."""
    if similarity not in SCORES:
        raise SearchValidationError(f"unknown similarity {similarity}")
    if filters is not None:
        rows = rows.where(compile_filter(filters))
    rows = rows.where(F.col(vector).isNotNull() & (F.size(vector) == len(query_vector)))
    scored = rows.withColumn("score", SCORES[similarity](vector, vector_literal(query_vector)))
    return scored.orderBy(F.desc_nulls_last("score"), key).limit(top_k)


class VectorRetriever:
    """Search by vector or text over nodes or relationships, then a user's expansion.

    ``expand`` gets the frame of hits with ``score`` and returns what is wanted of them.
    """

    def __init__(self, rows: DataFrame, key: str = "id", vector: str = "embedding", similarity: str = "cosine", embedder: Callable[[str], Sequence[float]] | None = None, return_columns: Sequence[str] | None = None, expand: Callable[[DataFrame], DataFrame] | None = None) -> None:
        self.rows, self.key, self.vector, self.similarity = rows, key, vector, similarity
        self.embedder, self.return_columns, self.expand = embedder, return_columns, expand

    def search(self, query_vector: Sequence[float] | None = None, query_text: str | None = None, top_k: int = 5, effective_search_ratio: int = 1, filters: dict[str, Any] | None = None) -> DataFrame:
        check_search(query_vector, query_text, top_k, effective_search_ratio)
        if query_vector is None:
            if self.embedder is None:
                raise SearchValidationError("query_text needs an embedder")
            query_vector = self.embedder(query_text)
        hits = knn(self.rows, query_vector, top_k, self.key, self.vector, self.similarity, filters)
        if self.expand:
            return self.expand(hits)
        if self.return_columns:
            return hits.select(*self.return_columns, "score")
        return hits.drop(self.vector)
