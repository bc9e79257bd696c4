"""A written vector index: exact top-k search that opens only the files that can hold a hit.

Vectors are dealt to cells, each around a centre (a vector of a bounded sample), and written one folder a cell in
files of about ``FILE`` rows, in order of their distance from the centre. A table beside them has a row for each file:
its cell, the least and largest distance, and the least and largest value of each column that may be
filtered. By the triangle inequality no vector of a file is nearer to a query than these distances
tell, so a search visits files from the nearest on until the k-th best score is out of reach of the rest;
filters that the bounds rule out close a file before. Scores are those of ``vector.knn``, ties go to the smaller key.

Vectors that are null or of another length are not indexed. For cosine, distances are between unit vectors; vectors of
length zero have no cosine and stand in a cell of their own, read last, as their score is null.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.errors import SearchValidationError
from graphloom.functions.similarity import SCORES, squared_distance, vector_literal
from graphloom.operators.vector import knn
from graphloom.sources.scratch import cut

#: Centres at most; rows of a file, about; files that a search opens in its first step.
CENTRES, FILE, FIRST = 256, 50_000, 4
#: Distances are compared with this much room for rounding.
_ROOM = 1e-6


def _unit(vector: Column) -> Column:
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(size > 0, F.transform(vector, lambda x: x / size))


def _within(low: Any, high: Any, spec: Any) -> bool:
    """Whether a file whose values of a column lie between low and high can hold a row that fits."""
    if low is None:
        return False  # nothing but nulls, which fit no comparison
    tests = spec if isinstance(spec, dict) else {"$eq": spec}
    try:
        for op, value in tests.items():
            if op == "$eq" and not low <= value <= high:
                return False
            if op == "$in" and not any(low <= v <= high for v in value):
                return False
            if op == "$between" and (value[1] < low or value[0] > high):
                return False
            if (op == "$gt" and high <= value) or (op == "$gte" and high < value) or (op == "$lt" and low >= value) or (op == "$lte" and low > value):
                return False
    except TypeError:
        return True
    return True


@dataclass(frozen=True)
class VectorIndex:
    """The index at ``path``; search results have all columns of the rows and ``score``."""

    spark: SparkSession
    path: str
    key: str = "id"
    vector: str = "embedding"

    @classmethod
    def create(
        cls, rows: DataFrame, path: str, dimensions: int, key: str = "id", vector: str = "embedding", similarity: str = "cosine",
        filterable: Sequence[str] = (), centres: int = CENTRES, file_rows: int = FILE,
    ) -> VectorIndex:
        if similarity not in SCORES:
            raise SearchValidationError(f"unknown similarity {similarity}")
        if dimensions < 1 or missing_of(rows, [key, vector, *filterable]):
            raise SearchValidationError(f"dimensions must be positive and columns known: {missing_of(rows, [key, vector, *filterable])}")
        spark = rows.sparkSession
        double = F.col(vector).cast("array<double>")
        held = rows.where(F.col(vector).isNotNull() & (F.size(vector) == dimensions)).withColumn("_u", _unit(double) if similarity == "cosine" else double)
        # about a centre for each file; their number is bounded, and so is what the plan carries
        wanted = max(1, min(centres, -(-rows.count() // file_rows)))
        sample = held.where(F.col("_u").isNotNull()).select(key, "_u").orderBy(F.xxhash64(key)).limit(wanted).collect()
        points = F.array(*(F.array(*map(F.lit, r["_u"])) for r in sample)) if sample else F.array().cast("array<array<double>>")
        distances = F.transform(points, lambda p: F.sqrt(squared_distance("_u", p)))
        placed = held.withColumn("_d", F.when(F.col("_u").isNotNull(), distances)).withColumn("_cell", F.coalesce((F.array_position("_d", F.array_min("_d")) - 1).cast("int"), F.lit(-1)))
        placed = cut(placed.withColumn("_r", F.coalesce(F.get("_d", F.col("_cell")), F.lit(0.0))).drop("_u", "_d"), "cells")
        # a cell's rows are cut into rings of a file each, by ranges over (cell, distance)
        files = max(1, -(-placed.count() // file_rows), len(sample))
        spread = placed.repartitionByRange(files, "_cell", "_r", key).sortWithinPartitions("_cell", "_r")
        spread.withColumn("_file", F.concat_ws("-", F.col("_cell").cast("string"), F.spark_partition_id().cast("string"))).write.mode("overwrite").partitionBy("_file").parquet(f"{path}/vectors")
        written = spark.read.schema(placed.schema.add("_file", "string")).parquet(f"{path}/vectors")
        bounds = [f(F.col(c)).alias(f"{name}_{c}") for c in filterable for name, f in (("low", F.min), ("high", F.max))]
        found = written.groupBy("_file", "_cell").agg(F.min("_r").alias("least"), F.max("_r").alias("most"), F.count("*").alias("n"), *bounds)
        centre = F.get(points, F.col("_cell"))
        found.withColumn("centre", F.when(F.col("_cell") >= 0, centre)).coalesce(1).write.mode("overwrite").parquet(f"{path}/files")
        meta = [(similarity, dimensions, ",".join(filterable), rows.schema.json())]
        spark.createDataFrame(meta, "similarity string, dimensions int, filterable string, columns string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
        return cls(spark, path, key, vector)

    @cached_property
    def _meta(self):
        return self.spark.read.parquet(f"{self.path}/meta").first()

    @cached_property
    def _files(self) -> list:
        return self.spark.read.parquet(f"{self.path}/files").collect()  # a row for each file

    def rows(self, files: Sequence[str] | None = None) -> DataFrame:
        """The indexed rows, of some files only where they are named."""
        columns = StructType.fromJson(json.loads(self._meta["columns"]))
        read = self.spark.read.schema(StructType([*columns.fields]).add("_cell", "integer").add("_r", "double").add("_file", "string")).parquet(f"{self.path}/vectors")
        return (read if files is None else read.where(F.col("_file").isin(list(files)))).drop("_cell", "_r", "_file")

    def _bound(self, file, query: Sequence[float]) -> float:
        """No vector of the file scores higher."""
        if file["_cell"] < 0:
            return -math.inf
        d = math.dist(query, file["centre"])
        nearest = max(0.0, max(d - file["most"], file["least"] - d) - _ROOM)
        # of unit vectors the cosine is 1 - d^2 / 2
        return 1 - nearest * nearest / 4 if self._meta["similarity"] == "cosine" else 1 / (1 + nearest * nearest)

    def plan(self, query_vector: Sequence[float], filters: dict[str, Any] | None = None) -> list[tuple[float, str]]:
        """(bound, file) of the files that filters leave, highest bound first."""
        query = [float(x) for x in query_vector]
        if len(query) != self._meta["dimensions"]:
            raise SearchValidationError(f"the index has {self._meta['dimensions']} dimensions")
        if self._meta["similarity"] == "cosine" and (size := math.sqrt(sum(x * x for x in query))):
            query = [x / size for x in query]
        of = [c for c in self._meta["filterable"].split(",") if c and c in (filters or {})]
        left = [f for f in self._files if all(_within(f[f"low_{c}"], f[f"high_{c}"], filters[c]) for c in of)]
        return sorted(((self._bound(f, query), f["_file"]) for f in left), key=lambda x: (-x[0], x[1]))

    def search(self, query_vector: Sequence[float], top_k: int = 5, filters: dict[str, Any] | None = None) -> DataFrame:
        """The same rows as ``vector.knn`` over the whole table: a first step over the nearest files finds a score
        that the k best reach, the second reads all files that can reach it."""
        return knn(self.rows(self.files_for(query_vector, top_k, filters)), query_vector, top_k, self.key, self.vector, self._meta["similarity"], filters)

    def files_for(self, query_vector: Sequence[float], top_k: int = 5, filters: dict[str, Any] | None = None) -> list[str]:
        """The files that a search has to read."""
        plan = self.plan(query_vector, filters)
        step = FIRST
        while step < len(plan):
            first = [f for _, f in plan[:step]]
            scores = knn(self.rows(first), query_vector, top_k, self.key, self.vector, self._meta["similarity"], filters).agg(F.min("score").alias("least"), F.count("score").alias("n")).first()
            if scores["n"] == top_k:
                return [f for bound, f in plan if bound >= scores["least"] - _ROOM]
            step *= 4
        return [f for _, f in plan]


def missing_of(rows: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c not in rows.columns]
