"""Graph writers: upserts, edge merging, Parquet export by label and by pattern, index catalog.

There is no table format with MERGE here: an upsert is an anti-join, a union and a directory swap.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.errors import IndexExistsError, SearchValidationError
from graphloom.functions.similarity import SCORES
from graphloom.graph import ENTITY
from graphloom.sources import export


def with_labels(nodes: DataFrame, lexical: tuple[str, ...] = ()) -> DataFrame:
    """``labels``: the label, and the entity label unless it is lexical."""
    own = F.array("label")
    return nodes.withColumn("labels", F.when(F.col("label").isin(*lexical), own).otherwise(F.array_append(own, F.lit(ENTITY))) if lexical else F.array_append(own, F.lit(ENTITY)))


def merge_edges(edges: DataFrame, nodes: DataFrame, order: str = "seq") -> DataFrame:
    """One edge for each (src, type, dst), the last written (ties by the other columns); edges without both ends are dropped."""
    ids = nodes.select("id").distinct()
    whole = edges.join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi")
    rest = [c for c in edges.columns if c not in ("src", "type", "dst")]
    return whole.groupBy("src", "type", "dst").agg(F.max_by(F.struct(*rest), F.struct(order, *rest)).alias("r")).select("src", "type", "dst", "r.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """New rows replace old ones of their key; of several new ones the last by ``order`` counts."""
    if order:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
        new = new.withColumn("_r", rank).where("_r = 1").drop("_r")
    else:
        new = new.dropDuplicates(keys)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_vectors(nodes: DataFrame, vectors: DataFrame, prop: str = "embedding", key: str = "id") -> DataFrame:
    """Nodes with new vectors where there are any; all new ones must have one length."""
    sizes = vectors.agg(F.min(F.size(prop)).alias("a"), F.max(F.size(prop)).alias("b")).first()
    if sizes["a"] != sizes["b"]:
        raise SearchValidationError("vectors differ in length")
    new = vectors.select(key, F.col(prop).alias("_new"))
    kept = F.coalesce("_new", prop) if prop in nodes.columns else F.col("_new")
    return nodes.join(new, key, "left").withColumn(prop, kept).drop("_new")


def write_table(df: DataFrame, path: str) -> None:
    """Overwrite a table: written beside it, the old one set aside, the new one put in its place.

    A run that ends between the two renames leaves the old table aside; ``recover`` or the next
    write puts it back, so no version is lost.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    df.write.mode("overwrite").parquet(f"{path}.next")
    recover(spark, path)
    fs, (there, beside, aside) = _paths(spark, path, f"{path}.next", f"{path}.old")
    if fs.exists(there):
        fs.delete(aside, True)
        fs.rename(there, aside)
    if not fs.rename(beside, there):
        raise OSError(f"{path} could not be replaced")
    fs.delete(aside, True)


def _paths(spark: SparkSession, *paths: str) -> tuple:
    found = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return found[0].getFileSystem(spark._jsc.hadoopConfiguration()), found


def recover(spark: SparkSession, path: str) -> None:
    """Put back the table that an interrupted ``write_table`` has set aside."""
    fs, (there, aside) = _paths(spark, path.rstrip("/"), f"{path.rstrip('/')}.old")
    if not fs.exists(there) and fs.exists(aside):
        fs.rename(aside, there)


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """what, name, n: nodes by label and relationships by type."""
    a = nodes.groupBy(F.lit("node").alias("what"), F.col("label").alias("name")).agg(F.count("*").alias("n"))
    return a.unionByName(edges.groupBy(F.lit("relationship").alias("what"), F.col("type").alias("name")).agg(F.count("*").alias("n")))


def coerce_numbers(frames: list[DataFrame], column: str) -> list[DataFrame]:
    """A column of several types: integers and floats become double, anything else text."""
    kinds = {type(f.schema[column].dataType) for f in frames if not isinstance(f.schema[column].dataType, T.NullType)}
    if len(kinds) < 2:
        return frames
    numeric = all(issubclass(k, T.NumericType) for k in kinds)
    return [f.withColumn(column, F.col(column).cast("double" if numeric else "string")) for f in frames]


def export_graph(nodes: DataFrame, edges: DataFrame, path: str, prefix: str = "") -> dict[str | tuple[str, str, str], str]:
    """The folder of each label and each (src_label, type, dst_label), as ``export.export_graph`` writes them."""
    return export.export_graph(nodes, edges, path, prefix).folders


@dataclass
class IndexCatalog:
    """Names, targets and settings of indexes; the data stays in tables."""

    entries: dict[str, dict] = field(default_factory=dict)

    def _add(self, name: str, fail_if_exists: bool, **entry) -> None:
        if name in self.entries:
            if fail_if_exists:
                raise IndexExistsError(name)
            return
        self.entries[name] = entry

    def create_vector_index(self, name: str, label: str, prop: str, dimensions: int, similarity: str = "cosine", fail_if_exists: bool = False, filterable: tuple[str, ...] = ()) -> None:
        if not name or not label or not prop or dimensions < 1 or similarity not in SCORES:
            raise SearchValidationError("a vector index needs a name, a label, a property, dimensions and a known similarity")
        self._add(name, fail_if_exists, type="VECTOR", label=label, properties=[prop], dimensions=dimensions, similarity=similarity, filterable=list(filterable))

    def create_fulltext_index(self, name: str, label: str, props: tuple[str, ...], fail_if_exists: bool = False) -> None:
        if not name or not label or not props:
            raise SearchValidationError("a full-text index needs a name, a label and properties")
        self._add(name, fail_if_exists, type="FULLTEXT", label=label, properties=list(props), dimensions=None, similarity=None, filterable=[])

    def drop_index_if_exists(self, name: str) -> None:
        self.entries.pop(name, None)

    def show(self, spark: SparkSession, kind: str | None = None) -> DataFrame:
        rows = [(n, e["type"], e["label"], e["properties"], e["dimensions"], e["similarity"], e["filterable"]) for n, e in sorted(self.entries.items()) if kind in (None, e["type"])]
        return spark.createDataFrame(rows, "name string, type string, label string, properties array<string>, dimensions int, similarity string, filterable array<string>")

    def find(self, kind: str, name: str, label: str, prop: str) -> str | None:
        """The index of that name, else one on the label and property."""
        own = [n for n, e in self.entries.items() if e["type"] == kind and (n == name or e["label"] == label and prop in e["properties"])]
        return min(own, key=lambda n: (n != name, n), default=None)
