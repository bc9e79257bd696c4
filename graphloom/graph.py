"""Property graphs as two DataFrames, and the graph view of the relational tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITY = "__Entity__"


@dataclass(frozen=True)
class PropertyGraph:
    """nodes: id, label, name and more; edges: src, type, dst and more."""

    nodes: DataFrame
    edges: DataFrame

    def label(self, *labels: str) -> DataFrame:
        return self.nodes.where(F.col("label").isin(*labels))

    def without(self, *labels: str) -> DataFrame:
        return self.nodes.where(~F.col("label").isin(*labels))

    def undirected(self) -> DataFrame:
        """a, type, b: every edge in both directions."""
        e = self.edges
        return e.select(F.col("src").alias("a"), "type", F.col("dst").alias("b")).unionByName(e.select(F.col("dst").alias("a"), "type", F.col("src").alias("b")))

    def typed_edges(self) -> DataFrame:
        """Edges with both ends' labels; edges without both ends in nodes are dropped."""
        ends = self.nodes.select("id", "label")
        out = self.edges.join(ends.toDF("src", "src_label"), "src")
        return out.join(ends.toDF("dst", "dst_label"), "dst")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_id(label: str, key: str) -> Column:
    return F.concat(F.lit(f"{label}:"), F.col(key).cast("string"))


#: label -> (table, key, name)
NODE_TABLES = {
    "customer": ("customer", "c_custkey", "c_name"),
    "order": ("orders", "o_orderkey", "o_orderstatus"),
    "part": ("part", "p_partkey", "p_name"),
    "supplier": ("supplier", "s_suppkey", "s_name"),
    "nation": ("nation", "n_nationkey", "n_name"),
    "region": ("region", "r_regionkey", "r_name"),
}
#: type -> (table, source label, source key, target label, target key, may repeat)
EDGE_TABLES = (
    ("PLACED", "orders", "customer", "o_custkey", "order", "o_orderkey", False),
    ("CONTAINS", "lineitem", "order", "l_orderkey", "part", "l_partkey", True),
    ("SUPPLIED_BY", "lineitem", "part", "l_partkey", "supplier", "l_suppkey", True),
    ("IN_NATION", "customer", "customer", "c_custkey", "nation", "c_nationkey", False),
    ("IN_NATION", "supplier", "supplier", "s_suppkey", "nation", "s_nationkey", False),
    ("LOCATED_IN", "nation", "nation", "n_nationkey", "region", "n_regionkey", False),
)


def relational_graph(spark: SparkSession, sf_dir: str, types: tuple[str, ...] | None = None, labels: tuple[str, ...] | None = None) -> PropertyGraph:
    """The tables as a graph; only the named edge types and node labels are read."""
    nodes = [table(spark, sf_dir, t).select(node_id(label, key).alias("id"), F.lit(label).alias("label"), F.col(name).alias("name")) for label, (t, key, name) in NODE_TABLES.items() if labels is None or label in labels]
    edges = []
    for kind, t, a, a_key, b, b_key, repeats in EDGE_TABLES:
        if types is None or kind in types:
            keys = table(spark, sf_dir, t).select(a_key, b_key)
            keys = keys.distinct() if repeats else keys
            edges.append(keys.select(node_id(a, a_key).alias("src"), F.lit(kind).alias("type"), node_id(b, b_key).alias("dst"), F.lit(a).alias("src_label"), F.lit(b).alias("dst_label")))
    return PropertyGraph(reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges))
