"""Entity resolution: exact, normalised, fuzzy and by vectors; merged nodes keep the smallest id.

Edit distance, fuzzy and vector pairs are exact joins (``simjoin``); own scores are compared inside blocks. Matches become groups by connected components (a superset of order-dependent merging).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.similarity import cosine
from graphloom.operators import simjoin
from graphloom.sources.scratch import cut

#: Fixed value: the characters that normalisation strips from names.
STRIPPED = r"""[\s<>《》「」『』【】()\[\]“”‘’\"']"""


def exact_groups(nodes: DataFrame, prop: str = "name") -> DataFrame:
    """id, canonical of nodes with the property: the smallest id of their label and value."""
    keyed = nodes.where(F.col(prop).isNotNull()).select("id", "label", F.col(prop).alias("_v"))
    least = keyed.groupBy("label", "_v").agg(F.min("id").alias("canonical"))
    return keyed.join(least, ["label", "_v"]).select("id", "canonical")


def normalised_name(name: Column | str) -> Column:
    return F.regexp_replace(name, STRIPPED, "")


def normalised_groups(nodes: DataFrame, prop: str = "name") -> DataFrame:
    keyed = nodes.withColumn("_n", normalised_name(prop)).where(F.col("_n") != "")
    return exact_groups(keyed, "_n")


def stats(groups: DataFrame) -> DataFrame:
    """Nodes looked at and nodes left."""
    return groups.agg(F.count("*").alias("nodes_to_resolve"), F.countDistinct("canonical").alias("created_nodes"))


def similar_pairs(nodes: DataFrame, score: Callable[[str, str], Column], threshold: float, columns: tuple[str, ...], block: Column) -> DataFrame:
    """a, b (a < b) of one label and block whose score over the columns reaches the threshold."""
    left = nodes.select(F.col("id").alias("a"), "label", block.alias("_block"), *(F.col(c).alias(f"_a_{c}") for c in columns))
    right = nodes.select(F.col("id").alias("b"), "label", block.alias("_block"), *(F.col(c).alias(f"_b_{c}") for c in columns))
    pairs = left.join(right, ["label", "_block"]).where("a < b")
    return pairs.where(score(f"_a_{columns[0]}", f"_b_{columns[0]}") >= threshold).select("a", "b").distinct()


def levenshtein_score(a: str, b: str) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.char_length(a), F.char_length(b), F.lit(1))


def levenshtein_pairs(nodes: DataFrame, prop: str = "name", threshold: float = 0.8, block: Column | None = None) -> DataFrame:
    """a, b of one label (and block, where one is given) whose ``levenshtein_score`` reaches the threshold; none is lost."""
    return simjoin.edit_pairs(nodes.withColumn("_block", F.lit(0) if block is None else block), prop, threshold, ["label", "_block"])


def levenshtein_links(nodes: DataFrame, prop: str = "name", threshold: float = 0.8, block: Column | None = None) -> DataFrame:
    """a, b: links with the components of ``levenshtein_pairs``; copies of a name are linked to its smallest id only."""
    return simjoin.edit_links(nodes.withColumn("_block", F.lit(0) if block is None else block), prop, threshold, ["label", "_block"])


def fuzzy_pairs(nodes: DataFrame, prop: str = "name", threshold: float = 0.8, processed: bool = True, block: Column | None = None) -> DataFrame:
    """a, b of one label (and block, where one is given) whose names are as alike as the threshold; none is lost."""
    text = F.trim(F.regexp_replace(F.lower(prop), r"[^\p{L}\p{N}]", " ")) if processed else F.col(prop)
    label = F.col("label") if block is None else F.to_json(F.struct("label", block.alias("b")))
    return simjoin.name_pairs(nodes.select("id", label.alias("label"), text.alias("t")), threshold)


def vector_pairs(nodes: DataFrame, vector: str = "embedding", threshold: float = 0.8, block: Column | None = None) -> DataFrame:
    """a, b of one label (and block) whose cosine reaches the threshold; below 0 all pairs are looked at, as most are wanted."""
    of = nodes.withColumn("_block", F.lit(0) if block is None else block)
    if threshold <= 0:
        return similar_pairs(of, lambda a, b: cosine(a, b, on_zero=0.0), threshold, (vector,), F.col("_block"))
    return simjoin.vector_pairs(of, vector, threshold, ["label", "_block"])


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, canonical (the smallest id reached): labels pass along pairs and along the labels' own labels."""
    both = cut(pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(pairs.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct(), "pairs")
    label = cut(both.groupBy("x").agg(F.least(F.min("x"), F.min("y")).alias("l")), "labels")
    while True:
        near = both.join(label.select(F.col("x").alias("y"), F.col("l").alias("m")), "y").groupBy("x").agg(F.min("m").alias("m"))
        lower = label.join(near, "x").select("x", F.least("l", "m").alias("l"))
        jump = lower.select(F.col("x").alias("l"), F.col("l").alias("j"))
        nxt = cut(lower.join(jump, "l", "left").select("x", F.coalesce(F.least("l", "j"), "l").alias("l")), "labels")
        if nxt.join(label, ["x", "l"], "left_anti").isEmpty():
            return nxt.select(F.col("x").alias("id"), F.col("l").alias("canonical"))
        label = nxt


def apply_groups(nodes: DataFrame, edges: DataFrame, groups: DataFrame, collected: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Merged nodes (``collected`` properties become sorted arrays, others the smallest id's) and
    edges moved to them, once each (of several the one with the least ends keeps its properties),
    without loops that merging made."""
    of = nodes.join(groups, "id", "left").withColumn("canonical", F.coalesce("canonical", "id"))
    rest = [c for c in nodes.columns if c != "id" and c not in collected]
    merged = of.groupBy("canonical").agg(F.min_by(F.struct(*rest), "id").alias("_r"), *(F.array_sort(F.collect_set(c)).alias(c) for c in collected)).select(F.col("canonical").alias("id"), "_r.*", *collected)
    move = of.select("id", "canonical")
    moved = edges.join(move.toDF("src", "_s"), "src").join(move.toDF("dst", "_d"), "dst")
    kept = moved.where((F.col("_s") != F.col("_d")) | (F.col("src") == F.col("dst")))
    extra = [c for c in edges.columns if c not in ("src", "type", "dst")]
    if not extra:
        return merged, kept.select(F.col("_s").alias("src"), "type", F.col("_d").alias("dst")).distinct()
    one = kept.groupBy("_s", "type", "_d").agg(F.min_by(F.struct(*extra), F.struct("src", "dst")).alias("_e"))
    return merged, one.select(F.col("_s").alias("src"), "type", F.col("_d").alias("dst"), "_e.*")


def route(nodes: DataFrame, resolvers: dict[tuple[str, ...], Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """id, canonical by the resolver of a node's label; nodes of labels without one, or that it leaves out, are not listed."""
    parts = [resolver(nodes.where(F.col("label").isin(*labels))).select("id", "canonical") for labels, resolver in resolvers.items()]
    return reduce(DataFrame.unionByName, parts) if parts else nodes.select("id", F.col("id").alias("canonical")).limit(0)


def collapse(descriptions: Column | str) -> Column:
    """One text of merged descriptions; unchanged when applied again."""
    return F.array_join(F.array_sort(F.array_distinct(descriptions)), " / ")
