"""Graph expansion: hops, closures, induced subgraphs, and retrieval with its surroundings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.sources.scratch import cut

#: Labels that are not about the domain.
META_LABELS = ("Chunk", "Chapter", "Story", "Document", "__Entity__")


def domain_label(labels: Column | str, meta: tuple[str, ...] = META_LABELS) -> Column:
    """The first label that is not a meta label, else ``Node``."""
    labels = F.col(labels) if isinstance(labels, str) else labels
    return F.coalesce(F.try_element_at(F.filter(labels, lambda x: ~x.isin(*meta)), F.lit(1)), F.lit("Node"))


def one_hop(graph: PropertyGraph, start: DataFrame) -> DataFrame:
    """start, type, neighbour over edges in either direction; ``start`` has a column ``id``."""
    e = graph.undirected()
    return e.join(start.select(F.col("id").alias("a")).distinct(), "a", "left_semi").select(F.col("a").alias("id"), "type", F.col("b").alias("neighbour")).distinct()


def closure(edges: DataFrame, start: DataFrame | None = None, max_rounds: int = 64) -> DataFrame:
    """id, reached, hops: everything reached by one edge (src, dst) or more, at its fewest hops.

    Semi-naive: each round joins only what the last one found; cycles end it. Rounds are cut to
    tables, so the plan does not grow. More than ``max_rounds`` hops raise ``RuntimeError``.
    """
    step = edges.select("src", "dst").distinct()
    first = step.select(F.col("src").alias("id"), F.col("dst").alias("reached"), F.lit(1).alias("hops"))
    if start is not None:
        first = first.join(start.select("id").distinct(), "id", "left_semi")
    known = front = cut(first, "closure")
    for hops in range(2, max_rounds + 2):
        further = front.join(step, F.col("reached") == F.col("src")).select("id", F.col("dst").alias("reached")).distinct()
        front = cut(further.join(known.select("id", "reached"), ["id", "reached"], "left_anti").withColumn("hops", F.lit(hops)), "closure")
        if front.isEmpty():
            return known
        known = known.unionByName(front)
    raise RuntimeError(f"paths of more than {max_rounds} hops")


def induced_edges(edges: DataFrame, members: DataFrame, group: str | None = None) -> DataFrame:
    """Edges with both ends among ``members`` (id), of the same ``group`` where one is named."""
    if group is None:
        ids = members.select("id").distinct()
        return edges.join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi")
    ids = members.select(group, "id").distinct()
    return edges.join(ids.toDF(group, "src"), "src").join(ids.toDF(group, "dst"), [group, "dst"])


def retrieve(graph: PropertyGraph, anchors: DataFrame, evidence: DataFrame, related: tuple[str, ...] = (), upward: tuple[str, ...] = (), max_rounds: int = 64, chapters: DataFrame | None = None) -> DataFrame:
    """chunk, facts, subgraph and edges of anchor chunks, one row each, chunks without facts included.

    ``anchors``: chunk and more; ``evidence``: chunk, fact. The subgraph of a chunk is its facts,
    their neighbours, these one's neighbours over ``related`` types in either direction, and
    everything upward of the neighbours over each one of the ``upward`` types; its edges have both ends
    in it. ``chapters`` (chunk, number) fills the chapter of anchors that have none of their own.
    """
    if chapters is not None:
        numbers = chapters.groupBy("chunk").agg(F.min("number").alias("_number"))
        anchors = anchors.join(numbers, "chunk", "left").withColumn("chapter", F.coalesce("chapter", "_number")).drop("_number")
    facts = evidence.join(anchors.select("chunk"), "chunk", "left_semi").select("chunk", F.col("fact").alias("id")).distinct()
    both = graph.undirected()
    near = facts.join(both, F.col("id") == F.col("a")).select("chunk", F.col("b").alias("id")).distinct()
    parts = [facts, near]
    if related:
        parts.append(near.join(both.where(F.col("type").isin(*related)), F.col("id") == F.col("a")).select("chunk", F.col("b").alias("id")))
    for kind in upward:
        above = closure(graph.edges.where(F.col("type") == kind), near.select("id"), max_rounds)
        parts.append(near.join(above, "id").select("chunk", F.col("reached").alias("id")))
    members = parts[0]
    for p in parts[1:]:
        members = members.unionByName(p)
    members = members.distinct().join(graph.nodes.select("id", "label", "name"), "id")
    inside = induced_edges(graph.edges.select("src", "type", "dst"), members, "chunk")
    node = F.struct("id", "label", "name")
    listed = members.groupBy("chunk").agg(F.array_sort(F.collect_set(node)).alias("subgraph"))
    wired = inside.groupBy("chunk").agg(F.array_sort(F.collect_set(F.struct("src", "type", "dst"))).alias("edges"))
    known = facts.groupBy("chunk").agg(F.array_sort(F.collect_set("id")).alias("facts"))
    out = anchors.join(known, "chunk", "left").join(listed, "chunk", "left").join(wired, "chunk", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType))
    return out.withColumns({c: empty(c) for c in ("facts", "subgraph", "edges")})


def props_summary(props: Column | str) -> Column:
    """``k=v, k=v`` in key order, empty values left out."""
    props = F.col(props) if isinstance(props, str) else props
    kept = F.filter(F.map_entries(props), lambda e: e.value.isNotNull() & (e.value != ""))
    return F.array_join(F.transform(F.array_sort(kept), lambda e: F.concat(e.key, F.lit("="), e.value)), ", ")


def format_chunk(text: Column, chapter: Column, edges: Column) -> Column:
    """A chunk's excerpt and its related edges as lines of text."""
    lines = F.array_join(F.transform(edges, lambda e: F.concat(F.lit("- "), e.src, F.lit(" -["), e.type, F.lit("]-> "), e.dst)), "\n")
    return F.concat(F.lit("[excerpt, chapter "), chapter.cast("string"), F.lit("]\n"), text, F.when(lines != "", F.concat(F.lit("\n[related]\n"), lines)).otherwise(""))


def dump_text(graph: PropertyGraph) -> DataFrame:
    """label, body: each label's names in order, one a line."""
    return graph.nodes.groupBy("label").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), "name"))), "\n").alias("body"))


def join_sections(sections: list[Column]) -> Column:
    """Sections with a blank line between, empty ones left out."""
    return F.array_join(F.filter(F.array(*sections), lambda s: s.isNotNull() & (s != "")), "\n\n")
