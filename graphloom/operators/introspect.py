"""Schema introspection: property catalogues, profiles, counts, and their text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXHAUSTIVE_BELOW, SAMPLE_ROWS, MAX_OPTIONS, MAX_LIST = 10_000, 5, 10, 128


def type_name(kind: T.DataType) -> str:
    """The schema's name of a Spark type."""
    simple = {T.BooleanType: "BOOLEAN", T.StringType: "STRING", T.DateType: "DATE", T.TimestampNTZType: "LOCAL_DATETIME", T.TimestampType: "ZONED_DATETIME"}
    if isinstance(kind, T.ArrayType):
        return f"{type_name(kind.elementType)}_ARRAY"
    if isinstance(kind, T.IntegralType):
        return "INTEGER"
    if isinstance(kind, T.FractionalType):
        return "FLOAT"
    if isinstance(kind, T.StructType):
        return "POINT" if {"latitude", "longitude"} <= set(kind.names) else "MAP"
    return simple.get(type(kind), kind.simpleString().upper())


def label_counts(nodes: DataFrame, hidden: tuple[str, ...] = ()) -> DataFrame:
    counted = nodes.groupBy("label").agg(F.count("*").alias("n"))
    return counted.where(~F.col("label").isin(*hidden)) if hidden else counted


def type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count("*").alias("n"))


def patterns(edges: DataFrame) -> DataFrame:
    """Distinct (src_label, type, dst_label)."""
    return edges.select("src_label", "type", "dst_label").distinct()


def property_catalogue(nodes: DataFrame) -> DataFrame:
    """label, property of generic nodes with a map ``props``."""
    return nodes.select("label", F.explode(F.map_keys("props")).alias("property")).distinct()


def profile(df: DataFrame) -> DataFrame:
    """A row for each column: distinct values, least and greatest (as text), sizes of lists.

    One aggregation over all columns, in one pass.
    """
    parts: list[Column] = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            agg = (F.lit(None).cast("long"), F.min(F.size(c)).cast("string"), F.max(F.size(c)).cast("string"))
        else:
            agg = (F.count_distinct(c), F.min(c).cast("string"), F.max(c).cast("string"))
        parts.append(F.struct(F.lit(f.name).alias("property"), F.lit(type_name(f.dataType)).alias("type"), agg[0].alias("n_distinct"), agg[1].alias("least"), agg[2].alias("greatest")))
    return df.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def text_options(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a text column, their first 50 characters."""
    return df.where(F.col(column).isNotNull()).select(F.substring(column, 1, 50).alias("value")).distinct()


def enhanced_options(df: DataFrame, column: str) -> list[str]:
    """All options of a small column, else one example; large tables are looked at in a few rows."""
    few = df.limit(EXHAUSTIVE_BELOW).count() < EXHAUSTIVE_BELOW
    found = text_options(df if few else df.limit(SAMPLE_ROWS), column).orderBy("value").limit(MAX_OPTIONS + 1).collect()
    values = [r["value"] for r in found]
    return values if few and len(values) <= MAX_OPTIONS else values[:1]


def format_schema(node_props: dict[str, dict[str, str]], rel_props: dict[str, dict[str, str]], triples: list[tuple[str, str, str]]) -> str:
    line = lambda name, props: f"{name} {{{', '.join(f'{k}: {v}' for k, v in props.items())}}}"
    return "\n".join([
        "Node properties:", *(line(n, p) for n, p in sorted(node_props.items()) if p),
        "Relationship properties:", *(line(n, p) for n, p in sorted(rel_props.items()) if p),
        "The relationships:", *(f"(:{a})-[:{t}]->(:{b})" for a, t, b in sorted(triples)),
    ])


def table_types(df: DataFrame) -> dict[str, str]:
    return {f.name: type_name(f.dataType) for f in df.schema.fields}


def without_long_lists(df: DataFrame, limit: int = MAX_LIST) -> DataFrame:
    """Lists of ``limit`` elements and more become null, inside structs and lists too."""

    def clean(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.ArrayType):
            inner = F.transform(c, lambda x: clean(x, kind.elementType)) if isinstance(kind.elementType, T.ArrayType | T.StructType) else c
            return F.when(F.size(c) < limit, inner)
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*(clean(c[f.name], f.dataType).alias(f.name) for f in kind.fields)))
        return c

    return df.select(*(clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields))


def inferred_schema(nodes: DataFrame, edges: DataFrame):
    """A GraphSchema of what generic nodes and typed edges hold (bounded by the number of names)."""
    from graphloom.operators.prune import GraphSchema, TypeRule

    props = reduce(lambda a, r: a | {r["label"]: (*a.get(r["label"], ()), r["property"])}, property_catalogue(nodes).orderBy("label", "property").collect(), {})
    found = [tuple(r) for r in patterns(edges).orderBy("src_label", "type", "dst_label").collect()]
    labels = [r["label"] for r in nodes.select("label").distinct().orderBy("label").collect()]
    return GraphSchema(tuple(TypeRule(x, tuple(props.get(x, ()))) for x in labels), tuple(TypeRule(t) for t in sorted({t for _, t, _ in found})), tuple(found))
