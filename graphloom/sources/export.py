"""Graph export: all labels in one partitioned write, all patterns in another, and a schema table beside them.

Properties come as columns, or as one VARIANT column (or map of texts) ``props`` whose types differ from
row to row. The type of a property is found by one aggregation: whole numbers are INTEGER, whole numbers
and fractions FLOAT, lists of numbers lists of floats, anything mixed or nested text, and a property that
is only ever null is text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.similarity import unique_names
from graphloom.graph import ENTITY
from graphloom.operators.prune import Constraint
from graphloom.sources.scratch import cut

ID = "__id__"
#: Columns of an exported node and edge that are not properties.
NODE_COLUMNS, EDGE_COLUMNS = (ID, "label", "labels"), ("from", "to", "from_label", "to_label", "type")
#: Names of types in the schema table, and the Spark types that hold them.
TYPES = {"BOOLEAN": "boolean", "INTEGER": "bigint", "FLOAT": "double", "STRING": "string", "DATE": "date", "TIMESTAMP": "timestamp", "FLOAT_ARRAY": "array<float>", "STRING_ARRAY": "array<string>", "BOOLEAN_ARRAY": "array<boolean>"}


def kind_of(kind: T.DataType) -> str:
    """The schema table's name of a type; what Parquet readers would not share is text."""
    if isinstance(kind, T.ArrayType):
        inner = kind_of(kind.elementType)
        # a list that is always empty, or holds only nulls, is a list of texts
        return "FLOAT_ARRAY" if inner in ("INTEGER", "FLOAT") else f"{inner}_ARRAY" if inner in ("STRING", "BOOLEAN") and not isinstance(kind.elementType, T.ArrayType | T.StructType | T.MapType | T.VariantType) else "STRING"
    if isinstance(kind, T.DecimalType):
        return "INTEGER" if kind.scale == 0 and kind.precision <= 18 else "FLOAT"
    for name, types in (("INTEGER", T.IntegralType), ("FLOAT", T.FractionalType), ("BOOLEAN", T.BooleanType), ("DATE", T.DateType), ("TIMESTAMP", T.TimestampType)):
        if isinstance(kind, types):
            return name
    return "STRING"


@dataclass(frozen=True)
class Exported:
    """``folders``: of each label and each (from_label, type, to_label); ``schema``: path of the schema table; ``skipped``: edges without a key."""

    path: str
    folders: dict[str | tuple[str, str, str], str]
    skipped: int


def join_key(label: str, constraints: Sequence[Constraint]) -> str:
    """The property that edges name nodes of a label by: its first key of one property, else ``__id__``."""
    return next((c.properties[0] for c in constraints if c.kind == "key" and c.node == label and len(c.properties) == 1), ID)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _variant(df: DataFrame) -> DataFrame:
    """``props`` as VARIANT."""
    if isinstance(df.schema["props"].dataType, T.VariantType):
        return df
    return df.withColumn("props", F.to_variant_object("props"))


def _found(df: DataFrame, by: Sequence[str], fixed: Sequence[str]) -> tuple[dict[tuple, dict[str, str]], dict[tuple, int], dict[tuple, dict[str, int]]]:
    """Properties with their kinds, rows, and lengths of number lists by group: one aggregation, a row a group."""
    typed = [f for f in df.schema.fields if f.name not in (*by, *fixed, "props")]
    aggs = [F.count(F.lit(1)).alias("_n")]
    lists = [f.name for f in typed if kind_of(f.dataType) == "FLOAT_ARRAY"]
    aggs += [F.count(_quoted(f.name)).alias(f"_c{i}") for i, f in enumerate(typed)]
    aggs += [F.max(F.size(_quoted(name))).alias(f"_d{i}") for i, name in enumerate(lists)]
    generic = "props" in df.columns
    if generic:
        aggs.append(F.schema_of_variant_agg("props").alias("_s"))
    kinds, counts, dims, nested = {}, {}, {}, []
    for row in df.groupBy(*by).agg(*aggs).collect():
        key = tuple(row[c] for c in by)
        counts[key] = row["_n"]
        kinds[key] = {f.name: kind_of(f.dataType) for i, f in enumerate(typed) if row[f"_c{i}"]}
        dims[key] = {name: row[f"_d{i}"] for i, name in enumerate(lists) if (row[f"_d{i}"] or 0) > 0}
        if generic and (row["_s"] or "").startswith("OBJECT<"):
            own = T._parse_datatype_string("struct" + row["_s"].removeprefix("OBJECT").replace("OBJECT<", "STRUCT<"))
            kinds[key] |= {f.name: kind_of(f.dataType) for f in own if f.name not in kinds[key]}
            nested.append((key, [n for n in own.names if kinds[key][n] == "FLOAT_ARRAY" and n not in lists]))
    names = sorted({n for _, ns in nested for n in ns})
    if names:
        sizes = df.groupBy(*by).agg(*(F.max(F.size(F.try_variant_get("props", _path(n), "array<float>"))).alias(f"_d{i}") for i, n in enumerate(names)))
        for row in sizes.collect():
            key = tuple(row[c] for c in by)
            dims[key] |= {n: row[f"_d{i}"] for i, n in enumerate(names) if (row[f"_d{i}"] or 0) > 0}
    return kinds, counts, dims


def _path(name: str) -> str:
    if '"' in name or "'" in name:
        raise ValueError(f"a property may not have quotes in its name: {name}")
    return f'$["{name}"]'


def _stored(kinds: dict[tuple, dict[str, str]]) -> dict[str, str]:
    """One kind for each property of a table: where labels differ it is text, which ``read_export`` turns back."""
    seen: dict[str, set[str]] = {}
    for own in kinds.values():
        for name, kind in own.items():
            seen.setdefault(name, set()).add(kind)
    return {n: k.pop() if len(k) == 1 else "STRING" for n, k in sorted(seen.items())}


def _property(df: DataFrame, name: str, kind: str) -> Column:
    spark_type = TYPES[kind]
    parts = []
    if name in df.columns and name != "props":
        own = df.schema[name].dataType
        nested = isinstance(own, T.ArrayType | T.StructType | T.MapType | T.VariantType)
        parts.append(F.to_json(_quoted(name)) if nested and kind == "STRING" else F.col(_quoted(name)).cast(spark_type))
    if "props" in df.columns:
        parts.append(F.try_variant_get("props", _path(name), spark_type))
    return F.coalesce(*parts).alias(name)


def export_graph(nodes: DataFrame, edges: DataFrame, path: str, prefix: str = "", constraints: Sequence[Constraint] = (), lexical: Sequence[str] = ()) -> Exported:
    """Write ``nodes``, ``edges`` and ``schema`` under ``path``; each is scanned once to learn types and once to write.

    nodes: id, label and properties; edges: src, type, dst and properties. A label's rows are in
    ``nodes/stem=<safe name>``, a pattern's in ``edges/stem=<safe name>``, with _1, _2 where names collide.
    Rows of a table share columns; ``read_export`` gives one label's own. ``from`` and ``to`` hold the join
    key of their node as text. An edge with an unknown end raises ``ValueError``; one with a null end, or whose node has no value of its
    join key, is skipped and counted. A null label is written as the label ``""``. Repeated node ids repeat edges, as they would in a join.
    """
    nodes = nodes.withColumn("label", F.coalesce("label", F.lit("")))
    nodes, edges = (_variant(df) if "props" in df.columns else df for df in (nodes, edges))
    kinds, counts, dims = _found(nodes, ["label"], ["id", "labels"])
    labels = sorted(label for (label,) in counts)
    keys = {label: join_key(label, constraints) for label in labels}
    key = F.col("id").cast("string")
    for label, name in keys.items():
        if name != ID:
            own = kinds[label,].get(name)
            key = F.when(F.col("label") == label, _property(nodes, name, own).cast("string") if own else F.lit(None)).otherwise(key)
    ends = nodes.select("id", "label", key.alias("key"))
    clash = {"from_label", "to_label", "_from", "_to"} & set(edges.columns)
    typed = edges.drop(*clash).join(ends.toDF("src", "from_label", "_from"), "src", "left").join(ends.toDF("dst", "to_label", "_to"), "dst", "left")
    typed = cut(typed.where("src is not null and dst is not null"), "typed")
    state = typed.agg(F.count_if(F.col("from_label").isNull() | F.col("to_label").isNull()).alias("unknown"), F.count_if(F.col("_from").isNull() | F.col("_to").isNull()).alias("keyless")).first()
    if state["unknown"]:
        raise ValueError("an edge has an unknown end")
    ready = typed.where("_from is not null and _to is not null")
    edge_kinds, edge_counts, edge_dims = _found(ready, ["from_label", "type", "to_label"], ["src", "dst", "_from", "_to"])
    patterns = sorted(edge_counts, key=lambda k: tuple(x or "" for x in k))
    stems = unique_names([prefix + n for n in labels] + [prefix + "_".join(x or "" for x in k) for k in patterns])
    stem = dict(zip([*labels, *patterns], stems, strict=True))
    spark = nodes.sparkSession

    stored, edge_stored = _stored(kinds), _stored(edge_kinds)
    own = F.array("label")
    all_labels = F.when(F.col("label").isin(*lexical), own).otherwise(F.array_append(own, F.lit(ENTITY))) if lexical else F.array_append(own, F.lit(ENTITY))
    rows = nodes.select(F.col("id").alias(ID), "label", all_labels.alias("labels"), *(_property(nodes, n, k) for n, k in stored.items() if n not in NODE_COLUMNS))
    _write(spark, rows, {(x,): stem[x] for x in labels}, ("label",), f"{path}/nodes")
    rows = ready.select(F.col("_from").alias("from"), F.col("_to").alias("to"), "from_label", "to_label", "type", *(_property(ready, n, k) for n, k in edge_stored.items() if n not in EDGE_COLUMNS))
    _write(spark, rows, {k: stem[k] for k in patterns}, ("from_label", "type", "to_label"), f"{path}/edges")
    _write_schema(spark, path, [("node", (x,), stem[x], kinds[x,], counts[x,], dims[x,], [c for c in constraints if c.node == x], keys[x]) for x in labels] + [("relationship", k, stem[k], edge_kinds[k], edge_counts[k], edge_dims[k], [c for c in constraints if c.relationship == k[1]], None) for k in patterns])
    folders = {k: f"{path}/{'edges' if isinstance(k, tuple) else 'nodes'}/stem={s}" for k, s in stem.items()}
    return Exported(path, folders, state["keyless"])


def _write(spark: SparkSession, rows: DataFrame, stems: dict[tuple, str], by: tuple[str, ...], path: str) -> None:
    """One write. Rebalancing gives each folder few files and splits a label that holds most rows."""
    names = spark.createDataFrame([(*k, s) for k, s in stems.items()], ", ".join(f"`_{c}` string" for c in by) + ", stem string")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    placed = rows.join(names, same).select(*(_quoted(c) for c in rows.columns), "stem")
    placed.hint("rebalance", "stem").write.mode("overwrite").partitionBy("stem").parquet(path)


_SCHEMA = "what string, label string, type string, to_label string, stem string, property string, kind string, dimensions int, n_rows bigint, is_join_key boolean, is_key boolean, is_unique boolean, is_required boolean"


def _write_schema(spark: SparkSession, path: str, entries: list[tuple]) -> None:
    out = []
    for what, key, stem, kinds, n, dims, rules, join in entries:
        label, kind, to = (key[0], None, None) if what == "node" else key
        named = lambda k, rules=rules: {p for c in rules if c.kind == k for p in c.properties}
        declared = {**dict.fromkeys([*named("key"), *named("uniqueness"), *named("existence")], "STRING"), **kinds}
        if join == ID:
            declared = {ID: "STRING", **declared}
        out += [
            (what, label, kind, to, stem, p, t, dims.get(p), n, p == join, p in named("key"), p in named("uniqueness"), p in named("existence") | named("key")) for p, t in (declared or {None: None}).items()
        ]
    spark.createDataFrame(out, _SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/schema")


def read_schema(spark: SparkSession, path: str) -> DataFrame:
    """A row for each property of each label and pattern (a null one where there is none): kinds, dimensions, keys, rows."""
    return spark.read.parquet(f"{path}/schema")


def read_export(spark: SparkSession, path: str, key: str | tuple[str, str, str]) -> DataFrame:
    """One label's or pattern's rows with its own properties in its own types."""
    schema = read_schema(spark, path)
    what, fixed = ("edges", EDGE_COLUMNS) if isinstance(key, tuple) else ("nodes", NODE_COLUMNS)
    same = F.col("label").eqNullSafe(F.lit(key)) & (F.col("what") == "node")
    if isinstance(key, tuple):
        same = F.col("label").eqNullSafe(F.lit(key[0])) & F.col("type").eqNullSafe(F.lit(key[1])) & F.col("to_label").eqNullSafe(F.lit(key[2])) & (F.col("what") == "relationship")
    own = schema.where(same).collect()
    if not own:
        raise ValueError(f"nothing is exported under {key}")
    rows = spark.read.option("basePath", f"{path}/{what}").parquet(f"{path}/{what}/stem={own[0]['stem']}")
    props = {r["property"]: TYPES[r["kind"]] for r in own if r["property"] in rows.columns and r["property"] not in fixed}
    back = lambda n, t: F.from_json(_quoted(n), t).alias(n) if t.startswith("array") and isinstance(rows.schema[n].dataType, T.StringType) else F.col(_quoted(n)).cast(t).alias(n)
    return rows.select(*(_quoted(c) for c in fixed), *(back(n, t) for n, t in props.items()))
