"""Schema-driven pruning of extracted graphs; what goes is kept with its reason.

nodes: id, label, props (map<string,string>); edges: src, type, dst, props.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.errors import SchemaValidationError

#: The six reasons.
MISSING_LABEL, NOT_IN_SCHEMA = "MISSING_LABEL", "NOT_IN_SCHEMA"
NO_PROPERTY_LEFT, MISSING_REQUIRED, INVALID_END, INVALID_PATTERN = "NO_PROPERTY_LEFT", "MISSING_REQUIRED_PROPERTY", "INVALID_START_OR_END_NODE", "INVALID_PATTERN"


@dataclass(frozen=True)
class TypeRule:
    """Declared properties of a label or type; ``required`` ones must be declared to count.

    ``additional`` says whether others may stay; by default, only where none is declared.
    """

    name: str
    properties: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    additional: bool | None = None

    @property
    def open(self) -> bool:
        return not self.properties if self.additional is None else self.additional


@dataclass(frozen=True)
class Constraint:
    """``kind``: existence, uniqueness or key, of a label or of a relationship type."""

    kind: str
    properties: tuple[str, ...]
    node: str | None = None
    relationship: str | None = None


@dataclass(frozen=True)
class GraphSchema:
    nodes: tuple[TypeRule, ...] = ()
    relationships: tuple[TypeRule, ...] = ()
    patterns: tuple[tuple[str, str, str], ...] = ()
    constraints: tuple[Constraint, ...] = ()
    additional_nodes: bool | None = None
    additional_relationships: bool | None = None
    additional_patterns: bool | None = None
    _: None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        labels, types = [n.name for n in self.nodes], [r.name for r in self.relationships]
        for name in labels:
            if name.startswith("__") or name.endswith("__"):
                raise SchemaValidationError(f"{name}: labels do not start or end with __")
        if len(set(types)) < len(types):
            raise SchemaValidationError("a relationship type is declared twice")
        if self.patterns and not types:
            raise SchemaValidationError("patterns need relationship types")
        for a, t, b in self.patterns:
            if a not in labels or b not in labels or t not in types:
                raise SchemaValidationError(f"pattern ({a}, {t}, {b}) uses an undeclared name")
        if self.additional_patterns is False and self.open_relationships:
            raise SchemaValidationError("without additional patterns there are no additional relationship types")
        self._check_constraints()

    def _check_constraints(self) -> None:
        by_kind: dict[tuple, set] = {}
        for c in self.constraints:
            if (c.node is None) == (c.relationship is None):
                raise SchemaValidationError("a constraint is about a label or about a relationship type")
            owner = next((r for r in (self.nodes if c.node else self.relationships) if r.name == (c.node or c.relationship)), None)
            if owner is None or not set(c.properties) <= set(owner.properties):
                raise SchemaValidationError(f"{c}: undeclared owner or property")
            if c.kind == "existence" and len(c.properties) != 1:
                raise SchemaValidationError("existence is about one property")
            by_kind.setdefault((c.node, c.relationship, c.kind), set()).add(c.properties)
        for (node, rel, kind), found in by_kind.items():
            keys = by_kind.get((node, rel, "key"), set())
            if kind == "uniqueness" and found & keys:
                raise SchemaValidationError("a key is unique already")
            if kind == "existence" and {p[0] for p in found} & {x for k in keys for x in k}:
                raise SchemaValidationError("a key property exists already")

    @property
    def open_nodes(self) -> bool:
        return not self.nodes if self.additional_nodes is None else self.additional_nodes

    @property
    def open_relationships(self) -> bool:
        return not self.relationships if self.additional_relationships is None else self.additional_relationships

    @property
    def open_patterns(self) -> bool:
        return not self.patterns if self.additional_patterns is None else self.additional_patterns

    def mandatory(self, rule: TypeRule, node: bool) -> tuple[str, ...]:
        own = [c for c in self.constraints if c.kind in ("existence", "key") and (c.node if node else c.relationship) == rule.name]
        wanted = {*rule.required, *(p for c in own for p in c.properties)}
        return tuple(sorted(wanted & set(rule.properties)))


def _rules(spark: SparkSession, schema: GraphSchema, nodes: bool, name: str) -> DataFrame:
    """A row for each declared name: a table as small as the schema."""
    rows = [(r.name, list(r.properties), r.open, list(schema.mandatory(r, nodes))) for r in (schema.nodes if nodes else schema.relationships)]
    return spark.createDataFrame(rows, f"{name} string, _props array<string>, _open boolean, _must array<string>")


def _allowed(props: Column) -> Column:
    """Allowed properties with a value; undeclared labels keep all."""
    filled = F.map_filter(props, lambda k, v: v.isNotNull())
    return F.when(F.coalesce(F.col("_open"), F.lit(True)), filled).otherwise(F.map_filter(filled, lambda k, v: F.array_contains("_props", k)))


def prune_nodes(nodes: DataFrame, schema: GraphSchema, lexical: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Kept nodes and pruned ones (with ``reason``); nodes of ``lexical`` labels pass unchecked."""
    rules = F.broadcast(_rules(nodes.sparkSession, schema, True, "label"))
    joined = nodes.join(rules, "label", "left").withColumn("_kept", _allowed(F.coalesce("props", F.create_map().cast("map<string,string>"))))
    known = F.col("_props").isNotNull()
    bypass = F.col("label").isin(*lexical) if lexical else F.lit(False)
    reason = (
        F.when(bypass, F.lit(None))
        .when(F.coalesce("label", F.lit("")) == "", MISSING_LABEL)
        .when(F.coalesce("id", F.lit("")) == "", MISSING_REQUIRED)
        .when(~known & F.lit(not schema.open_nodes), NOT_IN_SCHEMA)
        .when(known & (F.size("_kept") == 0), NO_PROPERTY_LEFT)
        .when(known & (F.size(F.array_except("_must", F.map_keys("_kept"))) > 0), MISSING_REQUIRED)
    )
    judged = joined.withColumn("reason", reason).withColumn("props", F.when(bypass, F.col("props")).otherwise(F.col("_kept"))).drop("_kept", "_props", "_open", "_must")
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def prune_edges(edges: DataFrame, kept_nodes: DataFrame, schema: GraphSchema) -> tuple[DataFrame, DataFrame]:
    """Kept edges and pruned ones (with ``reason``).

    An edge against its pattern is turned round if its reverse is a pattern and its own direction
    is none; undeclared directions stay only with additional patterns.
    """
    spark = edges.sparkSession
    ends = kept_nodes.select("id", "label")
    joined = edges.join(ends.toDF("src", "_a"), "src", "left").join(ends.toDF("dst", "_b"), "dst", "left")
    joined = joined.join(F.broadcast(_rules(spark, schema, False, "type")), "type", "left")
    patterns = spark.createDataFrame(list(schema.patterns), "_a string, type string, _b string")
    joined = joined.join(F.broadcast(patterns.withColumn("_fits", F.lit(True))), ["_a", "type", "_b"], "left")
    joined = joined.join(F.broadcast(patterns.select(F.col("_a").alias("_b"), "type", F.col("_b").alias("_a"), F.lit(True).alias("_turned"))), ["_a", "type", "_b"], "left")
    known, fits = F.col("_props").isNotNull(), F.coalesce("_fits", F.lit(False))
    turned = ~fits & F.coalesce("_turned", F.lit(False))
    kept = _allowed(F.coalesce("props", F.create_map().cast("map<string,string>")))
    reason = (
        F.when(F.coalesce("type", F.lit("")) == "", MISSING_LABEL)
        .when(F.col("_a").isNull() | F.col("_b").isNull(), INVALID_END)
        .when(~known & F.lit(not schema.open_relationships), NOT_IN_SCHEMA)
        .when(known & ~fits & ~turned & F.lit(bool(schema.patterns) and not schema.open_patterns), INVALID_PATTERN)
        .when(known & (F.size(F.array_except("_must", F.map_keys(kept))) > 0), MISSING_REQUIRED)
    )
    judged = joined.select(F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("src"), "type", F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("dst"), kept.alias("props"), turned.alias("turned"), reason.alias("reason"))
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def pruned_properties(rows: DataFrame, schema: GraphSchema, nodes: bool = True) -> DataFrame:
    """name, property, n: properties with a value that declared labels (or types) do not allow."""
    name = "label" if nodes else "type"
    joined = rows.join(F.broadcast(_rules(rows.sparkSession, schema, nodes, name)), name).where(~F.col("_open"))
    listed = joined.select(F.col(name).alias("name"), "_props", F.explode(F.map_entries("props")).alias("p")).where("p.value is not null")
    gone = listed.where(~F.array_contains("_props", F.col("p.key")))
    return gone.groupBy("name", F.col("p.key").alias("property")).agg(F.count("*").alias("n"))


def prune_graph(nodes: DataFrame, edges: DataFrame, schema: GraphSchema, lexical: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kept nodes, kept edges, statistics (what, reason, n)."""
    kept, gone = prune_nodes(nodes, schema, lexical)
    wired, loose = prune_edges(edges, kept, schema)
    stats = gone.select(F.lit("node").alias("what"), "reason").unionByName(loose.select(F.lit("relationship").alias("what"), "reason"))
    return kept, wired, stats.groupBy("what", "reason").agg(F.count("*").alias("n"))
