"""A graph as text in pages of bounded size, ordered over the whole graph.

Every fact is a line of its own with a sort key, so nothing is collected by node: an event of a million
participants is a million lines. Lines are ranged by key, and their places follow from totals of the ranges.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.operators.expand import props_summary
from graphloom.operators.state import established
from graphloom.sources.scratch import cut

#: Properties that a line's other parts say already.
SAID = ("name", "chapter", "story_order", "evidence_chunk")


@dataclass(frozen=True)
class DumpNames:
    """Labels and types with a place of their own in the text; edges of any other type are listed under their source."""

    character: str = "Character"
    state: str = "CharacterState"
    event: str = "Event"
    others: tuple[str, ...] = ("Item", "Location", "Organization")
    hidden: tuple[str, ...] = ("Chunk", "Chapter", "Story")
    has_state: str = "HAS_STATE"
    established: str = "ESTABLISHED_IN"
    evidence: str = "EVIDENCED_BY"
    about: str = "ABOUT"
    appears: str = "APPEARS_IN"
    hosts: str = "HOSTS"
    above: tuple[str, ...] = ("LOCATED_IN", "PART_OF")
    related: str = "RELATED_TO"

    @property
    def placed(self) -> tuple[str, ...]:
        return (self.has_state, self.established, self.about, self.appears, self.hosts, self.related, *self.above)


CHARACTERS, EVENTS, OTHERS = 1, 2, 3
HEADINGS = {CHARACTERS: "## Characters", EVENTS: "## Events", OTHERS: "## Items, locations, organisations"}
#: Places of a line within its section: node, then its lines, a state's own lines after it.
KEY = "section int, k1 bigint, k2 bigint, k3 string, owner string, part int, s1 bigint, s2 string, s3 string, sub int, t string"


def _has(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def lines(graph: PropertyGraph, names: DumpNames = DumpNames()) -> DataFrame:
    """section, k1 ... t, line: each line with its key.

    nodes: id, label, name, and where there are any chapter, story_order and a map ``props``; edges: src,
    type, dst and a map ``props``. An unnamed node is ``?``. Characters come by name, with their states by
    chapter and what they are related to, then states of no character; events by chapter and order, with
    places and participants; items, locations and organisations by label and name with what is above them.
    Nodes of other labels have no line of their own. Edges without both ends among the nodes that are shown have none either.
    """
    every = graph.nodes.select(
        "id", "label", F.coalesce(F.nullif("name", F.lit("")), F.lit("?")).alias("name"), _has(graph.nodes, "chapter", "bigint").alias("chapter"), _has(graph.nodes, "story_order", "bigint").alias("story_order"),
        (props_summary(F.map_filter("props", lambda k, v: ~k.isin(*SAID) & ~k.startswith("__"))) if "props" in graph.nodes.columns else F.lit("")).alias("extras"),
    )
    nodes = every.where(~F.col("label").isin(*names.hidden))
    said = props_summary("props") if "props" in graph.edges.columns else F.lit("")
    raw = graph.edges.select("src", "type", "dst", said.alias("said"))
    src = nodes.select(F.col("id").alias("src"), F.col("label").alias("a_label"), F.col("name").alias("a"), F.col("chapter").alias("a_chapter"), F.col("story_order").alias("a_order"))
    dst = nodes.select(F.col("id").alias("dst"), F.col("label").alias("b_label"), F.col("name").alias("b"), F.col("chapter").alias("b_chapter"), F.col("story_order").alias("b_order"))
    edges = raw.join(src, "src").join(dst, "dst")

    states = nodes.where(F.col("label") == names.state).select(F.col("id").alias("state"), F.col("name").alias("state_name"))
    own = lambda kind, label: raw.where(F.col("type") == kind).join(every.where(F.col("label") == label).select(F.col("id").alias("dst"), "chapter"), "dst").select(F.col("src").alias("state"), "chapter")
    at = established(states, own(names.established, names.event), own(names.evidence, "Chunk"))
    states = states.join(at, "state")
    has = edges.where(F.col("type") == names.has_state)
    held = has.where(F.col("a_label") == names.character).select(F.col("src").alias("owner"), F.col("a").alias("k3"), F.col("dst").alias("state")).join(states, "state")
    orphans = states.join(has.select(F.col("dst").alias("state")), "state", "left_anti")
    about = edges.where((F.col("type") == names.about) & (F.col("a_label") == names.state)).select(F.col("src").alias("state"), "b")

    fields = [f.split() for f in KEY.split(", ")]

    def rows(df: DataFrame, line: Column, **key) -> DataFrame:
        blank = {"int": 0, "bigint": 0, "string": ""}
        value = lambda n, k: F.coalesce(key[n].cast(k), F.lit(blank[k])) if n in key else F.lit(blank[k]).cast(k)
        return df.select(*(value(n, k).alias(n) for n, k in fields), line.alias("line"))

    c, lit, text = F.col, F.lit, lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    more = lambda x: F.when(x != "", F.concat(F.lit(" — "), x)).otherwise("")
    since = F.when(c("est").isNotNull(), text(" (since ", c("est").cast("string"), ")")).otherwise("")
    spot = F.when(c("chapter").isNotNull(), text(" (", c("chapter").cast("string"), F.when(c("story_order").isNotNull(), text(" #", c("story_order").cast("string"))).otherwise(""), ")")).otherwise("")
    of_state = {"section": lit(CHARACTERS), "s1": c("est"), "s2": c("state_name"), "s3": c("state")}
    held_key = {**of_state, "k3": c("k3"), "owner": c("owner"), "part": lit(1)}
    orphan_key = {**of_state, "k1": lit(1), "part": lit(0), "s1": lit(0)}
    character, event = nodes.where(c("label") == names.character), nodes.where(c("label") == names.event)
    other = nodes.where(c("label").isin(*names.others))
    into_event = lambda kind: edges.where((c("type") == kind) & (c("b_label") == names.event))
    event_key = {"section": lit(EVENTS), "k1": c("b_chapter"), "k2": c("b_order"), "k3": c("b"), "owner": c("dst")}
    generic = edges.where(~c("type").isin(*names.placed))
    generic_line = text("  · ", c("type"), " → ", c("b_label"), ":", c("b"), F.when(c("said") != "", text(" (", c("said"), ")")).otherwise(""))
    generic_key = {"part": lit(9), "s2": c("type"), "s3": c("b"), "t": c("dst")}
    parts = [
        rows(character, text("- (", c("label"), ") ", c("name"), more(c("extras"))), section=lit(CHARACTERS), k3=c("name"), owner=c("id")),
        rows(held, text("  · state: ", c("state_name"), since), **held_key),
        rows(held.join(about, "state"), text("    · about: ", c("b")), **held_key, sub=lit(1), t=c("b")),
        rows(edges.where((c("type") == names.related) & (c("a_label") == names.character)), text("  · related: ", c("b"), more(c("said"))), section=lit(CHARACTERS), k3=c("a"), owner=c("src"), part=lit(2), s2=c("b"), s3=c("dst"), t=c("said")),
        rows(generic.where(c("a_label") == names.character), generic_line, section=lit(CHARACTERS), k3=c("a"), owner=c("src"), **generic_key),
        rows(orphans, text("- (", lit(names.state), ", of nobody) ", c("state_name"), since), **orphan_key),
        rows(orphans.join(about, "state"), text("    · about: ", c("b")), **orphan_key, sub=lit(1), t=c("b")),
        rows(event, text("- (", c("label"), ") ", c("name"), spot), section=lit(EVENTS), k1=c("chapter"), k2=c("story_order"), k3=c("name"), owner=c("id")),
        rows(into_event(names.hosts), text("  · at: ", c("a")), **event_key, part=lit(1), s2=c("a"), s3=c("src")),
        rows(into_event(names.appears), text("  · with: ", c("a")), **event_key, part=lit(2), s2=c("a"), s3=c("src")),
        rows(generic.where(c("a_label") == names.event), generic_line, section=lit(EVENTS), k1=c("a_chapter"), k2=c("a_order"), k3=c("a"), owner=c("src"), **generic_key),
        rows(other, text("- (", c("label"), ") ", c("name"), more(c("extras"))), section=lit(OTHERS), k3=text(c("label"), "\t", c("name")), owner=c("id")),
        rows(edges.where(c("type").isin(*names.above) & c("a_label").isin(*names.others)), text("  · in: ", c("b")), section=lit(OTHERS), k3=text(c("a_label"), "\t", c("a")), owner=c("src"), part=lit(1), s2=c("b"), s3=c("dst"), t=c("type")),
        rows(generic.where(c("a_label").isin(*names.others)), generic_line, section=lit(OTHERS), k3=text(c("a_label"), "\t", c("a")), owner=c("src"), **generic_key),
    ]
    found = cut(reduce(DataFrame.unionByName, parts), "lines")
    heading = F.element_at(F.create_map(*(F.lit(x) for pair in HEADINGS.items() for x in pair)), F.col("section"))
    return found.unionByName(rows(found.select("section").distinct(), heading, section=c("section"), part=lit(-1), k1=lit(-(2**62)), k2=lit(0)))


def pages(found: DataFrame, size: int = 20_000) -> DataFrame:
    """section, page, body: lines in order, each value of at most ``size`` characters; the bodies joined in order are the whole text.

    A line ends with a line feed; one of more than half a page goes on in the next piece. A page that spans two
    sections is a row for each. No lines: no pages.
    """
    if size < 2:
        raise ValueError("a page has two characters or more")
    half = size // 2
    key = [f.split()[0] for f in KEY.split(", ")]
    whole = F.concat("line", F.lit("\n"))
    pieces = found.select(*key, "line", whole.alias("_w"), F.explode(F.sequence(F.lit(0), F.floor((F.char_length(whole) - 1) / half).cast("int"))).alias("piece"))
    pieces = pieces.select(*key, "line", "piece", F.substring(F.col("_w"), F.col("piece") * half + 1, F.lit(half)).alias("said"))
    order = [*key, "line", "piece"]
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(pieces.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()).withColumn("_n", F.char_length("said").cast("bigint")), "ranged")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(F.sum("_n").alias("_t")).select("_range", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"))  # a row a range
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumn("_end", F.sum("_n").over(within)).join(totals, "_range").withColumn("_start", F.col("_before") + F.col("_end") - F.col("_n"))
    paged = placed.withColumn("page", F.floor(F.col("_start") / (size - half)).cast("bigint"))
    body = F.array_sort(F.collect_list(F.struct("_start", "said")))
    return paged.groupBy("section", "page").agg(F.array_join(F.transform(body, lambda x: x.said), "").alias("body"))
