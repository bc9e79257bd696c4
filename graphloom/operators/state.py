"""Append-only states: histories, states as of a point, recent windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def alias_list(aliases: Column | str) -> Column:
    """Aliases as an array, from a comma string."""
    aliases = F.col(aliases) if isinstance(aliases, str) else aliases
    return F.filter(F.transform(F.split(F.coalesce(aliases, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def established(states: DataFrame, event_chapters: DataFrame, chunk_chapters: DataFrame) -> DataFrame:
    """state, est: the least chapter of its events, else of its chunks, else null (state kept)."""
    by_event = event_chapters.groupBy("state").agg(F.min("chapter").alias("by_event"))
    by_chunk = chunk_chapters.groupBy("state").agg(F.min("chapter").alias("by_chunk"))
    return states.select("state").distinct().join(by_event, "state", "left").join(by_chunk, "state", "left").select("state", F.coalesce("by_event", "by_chunk").alias("est"))


def history(states: DataFrame, entity: Column | None, at: str, state: str, up_to=None) -> DataFrame:
    """States of an entity in order, unknown points last; with ``up_to`` these are dropped."""
    out = states if entity is None else states.where(entity)
    if up_to is not None:
        out = out.where(F.col(at) <= F.lit(up_to))
    return out.orderBy(F.asc_nulls_last(at), state)


def entity_history(
    characters: DataFrame, related: DataFrame, has_state: DataFrame, states: DataFrame, established_in: DataFrame, evidence: DataFrame, about: DataFrame, entity: str, up_to=None
) -> DataFrame:
    """character, related, content, source_desc, chapter, targets, evidence: a character's states in order.

    characters: id, name, aliases (array), found by name or alias; related: src, type, dst, description,
    met in either direction; has_state: character, state; states: state, name, description;
    established_in: state, chapter; evidence: state, chapter, text; about: state, target. A state
    without a known chapter comes last, and goes where ``up_to`` is given.
    """
    who = characters.where((F.col("name") == entity) | F.coalesce(F.array_contains("aliases", entity), F.lit(False))).select("id", F.col("name").alias("character"))
    both = related.select(F.col("src").alias("id"), F.col("dst").alias("other"), "type", "description").unionByName(related.select(F.col("dst").alias("id"), F.col("src").alias("other"), "type", "description"))
    met = both.join(who, "id", "left_semi").join(characters.select(F.col("id").alias("other"), "name"), "other")
    listed = met.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("name", "type", "description"))).alias("related"))
    own = who.join(has_state.withColumnRenamed("character", "id"), "id").join(states, "state")
    wanted = own.select("state").distinct()
    of = lambda rows: rows.join(wanted, "state", "left_semi")
    by_event = of(established_in).groupBy("state").agg(F.min("chapter").alias("_e"))
    by_chunk = of(evidence).groupBy("state").agg(F.min("chapter").alias("_c"), F.array_sort(F.collect_set("text")).alias("evidence"))
    targets = of(about).groupBy("state").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    out = own.join(by_event, "state", "left").join(by_chunk, "state", "left").join(targets, "state", "left").join(listed, "id", "left")
    out = out.withColumn("chapter", F.coalesce("_e", "_c"))
    if up_to is not None:
        out = out.where(F.col("chapter") <= F.lit(up_to))
    empty = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c)
    return out.select("character", empty("related"), F.col("name").alias("content"), F.col("description").alias("source_desc"), "chapter", empty("targets"), empty("evidence"), "state").orderBy(F.asc_nulls_last("chapter"), "state").drop("state")


def as_of(states: DataFrame, keys: Sequence[str], at: str, order: str, up_to=None) -> DataFrame:
    """The latest state of each key at or before ``up_to``: one pre-aggregating pass, no window."""
    rows = states if up_to is None else states.where(F.col(at) <= F.lit(up_to))
    rest = [c for c in states.columns if c not in keys]
    best = rows.where(F.col(at).isNotNull()).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, order)).alias("s"))
    return best.select(*keys, "s.*")


def recent(rows: DataFrame, at: str, n: int) -> DataFrame:
    """The last n by ``at``, in ascending order."""
    return rows.orderBy(F.desc(at)).limit(n).orderBy(at)


def ranked_story(rows: DataFrame, group: str, at: str, key: str) -> DataFrame:
    return rows.withColumn("story_rank", F.row_number().over(Window.partitionBy(group).orderBy(at, key)))


def format_state(chapter: Column, name: Column, text: Column, targets: Column, others: Column | None = None) -> Column:
    """``7: name (text) [about: a, b] [with: c (TYPE), d]``, parts without content left out.

    ``others``: structs with ``name`` and ``type``; those without a name are left out.
    """

    def part(head: str, listed: Column, tail: str) -> Column:
        return F.when(F.coalesce(listed, F.lit("")) != "", F.concat(F.lit(head), listed, F.lit(tail))).otherwise("")

    about = F.array_join(F.array_sort(F.filter(targets, lambda t: t.isNotNull() & (t != ""))), ", ")
    parts = [F.coalesce(chapter.cast("string"), F.lit("?")), F.lit(": "), name, part(" (", text, ")"), part(" [about: ", about, "]")]
    if others is not None:
        named = F.filter(others, lambda o: F.coalesce(o.getField("name"), F.lit("")) != "")
        shown = F.transform(named, lambda o: F.concat(o.getField("name"), part(" (", o.getField("type"), ")")))
        parts.append(part(" [with: ", F.array_join(shown, ", "), "]"))
    return F.concat(*parts)
