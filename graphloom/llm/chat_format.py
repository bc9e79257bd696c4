"""Chat formatting with DataFrame functions only (operator 1).

Records arrive in many layouts: rows by turn, message lists, prompt and completion, instruction
and output. The nested field paths of a record, restricted to the names that some layout knows,
are hashed; the fingerprint selects a declarative mapping to canonical turns (conversation, turn,
role, text). For tables the fingerprint comes from the schema, once; for JSON records it is
computed for each row. Where no fingerprint fits exactly (a clashing extra column), the layout
with the most paths among those present is taken; with none, tables raise ``ValueError`` and JSON
records give no turns.

The template marks turns and escapes control strings inside texts reversibly:
``\\`` becomes ``\\0``, ``<|`` becomes ``\\1`` and, in roles, a line feed ``\\2``.
The loss mask is a list of byte spans of the formatted text, one for each assistant text.

Null roles and texts count as empty, null turns come first, ties of turn go by role and text,
repeated rows stay, rows of a null conversation form one. A formatted conversation is one string
value, so its rows meet in one task (in a spillable sort) and Spark's limit of 2 GB a value holds.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>\n"
TURNS = "array<struct<turn:bigint,role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """``paths`` must be there; ``turns`` is SQL for an array of turns (None: a row is a turn)."""

    name: str
    paths: frozenset[str]
    turns: str | None

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.paths)


def _pair(user: str, assistant: str) -> str:
    return f"array(named_struct('turn', 0L, 'role', 'user', 'text', {user}), named_struct('turn', 1L, 'role', 'assistant', 'text', {assistant}))"


def _each(items: str, role: str, text: str) -> str:
    return f"transform({items}, (m, i) -> named_struct('turn', CAST(i AS BIGINT), 'role', {role}, 'text', m.{text}))"


_ROLES = "CASE m.from WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.from END"

LAYOUTS = (
    Layout("rows", frozenset({"conv_id", "turn", "role", "text"}), None),
    Layout("messages", frozenset({"messages[].role", "messages[].content"}), _each("messages", "m.role", "content")),
    Layout("from_value", frozenset({"conversations[].from", "conversations[].value"}), _each("conversations", _ROLES, "value")),
    Layout("instruction_input", frozenset({"instruction", "input", "output"}), _pair("concat_ws('\\n\\n', instruction, nullif(input, ''))", "output")),
    Layout("instruction", frozenset({"instruction", "output"}), _pair("instruction", "output")),
    Layout("prompt_completion", frozenset({"prompt", "completion"}), _pair("prompt", "completion")),
    Layout("prompt_response", frozenset({"prompt", "response"}), _pair("prompt", "response")),
)
#: What each JSON layout is parsed into; the mapping then reads it like a table's columns.
JSON_SCHEMA = (
    "messages array<struct<role:string,content:string>>, conversations array<struct<from:string,value:string>>, "
    "instruction string, input string, output string, prompt string, completion string, response string"
)
#: Contents that are lists of parts; plain strings are null in it.
PARTS_SCHEMA = "messages array<struct<content:array<struct<type:string,text:string>>>>"
#: The messages with the texts of such lists joined.
_WITH_PARTS = (
    "transform(r.messages, (m, i) -> named_struct('role', m.role, 'content', "
    "coalesce(array_join(transform(try_element_at(p.messages, i + 1).content, x -> coalesce(x.text, '')), ''), m.content)))"
)


def fingerprint(paths: frozenset[str] | set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def schema_paths(kind: T.DataType, prefix: str = "") -> set[str]:
    """Dotted paths of all leaves; ``[]`` steps into arrays."""
    if isinstance(kind, T.StructType):
        return {p for f in kind.fields for p in schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)}
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{prefix}[]")
    return {prefix}


def choose_layout(schema: T.StructType, layouts: tuple[Layout, ...] = LAYOUTS) -> Layout:
    known = frozenset().union(*(x.paths for x in layouts))
    present = schema_paths(schema) & known
    by_print = {x.fingerprint: x for x in layouts}
    if exact := by_print.get(fingerprint(present)):
        return exact
    fits = [x for x in layouts if x.paths <= present]
    if not fits:
        raise ValueError(f"no layout knows the paths {sorted(schema_paths(schema))}")
    return max(fits, key=lambda x: len(x.paths))


def canonical_turns(df: DataFrame, conv_id: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """conv_id, turn, role, text of a table in any known layout."""
    layout = choose_layout(df.schema, layouts)
    if layout.turns is None:
        return df.select(F.col(conv_id).alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return df.select(F.col(conv_id).alias("conv_id"), F.inline(F.expr(layout.turns).cast(TURNS)))


def _prefixed(names: Column, prefix: str) -> Column:
    return F.transform(names, lambda n: F.concat(F.lit(prefix), n))


def _element_keys(record: str, items: str) -> Column:
    """The names that any element of a list of objects has."""
    each = F.from_json(F.get_json_object(record, f"$.{items}"), "array<map<string,string>>")
    names = F.flatten(F.transform(each, lambda m: F.coalesce(F.map_keys(m), F.array().cast("array<string>"))))
    return F.coalesce(F.array_distinct(names), F.array().cast("array<string>"))


def canonical_json_turns(df: DataFrame, conv_id: str, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """conv_id, layout fingerprint and turns of JSON records, each in a layout of its own."""
    layouts = tuple(x for x in layouts if x.turns is not None)
    known = sorted(frozenset().union(*(x.paths for x in layouts)))
    lists = sorted({p.split("[]")[0] for p in known if "[]" in p})
    keys = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))
    inner = [_prefixed(_element_keys(record, x), f"{x}[].") for x in lists]
    present = F.filter(F.concat(keys, *inner), lambda p: p.isin(*known))
    seen = df.select(F.col(conv_id).alias("conv_id"), F.col(record).alias("_json"), F.array_sort(F.array_distinct(present)).alias("_paths"))
    seen = seen.withColumn("fingerprint", F.sha2(F.array_join("_paths", "\n"), 256))
    rest = F.lit(None).cast("string")
    for x in sorted(layouts, key=lambda x: len(x.paths)):  # the largest that is contained, if no fingerprint fits
        rest = F.when(F.size(F.array_except(F.array(*map(F.lit, sorted(x.paths))), F.col("_paths"))) == 0, F.lit(x.fingerprint)).otherwise(rest)
    exact = F.when(F.col("fingerprint").isin(*(x.fingerprint for x in layouts)), F.col("fingerprint")).otherwise(rest)
    both = seen.select("conv_id", exact.alias("fingerprint"), F.from_json("_json", JSON_SCHEMA).alias("r"), F.from_json("_json", PARTS_SCHEMA).alias("p"))
    parsed = both.select("conv_id", "fingerprint", "r.*", F.expr(_WITH_PARTS).alias("_whole")).withColumn("messages", F.col("_whole")).drop("_whole")
    turns = F.lit(None).cast(TURNS)
    for x in layouts:
        turns = F.when(F.col("fingerprint") == x.fingerprint, F.expr(x.turns).cast(TURNS)).otherwise(turns)
    return parsed.select("conv_id", "fingerprint", turns.alias("turns"))


def escape(text: Column, line: bool = False) -> Column:
    out = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\0")), F.lit("<|"), F.lit("\\1"))
    return F.replace(out, F.lit("\n"), F.lit("\\2")) if line else out


def unescape(text: Column, line: bool = False) -> Column:
    out = F.replace(text, F.lit("\\2"), F.lit("\n")) if line else text
    return F.replace(F.replace(out, F.lit("\\1"), F.lit("<|")), F.lit("\\0"), F.lit("\\"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted text, loss_spans (byte start and length of each assistant text).

    One shuffle: the window's partitioning serves the aggregation too.
    """
    head = F.concat(F.lit(START), escape(F.col("role"), line=True), F.lit("\n"))
    body = escape(F.col("text"))
    made = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.octet_length(head).alias("head_len"), F.octet_length(body).alias("body_len"), F.concat(head, body, F.lit(END)).alias("piece"),
    )
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    made = made.withColumn("at", F.coalesce(F.sum(F.octet_length("piece").cast("long")).over(before), F.lit(0)))
    span = F.when(F.col("role") == "assistant", F.struct((F.col("at") + F.col("head_len")).alias("start"), F.col("body_len").cast("long").alias("length")))
    listed = made.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "piece", span.alias("span")))).alias("parts"))
    return listed.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: p.piece), "").alias("formatted"),
        F.filter(F.transform("parts", lambda p: p.span), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def parse_chats(formatted: DataFrame) -> DataFrame:
    """The way back: turns (role, text) by the marks, loss_text by the mask, both unescaped."""
    pieces = F.split("formatted", r"<\|im_end\|>\n")
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        body = F.substring(piece, F.lit(len(START) + 1), F.char_length(piece))
        role = F.substring_index(body, "\n", 1)
        text = F.substring(body, F.char_length(role) + 2, F.char_length(body))
        return F.struct(unescape(role, line=True).alias("role"), unescape(text).alias("text"))

    cut = lambda s: F.substring(F.col("formatted").cast("binary"), (s.start + 1).cast("int"), s.length.cast("int")).cast("string")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(cut(s))), "")
    return formatted.select("*", F.transform(pieces, turn).alias("turns"), loss.alias("loss_text"))
