"""Graph extraction as a stage that can be run again: repaired answers, retries, a table of what failed.

A model is any callable from a text to a text. Every chunk ends with an answer or an error, in a table; a
later run asks only for chunks without an answer, so what a lost executor or a model's outage costs is
one wave.
"""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import ship
from graphloom.sources.scratch import file_state

Model = Callable[[str], str]

EXTRACTED = "struct<nodes:array<struct<id:string,label:string,properties:map<string,string>>>,relationships:array<struct<type:string,start_node_id:string,end_node_id:string,properties:map<string,string>>>>"
ANSWERS = "chunk_id string, text_hash bigint, answer string, error string, attempts int"
#: Containers within each other that an answer may hold; deeper ones are an error.
MAX_DEPTH = 200

_WORDS = {"true": True, "True": True, "false": False, "False": False, "null": None, "None": None}
_NUMBER = re.compile(r"-?\d+(\.\d+)?([eE][+-]?\d+)?\Z")
_BARE = re.compile(r"""[^\s,:{}\[\]"'][^,:{}\[\]\n]*""")
#: What may follow the quote that ends a text.
_AFTER = re.compile(r"\s*([,:}\]]|\Z)")
#: After a brace that meets an open list: a key says that the list should have ended, a further element that the brace is one too many.
_KEY_NEXT = re.compile(r"""\s*,\s*("[^"\n]*"|'[^'\n]*'|\w+)\s*:""")
_MORE_NEXT = re.compile(r"\s*[,\]]")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


class UnreadableAnswerError(ValueError):
    """An answer holds nothing that could be read as JSON."""


def _text(source: str, at: int) -> tuple[str, int]:
    """The quoted text that starts at ``at`` and where it ends; a quote inside it that nothing of JSON follows is a letter of it."""
    quote, out, i = source[at], [], at + 1
    while i < len(source):
        c = source[i]
        if c == "\\" and i + 1 < len(source):
            e = source[i + 1]
            if e == "u" and re.match(r"[0-9a-fA-F]{4}", source[i + 2 : i + 6]):
                out.append(chr(int(source[i + 2 : i + 6], 16)))
                i += 6
                continue
            out.append(_ESCAPES.get(e, e))
            i += 2
            continue
        if c == quote and _AFTER.match(source, i + 1):
            return "".join(out), i + 1
        out.append(c)
        i += 1
    return "".join(out), i


def _lenient(source: str) -> object:
    """The value that ``source`` starts with, by a stack of open containers.

    Closers without an opener are passed over, a closer ends what is open inside its container (but see
    ``_KEY_NEXT``), and what is open at the end is closed. Quotes may be single, commas doubled or absent, words unquoted.
    """
    root: list = []
    stack: list[list] = [[root, None, False]]  # container, key, whether the key waits for its value
    i = 0

    def put(value: object) -> None:
        top = stack[-1]
        if isinstance(top[0], list):
            top[0].append(value)
        elif top[2]:
            top[0][top[1]] = value
            top[2] = False
        else:
            top[1], top[2] = value if isinstance(value, str) else json.dumps(value), True

    def close() -> None:
        box, key, waits = stack.pop()
        if isinstance(box, dict) and waits:
            box[key] = None

    while i < len(source):
        c = source[i]
        if c in "{[":
            box: dict | list = {} if c == "{" else []
            top = stack[-1]
            if isinstance(top[0], dict) and not top[2]:
                top[1], top[2] = "", True  # a container where a key should be
            put(box)
            stack.append([box, None, False])
            if len(stack) > MAX_DEPTH:
                raise UnreadableAnswerError("too deep")
        elif c in "}]":
            kind = dict if c == "}" else list
            if c == "}" and isinstance(stack[-1][0], list) and len(stack) > 1:
                if _KEY_NEXT.match(source, i + 1):
                    close()  # it stands for the list's closer
                    i += 1
                    continue
                if _MORE_NEXT.match(source, i + 1):
                    i += 1
                    continue
            if any(isinstance(s[0], kind) for s in stack[1:]):
                while not isinstance(stack[-1][0], kind):
                    close()
                close()
                if len(stack) == 1:
                    break
        elif c == "," and isinstance(stack[-1][0], dict) and stack[-1][2]:
            put(None)
        elif c in "\"'":
            value, i = _text(source, i)
            put(value)
            continue
        elif word := _BARE.match(source, i):
            bare = word.group().strip()
            put(_WORDS[bare] if bare in _WORDS else json.loads(bare) if _NUMBER.match(bare) and not re.match(r"-?0\d", bare) else bare)
            i = word.end()
            continue
        i += 1
    while len(stack) > 1:
        close()
    return root[0]


def repair_json(text: str | None) -> str:
    """The first object or list of an answer as JSON, mended where it is broken; valid JSON is returned as it stands, ``{}`` where there is none."""
    text = text or ""
    start = min((i for c in "{[" if (i := text.find(c)) >= 0), default=-1)
    if start < 0:
        return "{}"
    try:
        _, end = json.JSONDecoder().raw_decode(text, start)
        return text[start:end]
    except (ValueError, RecursionError):
        return json.dumps(_lenient(text[start:]), ensure_ascii=False)


def ask(model: Model, text: str, attempts: int = 3, least: float = 1.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None, int]:
    """answer, error, attempts: the model is asked again after an error or an unreadable answer, waiting twice as long each time, with jitter."""
    error = None
    for n in range(attempts):
        try:
            said = model(text)
            if not isinstance(said, str) or not any(c in said for c in "{["):
                raise UnreadableAnswerError("no JSON in the answer")
            return repair_json(said), None, n + 1
        except Exception as e:  # whatever a provider raises
            error = f"{type(e).__name__}: {e}"[:1000]
            if n + 1 < attempts:
                sleep(min(most, least * 2**n) * (0.5 + random.random() / 2))
    return None, error, attempts


def answers(chunks: DataFrame, model: Model, attempts: int = 3, concurrency: int = 4, least: float = 1.0, most: float = 60.0) -> DataFrame:
    """chunk_id, text_hash, answer, error, attempts: one row a chunk, ``concurrency`` calls at a time in a task.

    ``chunks``: chunk_id, chunk. A null text is asked as an empty one. Nothing raises here: errors are rows.
    """
    ship(chunks.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(concurrency) as pool:
            for b in batches:
                got = list(pool.map(lambda t: ask(model, t, attempts, least, most), b["chunk"].fillna("")))
                yield pd.DataFrame({"chunk_id": b["chunk_id"], "text_hash": b["text_hash"], "answer": [g[0] for g in got], "error": [g[1] for g in got], "attempts": [g[2] for g in got]})

    rows = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), _hash().alias("text_hash"), "chunk")
    return rows.mapInPandas(run, ANSWERS)


def _hash():
    return F.xxhash64(F.coalesce("chunk", F.lit("")))


def _runs(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(name.removeprefix("run=")) for name, *_ in file_state(spark, path) if name.startswith("run="))


def state(spark: SparkSession, path: str) -> DataFrame:
    """The last word on each chunk and text: its answer if any run had one, else the last run's error; ``runs`` asked."""
    if not _runs(spark, path):
        return spark.createDataFrame([], ANSWERS + ", runs bigint")
    rows = spark.read.schema(ANSWERS + ", run int").parquet(path)
    best = F.max_by(F.struct("answer", "error", "attempts"), F.struct(F.col("answer").isNotNull().alias("a"), "run"))
    return rows.groupBy("chunk_id", "text_hash").agg(best.alias("b"), F.count_distinct("run").alias("runs")).select("chunk_id", "text_hash", "b.*", "runs")


def failed(spark: SparkSession, path: str) -> DataFrame:
    return state(spark, path).where("answer is null")


def run(chunks: DataFrame, model: Model, path: str, waves: int = 1, **how) -> DataFrame:
    """Ask for all chunks without an answer under ``path``, and return the state of the given ones.

    Chunks are known by id and text: a changed text is asked again, a repeated row once. A wave is a share
    of the hashes and is written before the next one starts; a run that dies keeps its waves. ``how`` goes to ``answers``.
    """
    spark = chunks.sparkSession
    named = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), "chunk", _hash().alias("text_hash")).dropDuplicates(["chunk_id", "text_hash"])

    def within(done: DataFrame) -> DataFrame:
        return done.select(F.col("chunk_id").alias("_id"), F.col("text_hash").alias("_h"), *(c for c in done.columns if c not in ("chunk_id", "text_hash")))

    same = F.col("chunk_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_h"))
    for wave in range(waves):
        numbers = _runs(spark, path)
        todo = named.where(F.pmod(F.col("text_hash"), F.lit(waves)) == wave)
        if numbers:
            todo = todo.join(within(state(spark, path).where("answer is not null").select("chunk_id", "text_hash")), same, "left_anti")
        answers(todo, model, **how).write.mode("errorifexists").parquet(f"{path}/run={(numbers or [-1])[-1] + 1}")
    return named.drop("chunk").join(within(state(spark, path)), same).select("chunk_id", "text_hash", "answer", "error", "attempts", "runs")


def graph_of(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, label, props, chunk_id) and edges (src, type, dst, props) of answers; ids are prefixed by the chunk's.

    Properties that are not texts are JSON. Entries without an id, or ends, are left out; an answer that is no
    such object has no nodes.
    """
    read = found.where("answer is not null").select("chunk_id", F.from_json("answer", EXTRACTED).alias("g"))
    own = lambda c: F.concat_ws(":", "chunk_id", c)
    nodes = read.select("chunk_id", F.inline("g.nodes")).where("id is not null").select(own("id").alias("id"), "label", F.col("properties").alias("props"), "chunk_id")
    edges = read.select("chunk_id", F.inline("g.relationships")).where("start_node_id is not null and end_node_id is not null")
    return nodes, edges.select(own("start_node_id").alias("src"), "type", own("end_node_id").alias("dst"), F.col("properties").alias("props"))
