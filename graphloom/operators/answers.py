"""Question answering on the driver: generated SQL, tools, prompts, answers.

Language models are callables ``str -> str``; nothing here is distributed but the queries it runs.
"""

from __future__ import annotations

import inspect
import json
import random
import re
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.errors import GeneratedQueryError, PromptError
from graphloom.operators.extraction import answers, graph_of, repair_json as repair_json

Model = Callable[[str], str]


@dataclass(frozen=True)
class PromptTemplate:
    template: str
    inputs: tuple[str, ...]

    def __post_init__(self) -> None:
        missing = [i for i in self.inputs if "{" + i + "}" not in self.template]
        if missing:
            raise PromptError(f"placeholders are missing: {missing}")

    def format(self, **values: Any) -> str:
        if missing := [i for i in self.inputs if i not in values]:
            raise PromptError(f"inputs are missing: {missing}")
        return reduce(lambda text, i: text.replace("{" + i + "}", str(values[i])), self.inputs, self.template)


TEXT_TO_SQL = PromptTemplate("Write one SQL query.\nSchema:\n{schema}\nExamples:\n{examples}\nQuestion: {question}\nSQL:", ("schema", "examples", "question"))
ANSWER = PromptTemplate("Answer from the context only.\nContext:\n{context}\nExamples:\n{examples}\nQuestion: {question}\nAnswer:", ("context", "examples", "question"))
SUMMARY = PromptTemplate("Summarise the conversation.\n{history}", ("history",))


def extract_sql(answer: str) -> str:
    fenced = re.search(r"```(?:sql)?\s*(.*?)```", answer, re.DOTALL | re.IGNORECASE)
    return (fenced[1] if fenced else answer).strip().rstrip(";").strip()


def check_read_only(spark: SparkSession, sql: str) -> str:
    """The statement, if Spark parses it as one query of known nodes, functions and relations.

    The parsed plan is walked, its subqueries and common table expressions too: a plan node, an expression
    or a function that is not listed, or a relation that is not registered (paths in ``format.`path```), is refused.
    So are names that are made by expressions, ``IDENTIFIER(...)``, and parameters. ``now``, ``stddev_pop``, ``extract``,
    samples and pipe syntax are not listed.
    """
    if not re.match(r"(?is)\s*(select|with|\()", sql):
        raise GeneratedQueryError(f"not a query: {sql[:80]}")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise GeneratedQueryError(f"cannot be parsed: {sql[:80]}") from e
    known: set[str] = set()
    todo, relations = [plan], []
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind in _EXPRESSIONS_WITH_NAMES:
            name = (node.name().unquotedString() if kind == "UnresolvedGenerator" else node.nameParts().mkString(".")).lower()
            if name not in _FUNCTIONS:
                raise GeneratedQueryError(f"function {name} is not allowed")
        elif isinstance_of(spark, node, "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan"):
            if kind not in _NODES:
                raise GeneratedQueryError(f"not read-only: {kind}")
            if kind == "UnresolvedRelation":
                relations.append(node.multipartIdentifier().mkString("\0").split("\0"))
            if kind == "UnresolvedWith":
                for i in range(node.cteRelations().size()):
                    known.add(node.cteRelations().apply(i)._1().lower())
            todo += _items(node.expressions())
            todo += _items(node.innerChildren())
        elif kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
            todo.append(node.plan())
        elif kind not in _EXPRESSIONS:
            raise GeneratedQueryError(f"expression {kind} is not allowed")
        todo += _items(node.children())
    for parts in relations:
        if not (len(parts) == 1 and parts[0].lower() in known) and not spark.catalog.tableExists(".".join(f"`{p}`" for p in parts)):
            raise GeneratedQueryError(f"{'.'.join(parts)} is not a registered relation")
    return sql


def _items(found: Any) -> list:
    return [x for x in (found.apply(i) for i in range(found.size())) if hasattr(x, "children")]


def isinstance_of(spark: SparkSession, found: Any, name: str) -> bool:
    return spark._jvm.java.lang.Class.forName(name, True, found.getClass().getClassLoader()).isInstance(found)


#: What a read-only query is made of before analysis.
_NODES = frozenset(
    "Project Filter Aggregate Join Sort GlobalLimit LocalLimit Offset Distinct Union Except Intersect SubqueryAlias UnresolvedRelation UnresolvedWith "
    "UnresolvedHaving UnresolvedInlineTable UnresolvedSubqueryColumnAliases WithWindowDefinition OneRowRelation LateralJoin Generate Pivot Unpivot "
    "UnresolvedOrdinal Expand Window ResolvedInlineTable LocalRelation".split()
)
_EXPRESSIONS = frozenset(
    "Literal UnresolvedAttribute UnresolvedStar UnresolvedStarExceptOrReplace UnresolvedAlias Alias AttributeReference UnresolvedExtractValue UnresolvedOrdinal "
    "UnresolvedNamedLambdaVariable LambdaFunction And Or Not EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan GreaterThanOrEqual In InSubquery IsNull IsNotNull "
    "Like ILike RLike LikeAll LikeAny NotLikeAll NotLikeAny Between Add Subtract Multiply Divide IntegralDivide Remainder UnaryMinus UnaryPositive BitwiseAnd BitwiseOr BitwiseXor "
    "BitwiseNot CaseWhen If Coalesce Cast Concat SortOrder UnresolvedWindowExpression WindowExpression WindowSpecDefinition SpecifiedWindowFrame UnspecifiedFrame$ "
    "CurrentRow$ UnboundedPreceding$ UnboundedFollowing$ CreateNamedStruct CreateStruct StringTrim StringTrimLeft StringTrimRight StringLocate Substring Overlay TimestampAdd "
    "TimestampDiff CurrentDate CurrentTimestamp Rollup Cube GroupingSets NamePlaceholder$".split()
)
_EXPRESSIONS_WITH_NAMES = ("UnresolvedFunction", "UnresolvedGenerator")
_FUNCTIONS = frozenset(
    "abs acos any any_value approx_count_distinct array array_agg array_contains array_distinct array_join array_max array_min array_position array_size asin "
    "atan avg between bool_and bool_or cardinality cast ceil ceiling char_length coalesce collect_list collect_set concat concat_ws contains corr cos count count_if "
    "cume_dist current_date current_timestamp date date_add date_diff date_format date_sub date_trunc datediff day dayofmonth dayofweek dayofyear dense_rank "
    "element_at endswith every exp explode explode_outer filter first first_value floor from_unixtime get_json_object greatest hour if ifnull ilike in initcap instr "
    "isnotnull isnull lag last last_value lcase lead least left length levenshtein like ln locate log log10 log2 lower lpad ltrim map_keys map_values max max_by "
    "mean median min min_by minute mod mode month months_between named_struct nth_value ntile nullif nvl nvl2 percent_rank percentile percentile_approx pmod "
    "posexplode position pow power quarter rank regexp_count regexp_extract regexp_like regexp_replace replace reverse right rlike round row_number rpad rtrim "
    "second sequence sign size slice some sort_array split sqrt startswith std stddev struct substr substring substring_index sum to_date to_timestamp "
    "transform translate trim trunc try_divide ucase unix_timestamp upper var_pop variance weekday when window year".split()
)


def retry(call: Callable[[], Any], attempts: int = 3, least: float = 1.0, most: float = 60.0, factor: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Any:
    """Call again after errors, waiting longer each time, with jitter."""
    for n in range(attempts):
        try:
            return call()
        except Exception:
            if n + 1 == attempts:
                raise
            sleep(min(most, least * factor**n) * (0.5 + random.random() / 2))


@dataclass
class TextToSql:
    spark: SparkSession
    model: Model
    schema: str = ""
    examples: Sequence[str] = ()

    def search(self, question: str) -> tuple[DataFrame, dict[str, str]]:
        sql = extract_sql(self.model(TEXT_TO_SQL.format(schema=self.schema, examples="\n".join(self.examples), question=question)))
        return self.spark.sql(check_read_only(self.spark, sql)), {"sql": sql}


JSON_TYPES = {str: "string", int: "integer", float: "number", bool: "boolean", list: "array", dict: "object"}


@dataclass(frozen=True)
class Tool:
    """A named function with parameters inferred from its signature."""

    name: str
    description: str
    run: Callable[..., Any]
    limits: dict[str, dict[str, float]] = field(default_factory=dict)

    def parameters(self) -> dict[str, Any]:
        props, required = {}, []
        for p in inspect.signature(self.run).parameters.values():
            kind = {"int": int, "float": float, "str": str, "bool": bool}.get(p.annotation, p.annotation) if isinstance(p.annotation, str) else p.annotation
            props[p.name] = {"type": JSON_TYPES.get(kind, "string"), **self.limits.get(p.name, {})}
            if p.default is inspect.Parameter.empty:
                required.append(p.name)
        return {"type": "object", "properties": props, "required": required, "additionalProperties": False}


def retriever_tool(name: str, description: str, search: Callable[..., Any]) -> Tool:
    return Tool(name, description, search, {"top_k": {"minimum": 1}, "alpha": {"minimum": 0, "maximum": 1}})


@dataclass
class ToolsRetriever:
    """A chooser names tools and arguments; their results are one frame (tool_name, content).

    A tool that fails does not end the others: its error is in the metadata.
    """

    spark: SparkSession
    choose: Callable[[str, Sequence[Tool]], Sequence[tuple[str, dict[str, Any]]]]
    tools: Sequence[Tool]

    def search(self, question: str) -> tuple[DataFrame, dict[str, Any]]:
        by_name = {t.name: t for t in self.tools}
        frames, errors = [], {}
        for name, args in self.choose(question, self.tools):
            try:
                frames.append(tool_rows(self.spark, name, by_name[name].run(**args)))
            except Exception as e:  # what a tool raises is its own
                errors[name] = f"{type(e).__name__}: {e}"
        empty = self.spark.createDataFrame([], "tool_name string, content string")
        return reduce(DataFrame.unionByName, frames, empty), {"errors": errors}


def tool_rows(spark: SparkSession, name: str, result: Any) -> DataFrame:
    """Frames, lists and single values as rows (tool_name, content)."""
    if isinstance(result, DataFrame):
        return result.select(F.lit(name).alias("tool_name"), F.to_json(F.struct(*result.columns)).alias("content"))
    values = result if isinstance(result, list | tuple) else [result]
    return spark.createDataFrame([(name, v if isinstance(v, str) else json.dumps(v)) for v in values], "tool_name string, content string")


@dataclass
class GraphAnswers:
    """Retrieve, build the context of at most top-k rows, ask the model."""

    retrieve: Callable[..., DataFrame]
    model: Model
    content: str = "content"
    fallback: str | None = None

    def search(self, question: str, history: Sequence[dict[str, str]] = (), examples: str = "", **config: Any) -> dict[str, Any]:
        if not question:
            raise PromptError("the question is empty")
        asked = question
        if history:
            said = "\n".join(f"{m['role']}: {m['content']}" for m in history)
            asked = f"Summary of the conversation: {self.model(SUMMARY.format(history=said))}\nQuestion: {question}"
        rows = [r[self.content] for r in self.retrieve(asked, **config).collect()]
        if not rows and self.fallback is not None:
            return {"answer": self.fallback, "context": []}
        return {"answer": self.model(ANSWER.format(context="\n".join(rows), examples=examples, question=question)), "context": rows}


def extract_graph(chunks: DataFrame, model: Callable[[str], str], on_error: str = "IGNORE") -> tuple[DataFrame, DataFrame]:
    """nodes and edges that a model names in each chunk; ids are prefixed by the chunk's.

    One lazy plan that asks for each of the two frames; ``extraction.run`` asks once and keeps what failed.
    What cannot be repaired is no graph, or raises with ``RAISE``.
    """
    found = answers(chunks, model)
    if on_error == "RAISE":
        failure = F.concat_ws(": ", F.lit("extraction"), "chunk_id", "error")
        found = found.withColumn("answer", F.when(F.col("error").isNull(), F.col("answer")).otherwise(F.raise_error(failure).cast("string")))
    return graph_of(found)
