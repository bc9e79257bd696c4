"""Metadata filters: nested dicts compiled to Columns (null fields never match).

Operators are known in capitals too. ``$like`` is a substring test after the trailing ``%`` are cut (a leading one is literal); malformed
filters, empty lists included, raise ``FilterValidationError``.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.errors import FilterValidationError


def _elements(values: Any) -> list:
    if not isinstance(values, list | tuple) or not values:
        raise FilterValidationError("a non-empty list is expected")
    if any(isinstance(v, bool) or not isinstance(v, str | int | float) for v in values):
        raise FilterValidationError("only strings and numbers can be elements")
    return list(values)


def _between(c: Column, bounds: Any) -> Column:
    if not isinstance(bounds, list | tuple) or len(bounds) != 2:
        raise FilterValidationError("$between takes a lower and an upper bound")
    return c.between(*bounds)


def _text(value: Any) -> str:
    if not isinstance(value, str):
        raise FilterValidationError("a string is expected")
    return value.rstrip("%")


COMPARE: dict[str, Callable[[Column, Any], Column]] = {
    "$eq": operator.eq,
    "$ne": operator.ne,
    "$lt": operator.lt,
    "$lte": operator.le,
    "$gt": operator.gt,
    "$gte": operator.ge,
}
OPERATORS: dict[str, Callable[[Column, Any], Column]] = COMPARE | {
    "$between": _between,
    "$in": lambda c, v: c.isin(_elements(v)),
    "$nin": lambda c, v: ~c.isin(_elements(v)),
    "$like": lambda c, v: F.contains(c, F.lit(_text(v))),
    "$ilike": lambda c, v: F.contains(F.lower(c), F.lower(F.lit(_text(v)))),
}
LOGIC = {"$and": operator.and_, "$or": operator.or_}


def field(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _walk(spec: Any, leaf: Callable[[str, str, Any], Any], join: Callable[[str, list], Any]) -> Any:
    if not isinstance(spec, dict):
        raise FilterValidationError("a filter is a dictionary")
    if not spec:
        raise FilterValidationError("a filter is not empty")
    parts = []
    for name, value in spec.items():
        if (logic := name.lower()) in LOGIC:
            if not isinstance(value, list | tuple) or not value:
                raise FilterValidationError(f"{name} takes a non-empty list")
            parts.append(join(logic, [_walk(v, leaf, join) for v in value]))
        elif name.startswith("$"):
            raise FilterValidationError(f"{name} is not a field")
        elif isinstance(value, dict):
            if len(value) != 1:
                raise FilterValidationError(f"{name} takes one operator")
            ((op, operand),) = value.items()
            op = op.lower() if isinstance(op, str) else op
            if op not in OPERATORS:
                raise FilterValidationError(f"{op} is not supported")
            parts.append(leaf(name, op, operand))
        else:
            parts.append(leaf(name, "$eq", value))
    return parts[0] if len(parts) == 1 else join("$and", parts)


def compile_filter(spec: dict[str, Any]) -> Column:
    """The predicate; literals stay Columns, so pushdown to the scan is Catalyst's."""
    return _walk(spec, lambda name, op, v: OPERATORS[op](field(name), v), lambda op, parts: reduce(LOGIC[op], parts))


def filter_fields(spec: dict[str, Any]) -> list[str]:
    found: list[str] = []
    _walk(spec, lambda name, op, v: found.append(name), lambda op, parts: None)
    return list(dict.fromkeys(found))


def index_compatible(spec: dict[str, Any]) -> bool:
    """Only comparisons, ranges and conjunctions can be answered inside a vector index."""
    return _walk(spec, lambda name, op, v: op in COMPARE and op != "$ne" or op == "$between", lambda op, parts: op == "$and" and all(parts))
