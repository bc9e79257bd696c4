"""Schemas from a model's answer: cut to JSON, cleaned, cross-checked, validated. On the driver."""

from __future__ import annotations

import json
import re
from typing import Any

from graphloom.operators.answers import Model, repair_json
from graphloom.operators.prune import Constraint, GraphSchema, TypeRule


def parse_answer(answer: str) -> dict[str, Any]:
    """The first object of an answer that may be fenced, a list, or cut off."""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", answer, re.DOTALL)
    found = json.loads(repair_json(fenced[1] if fenced else answer))
    if isinstance(found, list):
        found = next((x for x in found if isinstance(x, dict)), {})
    return found


def _properties(item: dict[str, Any]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    named = [p if isinstance(p, dict) else {"name": p} for p in item.get("properties") or []]
    named = [p for p in named if p.get("name")]
    return tuple(dict.fromkeys(p["name"] for p in named)), tuple(p["name"] for p in named if p.get("required"))


def clean(found: dict[str, Any]) -> GraphSchema:
    """Bare strings become types; unlabelled items, labels without a property, and whatever names
    something undeclared are left out; a type declared twice is one with both's properties."""
    nodes: dict[str, TypeRule] = {}
    for item in found.get("node_types") or []:
        if isinstance(item, str):
            nodes.setdefault(item, TypeRule(item, ("name",), additional=True))
        elif isinstance(item, dict) and item.get("label"):
            props, required = _properties(item)
            if props:
                nodes.setdefault(item["label"], TypeRule(item["label"], props, required))
    rels: dict[str, TypeRule] = {}
    for item in found.get("relationship_types") or []:
        item = {"label": item} if isinstance(item, str) else item
        if isinstance(item, dict) and item.get("label"):
            props, required = _properties(item)
            old = rels.get(item["label"], TypeRule(item["label"]))
            rels[item["label"]] = TypeRule(item["label"], tuple(dict.fromkeys((*old.properties, *props))), tuple(dict.fromkeys((*old.required, *required))))
    patterns = []
    for p in found.get("patterns") or []:
        if isinstance(p, dict):
            p = (p.get("source"), p.get("relationship"), p.get("target"))
        if isinstance(p, list | tuple) and len(p) == 3 and p[0] in nodes and p[1] in rels and p[2] in nodes:
            patterns.append(tuple(p))
    constraints = []
    for c in found.get("constraints") or []:
        if isinstance(c, dict) and (rule := nodes.get(c.get("node_type") or c.get("label"))):
            props = tuple(x for x in c.get("properties") or [c.get("property_name")] if x)
            kind = str(c.get("type", "uniqueness")).lower()
            if props and set(props) <= set(rule.properties):
                constraints.append(Constraint(kind, props, node=rule.name))
    return GraphSchema(tuple(nodes.values()), tuple(rels.values()), tuple(dict.fromkeys(patterns)), tuple(dict.fromkeys(constraints)))


def schema_from_text(text: str, model: Model) -> GraphSchema:
    prompt = f"Give node_types, relationship_types, patterns and constraints of the text as JSON.\n{text}"
    return clean(parse_answer(model(prompt)))
