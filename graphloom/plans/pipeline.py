"""Pipelines of named components; Spark plans stay lazy, the graph only orders driver-side steps."""

from __future__ import annotations

import importlib
import inspect
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from graphloom.errors import PipelineDefinitionError


@dataclass
class Pipeline:
    """``connect(a, b, {param: "a" or "a.key"})`` passes a's result, or a part of it, to b."""

    components: dict[str, Callable[..., Any]] = field(default_factory=dict)
    inputs: dict[str, dict[str, str]] = field(default_factory=dict)
    after: dict[str, set[str]] = field(default_factory=dict)

    def add(self, name: str, component: Callable[..., Any]) -> Pipeline:
        if name in self.components:
            raise PipelineDefinitionError(f"{name} is there already")
        self.components[name] = component
        self.inputs[name], self.after[name] = {}, set()
        return self

    def connect(self, source: str, target: str, config: dict[str, str] | None = None) -> Pipeline:
        if not {source, target} <= self.components.keys():
            raise PipelineDefinitionError(f"{source} or {target} is unknown")
        for param, origin in (config or {}).items():
            if param in self.inputs[target]:
                raise PipelineDefinitionError(f"{target}.{param} has a source already")
            if origin.split(".")[0] not in self.components:
                raise PipelineDefinitionError(f"{origin} is unknown")
            self.inputs[target][param] = origin
        self.after[target].add(source)
        self.order()
        return self

    def order(self) -> list[str]:
        done: list[str] = []
        rest = dict(self.after)
        while rest:
            ready = [n for n in rest if self.after[n] <= set(done)]
            if not ready:
                raise PipelineDefinitionError("the pipeline has a cycle")
            done += ready
            for n in ready:
                del rest[n]
        return done

    def check(self, data: dict[str, dict[str, Any]]) -> None:
        for name, component in self.components.items():
            given = self.inputs[name].keys() | data.get(name, {}).keys()
            params = inspect.signature(component).parameters.values()
            wanted = {p.name for p in params if p.default is p.empty and p.kind in (p.POSITIONAL_OR_KEYWORD, p.KEYWORD_ONLY)}
            if missing := wanted - given:
                raise PipelineDefinitionError(f"{name} lacks {sorted(missing)}")

    def stream(self, data: dict[str, dict[str, Any]] | None = None) -> Iterator[dict[str, Any]]:
        """Events of a run: pipeline and component starts and ends; the last one has the results."""
        data = data or {}
        self.check(data)
        results: dict[str, Any] = {}
        yield {"event": "PIPELINE_STARTED"}
        for name in self.order():
            yield {"event": "TASK_STARTED", "task": name}
            args = dict(data.get(name, {}))
            for param, origin in self.inputs[name].items():
                source, _, part = origin.partition(".")
                value = results[source]
                args[param] = (value[part] if isinstance(value, dict) else getattr(value, part)) if part else value
            try:
                results[name] = self.components[name](**args)
            except Exception as e:
                yield {"event": "TASK_FAILED", "task": name, "error": str(e)}
                yield {"event": "PIPELINE_FAILED"}
                raise
            yield {"event": "TASK_FINISHED", "task": name}
        used = {o.split(".")[0] for i in self.inputs.values() for o in i.values()} | {s for a in self.after.values() for s in a}
        yield {"event": "PIPELINE_FINISHED", "results": {n: r for n, r in results.items() if n not in used}}

    def run(self, data: dict[str, dict[str, Any]] | None = None) -> dict[str, Any]:
        """Results of the components that nothing follows."""
        last: dict[str, Any] = {}
        for last in self.stream(data):
            pass
        return last["results"]


def resolve(value: Any, config: dict[str, Any]) -> Any:
    """``{"resolver_": "ENV", "var_": NAME}`` and ``{"resolver_": "CONFIG_KEY", "key_": "a.b"}`` by what they name."""
    if isinstance(value, dict) and value.get("resolver_") == "ENV":
        return os.environ[value["var_"]]
    if isinstance(value, dict) and value.get("resolver_") == "CONFIG_KEY":
        found: Any = config
        for key in value["key_"].split("."):
            found = found[key]
        return resolve(found, config)
    if isinstance(value, dict):
        return {k: resolve(v, config) for k, v in value.items()}
    return [resolve(v, config) for v in value] if isinstance(value, list) else value


def from_config(config: dict[str, Any]) -> tuple[Pipeline, dict[str, dict[str, Any]]]:
    """A pipeline and its run parameters of a dictionary with ``component_config`` and ``connection_config``."""
    out, run_params = Pipeline(), {}
    for name, spec in config["component_config"].items():
        module, _, attribute = spec["class_"].rpartition(".")
        made = getattr(importlib.import_module(module), attribute)
        if params := resolve(spec.get("params_", {}), config):
            made = made(**params)
        elif inspect.isclass(made):
            made = made()
        out.add(name, made)
        run_params[name] = resolve(spec.get("run_params_", {}), config)
    for c in config.get("connection_config", []):
        out.connect(c["start"], c["end"], c.get("input_config"))
    return out, run_params
