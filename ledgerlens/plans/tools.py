"""Queries and recipes as tools: parameters with types, validation before a call, consent where a tool reaches outside."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from . import registry


@dataclass(frozen=True)
class Parameter:
    """A parameter's type, whether it must be given, and the values it may have if they are few."""

    kind: type
    required: bool = True
    choices: tuple = ()


@dataclass(frozen=True)
class Tool:
    """What a tool is called with, and whether it needs consent to a purpose."""

    name: str
    run: Callable[..., DataFrame]
    parameters: dict[str, Parameter] = field(default_factory=dict)
    purpose: str | None = None

    def problems(self, arguments: dict) -> list[str]:
        """What is wrong with the arguments, empty if nothing (U3). Truth values aren't numbers."""
        found = [f"unknown argument {a!r}" for a in arguments if a not in self.parameters]
        for name, p in self.parameters.items():
            value = arguments.get(name)
            if value is None:
                found += [f"missing argument {name!r}"] * p.required
            elif not isinstance(value, p.kind) or isinstance(value, bool) and p.kind is not bool:
                found.append(f"{name!r} wants {p.kind.__name__}")
            elif p.choices and value not in p.choices:
                found.append(f"{name!r} wants one of {', '.join(map(str, p.choices))}")
        return found


_TOOLS: dict[str, Tool] = {}


def register(tool: Tool) -> Tool:
    if tool.name in _TOOLS:
        raise ValueError(f"tool {tool.name!r} is there already")
    _TOOLS[tool.name] = tool
    return tool


def names() -> list[str]:
    return sorted(_TOOLS)


def call(spark: SparkSession, name: str, arguments: dict, consents: frozenset[str] = frozenset()) -> DataFrame:
    """The tool's result; raises with the reasons if the call isn't valid, or if a purpose has no consent."""
    if name not in _TOOLS:
        raise KeyError(f"unknown tool {name!r}; one of {', '.join(names())}")
    tool = _TOOLS[name]
    if wrong := tool.problems(arguments):
        raise ValueError("; ".join(wrong))
    if tool.purpose is not None and tool.purpose not in consents:
        raise PermissionError(f"{name!r} needs consent to {tool.purpose!r}")
    return tool.run(spark, **arguments)


def _query(spark: SparkSession, query: str, sf_dir: str) -> DataFrame:
    return registry.QUERIES[query](spark, sf_dir)


register(Tool("run_query", _query, {"query": Parameter(str, choices=tuple(sorted(registry.QUERIES))), "sf_dir": Parameter(str)}))
