"""Tools: what a tool is, functions as tools with a schema read from their signature, and sets of them by name."""

from __future__ import annotations

import inspect
import types
import typing
from collections.abc import Callable

#: JSON types of Python ones.
_JSON = {str: "string", int: "integer", float: "number", bool: "boolean", list: "array", dict: "object"}


class Tool:
    """A tool keeps what it needs for an instance from create() to release()."""

    name: str = ""
    description: str = ""
    parameters: dict = {"type": "object", "properties": {}, "required": []}

    def __init__(self):
        self.instances: dict[str, dict] = {}

    def create(self, instance: str, **given) -> None:
        self.instances[instance] = given

    def execute(self, instance: str, **arguments) -> tuple[str, float, dict]:
        """(response, reward of the step, metrics)"""
        raise NotImplementedError

    def reward(self, instance: str) -> float:
        return 0.0

    def release(self, instance: str) -> None:
        self.instances.pop(instance, None)

    def schema(self) -> dict:
        return {"type": "function", "function": {"name": self.name, "description": self.description, "parameters": self.parameters}}


def _json_type(kind) -> dict:
    origin = typing.get_origin(kind)
    if origin is typing.Literal:
        return {"type": _JSON[type(typing.get_args(kind)[0])], "enum": list(typing.get_args(kind))}
    if origin in (typing.Union, types.UnionType):
        some = [a for a in typing.get_args(kind) if a is not type(None)]
        return _json_type(some[0]) if len(some) == 1 else {}
    if origin is list:
        return {"type": "array", "items": _json_type(typing.get_args(kind)[0])}
    found = _JSON.get(origin or kind)
    return {"type": found} if found else {}


class FunctionTool(Tool):
    """A function as a tool; its parameters are those of its signature, those without a default are required."""

    def __init__(self, run: Callable, name: str | None = None, description: str | None = None):
        super().__init__()
        self.run, self.name = run, name or run.__name__
        self.description = description if description is not None else (inspect.getdoc(run) or "").split("\n\n")[0]
        hints = typing.get_type_hints(run)
        given = {k: p for k, p in inspect.signature(run).parameters.items() if p.kind in (p.POSITIONAL_OR_KEYWORD, p.KEYWORD_ONLY)}
        self.parameters = {"type": "object", "properties": {k: _json_type(hints.get(k, str)) for k in given}, "required": [k for k, p in given.items() if p.default is p.empty]}

    def execute(self, instance: str, **arguments) -> tuple[str, float, dict]:
        unknown = arguments.keys() - self.parameters["properties"].keys()
        missing = [k for k in self.parameters["required"] if k not in arguments]
        if unknown or missing:
            return f"{self.name}: unknown {sorted(unknown)}, missing {missing}", 0.0, {"error": 1}
        return str(self.run(**arguments)), 0.0, {}


def function_tool(run: Callable | None = None, **named):
    """Decorator: the function as a tool."""
    return FunctionTool(run, **named) if run else lambda f: FunctionTool(f, **named)


def by_name(*tools: Tool) -> dict[str, Tool]:
    """Tools by name; two with one name raise."""
    out: dict[str, Tool] = {}
    for tool in tools:
        if tool.name in out:
            raise ValueError(f"two tools are named {tool.name!r}")
        out[tool.name] = tool
    return out


def parameter_names(tools: dict[str, Tool]) -> dict[str, list[str]]:
    """What the readers of calls need: the parameters of each tool."""
    return {n: list(t.parameters["properties"]) for n, t in tools.items()}
