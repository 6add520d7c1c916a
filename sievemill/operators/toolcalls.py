"""Tool calls in function tags, and the reward for calls that should have been made. Null text counts as empty."""

from __future__ import annotations

import ast
import json
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..registry import TOOL_PARSERS
from ..session import ship
from .searchtext import json_objects
from .tags import Tags

# The tags of a function call, and the names of types.
_CALL = re.compile(r"<tool_call>(.*?)(?:</tool_call>|\Z)", re.DOTALL)
_FUNCTION = re.compile(r"<function=(.*?)</function>|<function=(.*)\Z", re.DOTALL)
_PARAMETER = re.compile(r"<parameter=(.*?)(?:</parameter>|\Z)", re.DOTALL)
_TEXT = ("string", "str", "text", "varchar", "char", "enum")
_WHOLE = ("int", "uint", "long", "short", "unsigned")


def _number(raw: str) -> int | float:
    x = float(raw)
    return int(x) if x.is_integer() else x


def typed(raw: str, kind: str | None):
    """A parameter's text as a value of its declared type; what does not fit stays text. Values are read, never run."""
    kind = (kind or "string").strip().lower()
    if raw.lower() == "null":
        return None
    if kind in _TEXT:
        return raw
    if kind in ("boolean", "bool", "binary"):
        return raw.lower() == "true"
    if kind.startswith(_WHOLE):
        readers = [int]
    elif kind.startswith(("num", "float")):
        readers = [_number]
    else:
        readers = ([json.loads] if kind == "object" or kind.startswith("dict") else []) + [ast.literal_eval]
    for read in readers:
        try:
            return read(raw)
        except (ValueError, SyntaxError, OverflowError, TypeError, MemoryError, RecursionError):
            continue
    return raw


def read_function_calls(text: str | None, types: dict[str, dict[str, str]]) -> list[tuple[str, str]]:
    """(name, arguments as JSON) of every function in tool-call tags; one that is cut off ends with the text. A malformed call voids all."""
    out = []
    for block in _CALL.findall(text or ""):
        for closed, open_ in _FUNCTION.findall(block):
            name, mark, body = (closed or open_).partition(">")
            given = {}
            for part in _PARAMETER.findall(body):
                key, has, value = part.partition(">")
                if not has:
                    return []
                given[key] = typed(value.removeprefix("\n").removesuffix("\n"), types.get(name, {}).get(key))
            if not mark:
                return []
            try:
                out.append((name, json.dumps(given, ensure_ascii=False)))
            except TypeError:
                return []
    return out


@TOOL_PARSERS.register("function-tags")
def function_calls(text: Column, types: dict[str, dict[str, str]]) -> Column:
    """Array of (name, arguments) of calls in function tags; types: tool -> parameter -> declared type."""
    ship(SparkSession.getActiveSession())

    return _calls_udf(lambda x: read_function_calls(x, types))(text)


def bag_share(a: list, b: list) -> float:
    """Common over all elements of two bags; equal lists 1, an empty one 0."""
    if a == b:
        return 1.0
    both = (Counter(a) & Counter(b)).total()
    return both / (len(a) + len(b) - both) if a and b else 0.0


def call_match(gold: list[dict], made: list[dict]) -> float:
    """How well calls (name, parameters) match, 0 to 1: names as bags, then for each gold call the best unused call of its name."""
    if gold == made:
        return 1.0
    score, most, free = bag_share([g["name"] for g in gold], [m["name"] for m in made]), 1.0, list(made)
    for want in gold:
        p = want["parameters"]
        most += 1 + len(p)
        fit = [(bag_share(list(p), list(m["parameters"])) + sum(k in m["parameters"] and m["parameters"][k] == v for k, v in p.items()), -i) for i, m in enumerate(free) if m["name"] == want["name"]]
        if fit and max(fit)[0] > 0:
            gain, at = max(fit)
            score += gain
            del free[-at]
    return score / most


def tool_call_reward(gold: Column, made: Column, most: float = 3.0, least: float = -3.0) -> Column:
    """least to most by call_match of two JSON arrays of (name, parameters); what is no such array earns least."""
    ship(SparkSession.getActiveSession())

    @F.pandas_udf("double")
    def run(g: pd.Series, m: pd.Series) -> pd.Series:
        def one(a, b):
            try:
                return least + (most - least) * call_match(json.loads(a), json.loads(b))
            except (ValueError, TypeError, KeyError, AttributeError):
                return least

        return pd.Series([one(a, b) for a, b in zip(g, m)], dtype="float64")

    return run(gold, made)


def _tag_arguments(body: str, known: list[str]) -> dict[str, str]:
    """The known parameters of a call whose tags hold some text: of each the first."""
    tags = Tags(body, tuple(known), exact=True) if known else None
    out = {}
    for name in known:
        first = next((body[s.first : s.last].strip() for s in tags.spans(name)), "")
        if first:
            out[name] = first
    return out


#: How far a call is to be believed: a tag of its tool in a batch, a JSON object in a block, an opened tag alone.
IN_BATCH, IN_BLOCK, TRIED = range(3)


def candidate_calls(text: str, tools: dict[str, list[str]]):
    """(kind, place, name, arguments) of whatever looks like a call; arguments are the tool's known ones, None where they can't be read."""
    marks, names = Tags(text, ("tool_calls", "tool_call"), exact=True), Tags(text, tuple(tools), exact=True)
    first = next(iter(marks.spans("tool_calls")), None)
    if first is not None:
        body = text[first.first : first.last]
        inner = Tags(body, tuple(tools), exact=True)
        yield from ((IN_BATCH, s.start, name, _tag_arguments(body[s.first : s.last], tools[name])) for name in tools for s in inner.spans(name))
    for block in marks.spans("tool_call"):
        objects, whole = json_objects(text[block.first : block.last])
        for o in objects:
            yield IN_BLOCK, block.start, o.get("name"), _known_arguments(o, tools) if whole else None
    opened = lambda t: t.bare and not t.closing
    yield from ((TRIED, t.start, t.name, {}) for t in names.all if opened(t))
    if any(opened(t) for t in marks.all):
        yield TRIED, len(text), next(iter(tools)), {}


def _known_arguments(call: dict, tools: dict[str, list[str]]) -> dict | None:
    """The arguments, given as an object or as its text, that the called tool has."""
    known, given = tools.get(call["name"]) if isinstance(call.get("name"), str) else None, call.get("arguments", {})
    try:
        given = json.loads(given) if isinstance(given, str) else given
    except ValueError:
        return None
    return {k: given[k] for k in given if k in known} if known is not None and isinstance(given, dict) else None


def read_schema_calls(text: str | None, tools: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(name, arguments as JSON) of one turn's calls of known tools with known parameters; thoughts hold none.

    Only calls of the most credible kind that is there count, those with arguments; of mere trials the first, without any.
    """
    said, at = "", 0
    for s in Tags(text or "", ("think",)).spans("think"):
        said, at = f"{said}{text[at : s.start]} ", s.end
    found = sorted(((k, place, i, name, given) for i, (k, place, name, given) in enumerate(candidate_calls(said + (text or "")[at:], tools)) if given or k == TRIED), key=lambda c: c[:3])
    best = [(name, given) for k, _, _, name, given in found if k == found[0][0]]
    return [(name, json.dumps(given, ensure_ascii=False)) for name, given in (best[:1] if found and found[0][0] == TRIED else best)]


def _calls_udf(read):
    """Array of (name, arguments) that read(text) gives; texts are read one at a time from the batch, calls put into its columns as they come."""

    @F.arrow_udf("array<struct<name:string,arguments:string>>")
    def run(t: pa.Array) -> pa.Array:
        names, arguments, edge = [], [], [0]
        for x in t:
            for name, given in read(x.as_py()):
                names.append(name)
                arguments.append(given)
            edge.append(len(names))
        calls = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(arguments, pa.string())], ["name", "arguments"])
        return pa.ListArray.from_arrays(pa.array(edge, pa.int32()), calls)

    return run


@TOOL_PARSERS.register("search-batch")
def schema_calls(text: Column, tools: dict[str, list[str]]) -> Column:
    """Array of (name, arguments) by read_schema_calls; tools: parameters by tool."""
    ship(SparkSession.getActiveSession())
    return _calls_udf(lambda x: read_schema_calls(x, tools) if tools else [])(text)


# The marks of a braced call and of a quoted value in it.
BRACED, CLOSED, QUOTE = "<|tool_call>", "<tool_call|>", '<|"|>'
_CONSTANTS = {"true": True, "false": False, "null": None}


def _plain_value(raw: str):
    raw = raw.strip()
    if raw.lower() in _CONSTANTS:
        return _CONSTANTS[raw.lower()]
    for kind in (int, float):
        try:
            return kind(raw)
        except ValueError:
            continue
    return raw


def braced_arguments(body: str) -> dict:
    """key:value pairs; a value between quote marks is text, any other runs up to a comma or a closing brace."""
    out, at = {}, 0
    while (colon := body.find(":", at)) >= 0:
        start = colon
        while start > at and (body[start - 1].isalnum() or body[start - 1] == "_"):
            start -= 1
        if start == colon:
            at = colon + 1
            continue
        key, rest = body[start:colon], colon + 1
        end = body.find(QUOTE, rest + len(QUOTE)) if body.startswith(QUOTE, rest) else -1
        if end >= 0:
            out[key], at = body[rest + len(QUOTE) : end], end + len(QUOTE)
            continue
        at = min((k for k in (body.find(",", rest), body.find("}", rest)) if k >= 0), default=len(body))
        out[key] = _plain_value(body[rest:at])
    return out


def read_braced_calls(text: str | None) -> list[tuple[str, str]]:
    """(name, arguments as JSON) of the calls BRACED call:name{...} CLOSED; one that is not closed so counts for nothing."""
    out, text, at = [], text or "", 0
    while (at := text.find(BRACED + "call:", at)) >= 0:
        start = at + len(BRACED) + 5
        brace = start
        while brace < len(text) and (text[brace].isalnum() or text[brace] == "_"):
            brace += 1
        end = text.find("}" + CLOSED, brace + 1)
        if brace > start and text[brace : brace + 1] == "{" and end >= 0:
            out.append((text[start:brace], json.dumps(braced_arguments(text[brace + 1 : end]), ensure_ascii=False)))
            at = end
        at += 1
    return out


@TOOL_PARSERS.register("gemma4")
def braced_calls(text: Column) -> Column:
    """Array of (name, arguments) by read_braced_calls, which gets the text from its first call on, and none without any."""
    ship(SparkSession.getActiveSession())
    first = F.locate(BRACED + "call:", text)
    return _calls_udf(read_braced_calls)(F.when(first > 0, F.substr(text, first)))


def before_calls(text: Column, calls: Column | None = None) -> Column:
    """The text before the first braced call; all of it without any whole call. calls: its braced_calls, if they are at hand."""
    return F.when(F.size(braced_calls(text) if calls is None else calls) > 0, F.substring_index(text, BRACED, 1)).otherwise(F.coalesce(text, F.lit("")))
