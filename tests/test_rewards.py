"""Rewards, tools and call readers on single cases."""

import json
from typing import Literal

import pytest
from pyspark.sql import functions as F

from sievemill.operators import rewards as W
from sievemill.operators import toolcalls as C
from sievemill.operators import tools as T


def test_guarded(spark):
    import pandas as pd

    assert W.guarded(lambda x: 1 / x)(pd.DataFrame({"x": [1, 0, 4]})) == [1.0, 0.0, 0.25]
    df = spark.createDataFrame([("no such", "t", "g")], "s string, t string, g string")
    with pytest.raises(Exception, match="no scorer"):
        df.select(W.score_by_source(F.col("s"), F.col("t"), F.col("g"))).collect()
    rows = spark.createDataFrame([("a", ["x", "y"]), ("a", ["x"]), ("b", []), ("b", None)], "s string, responses array<string>")
    assert [tuple(r) for r in W.evaluate(rows, "s", (F.col("response") == "x").cast("double")).collect()] == [("a", 0.75, 2)]
    assert W.rewards_of(df.withColumn("rewards", F.array(F.lit(1.0))), "s", "absent").columns == ["rewards", "s"]


def test_function_tool():
    @T.function_tool
    def find(query: str, k: int = 3, kind: Literal["a", "b"] = "a", names: list[str] | None = None) -> str:
        """Find it.

        More.
        """
        return f"{query}{k}"

    s = find.schema()["function"]
    assert (s["name"], s["description"], s["parameters"]["required"]) == ("find", "Find it.", ["query"])
    assert s["parameters"]["properties"] == {"query": {"type": "string"}, "k": {"type": "integer"}, "kind": {"type": "string", "enum": ["a", "b"]}, "names": {"type": "array", "items": {"type": "string"}}}
    find.create("i", context=1)
    assert find.execute("i", query="q")[0] == "q3" and "missing ['query']" in find.execute("i", z=1)[0]
    find.release("i")
    assert not find.instances and find.reward("i") == 0.0
    assert T.parameter_names(T.by_name(find)) == {"find": ["query", "k", "kind", "names"]}
    with pytest.raises(ValueError):
        T.by_name(find, T.FunctionTool(lambda: 1, "find"))


def test_schema_calls():
    tools = {"search": ["query"], "open": ["page"]}
    read = lambda t: [(n, json.loads(a)) for n, a in C.read_schema_calls(t, tools)]
    both = "<think>Both.</think><tool_calls><search><query>Alpha City founding</query></search><search><query> Beta\n</query></search></tool_calls>"
    assert read(both) == [("search", {"query": "Alpha City founding"}), ("search", {"query": "Beta"})]
    assert read('<tool_call>{"name":"search","arguments":{"query":"a"}}</tool_call><tool_call>{"name":"search","arguments":{"query":"b"}}</tool_call>') == [("search", {"query": "a"}), ("search", {"query": "b"})]
    assert read("<tool_calls><search><query> </query></search></tool_calls>") == [("search", {})]
    assert read("<tool_call>{bad}</tool_call>") == [("search", {})] and read("x <open> y <search>") == [("open", {})]
    assert read("plain") == [] and read(None) == [] and read("<think><tool_call>{}</tool_call></think>") == []
    assert read("<tool_calls><open><page>1</page></open><search><query>q</query></search><open></open></tool_calls>") == [("open", {"page": "1"}), ("search", {"query": "q"})]


def test_braced_calls():
    assert C.braced_arguments('a:1,b:<|"|>x, y:2<|"|>,c: 2.5 ,d:False,e:null,f:word') == {"a": 1, "b": "x, y:2", "c": 2.5, "d": False, "e": None, "f": "word"}
    assert C.braced_arguments("") == {} and C.braced_arguments(":x, k:") == {"k": ""}
    text = "so <|tool_call>call:f{a:1}<tool_call|><|tool_call>call:g{}<tool_call|><|tool_call>call:h{a:1}"
    assert C.read_braced_calls(text) == [("f", '{"a": 1}'), ("g", "{}")] and C.read_braced_calls(None) == []
