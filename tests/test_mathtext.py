"""Graders and readers on single cases."""

import pytest
from pyspark.sql import functions as F

from sievemill.operators import mathtext as M


def values(spark, f, cases):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, a string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("a"))).collect()]


@pytest.mark.parametrize(
    "f, cases",
    [
        (M.boxed_answer, [(r"\boxed{a{b}c} d}", "a{b}c"), (r"\boxed{1} \boxed{2", None), (r"\boxed{}", ""), (r"x \boxed 5$ y", "5"), (r"\fbox{3}", None), ("", None), (None, None), (r"\boxed{1} \boxed 2 \boxed{3}", r"2 \boxed{3}")]),
        (M.braced_answer, [(r"\boxed{1} \boxed{2}", "2"), (r"\boxed 2", None), (None, None)]),
        (M.latex_normal, [("0.5", r"\frac{1}{2}"), (".5", r"\frac{1}{2}"), ("3/4", r"\frac{3}{4}"), ("03/4", "03/4"), (r"\dfrac12", r"\frac{1}{2}"), (r"\frac1{72}", r"\frac{1}{72}"), (r"\frac{72}1", r"\frac{72}1"), (r"x = \sqrt3", r"\sqrt{3}"), (r"5\text{ cm}", "5"), (r"5\text{ a}\text{ b}", None), (r"\sqrt", None), (r"\frac", None), (r"\frac1", r"\frac1"), (r"90^\circ", "90"), (r"10\%", "10"), ("", ""), ("a=b=c", "a=b=c"), ("abc=1", "abc=1")]),
        (M.final_answer, [("x = 1,000", "1000"), ("$5$ dollars", "5"), (r"\frac12", r"\frac{1}{2}"), (r"\sqrt2", r"\sqrt{2}"), (r"\text{yes}", "yes"), (r"\boxed{7}", "7"), ("an apple", "apple"), ("", ""), ("1,2,x", "1,2,x")]),
        (M.stated_answer, [("Answer: 1\nanswer : 42", "42"), ("none", "[INVALID]"), (None, "[INVALID]")]),
        (M.think_and_box, [("<think>a</think>\n\\boxed{1} z", 1.0), ("\\boxed{1}", 0.0), (None, 0.0)]),
        (M.without_calls, [("a<tool_call>x\ny</tool_call>b", "ab"), (None, "")]),
    ],
)
def test_cases(spark, f, cases):
    assert values(spark, f, cases) == [w for _, w in cases]


def test_strict_box_and_equality(spark):
    rows = spark.createDataFrame([(r"so \boxed{5}", "5"), (r"\boxed{5}" + "x" * 200, "5"), ("Answer: 5", "5"), (None, None)], "t string, g string")
    got = rows.select(M.math_stated(F.col("t"), F.col("g"), True)["score"], M.math_stated(F.col("t"), F.col("g"))["score"], M.math_boxed(F.col("t"), F.col("g"))).collect()
    assert [tuple(r) for r in got] == [(1.0, -1.0, 1.0), (-1.0, -1.0, 1.0), (-1.0, 1.0, 0.0), (-1.0, -1.0, 0.0)]


def test_calls(spark):
    text = '<tool_call>{"name": "f", "arguments": {"a": [1, "x"]}}</tool_call><tool_call>{"name": "g"}</tool_call><tool_call>{bad</tool_call>'
    channel = "<|channel|>analysis<|message|><|start|>assistant<|channel|>c to=functions.no <|constrain|>json<|message|>{}<|call|><|end|><|start|>assistant<|channel|>c to=functions.f <|constrain|>json<|message|>{1<|call|>"
    df = spark.createDataFrame([(text, channel), (None, None)], "a string, b string")
    a, none = df.select(M.json_calls(F.col("a")), M.channel_calls(F.col("b"))).collect()
    assert [tuple(x) for x in a[0]] == [("f", '{"a":[1,"x"]}')] and [tuple(x) for x in a[1]] == [("f", "{1")]
    assert none[0] == [] and none[1] == []
