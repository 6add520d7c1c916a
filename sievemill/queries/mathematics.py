"""Graders and tool-call readers over texts made from conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mathequal as Q
from ..operators import mathtext as M
from ..operators import searchtext as X
from ..session import table
from .base import query, r

_FROM = "FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL"


def _made(s, d, *parts: str):
    """conv_id, turn, role, id (text) and made: the parts in a row, of which `text`, `role` and `id` stand for those columns."""
    c = table(s, d, "conversations").where("text IS NOT NULL AND role IS NOT NULL").withColumn("id", F.col("conv_id").cast("string"))
    return c.withColumn("made", F.concat(*[F.col(p) if p in ("text", "role", "id") else F.lit(p) for p in parts]))


query("boxed_answer", rf"SELECT conv_id, turn, '\tfrac{{' || conv_id || '}}7\!' AS answer, '\frac{{' || conv_id || '}}7' AS normal, {r('1', 'score')} {_FROM}")(
    lambda s, d: _made(s, d, "text", r" \boxed{1} so \boxed{\tfrac{", "id", r"}7\!} and {more}.").select("conv_id", "turn", M.boxed_answer(F.col("made")).alias("answer"), M.latex_normal(M.boxed_answer(F.col("made"))).alias("normal"), M.math_boxed(F.col("made"), F.concat(F.lit(r"x = \frac{ "), "id", F.lit("}7"))).alias("score"))
)
query("dapo_normalise", f"SELECT conv_id, turn, conv_id || '000' AS pred, {r('CASE WHEN conv_id = 7 THEN 1 ELSE -1 END', 'score')}, conv_id = 7 AS acc {_FROM}")(
    lambda s, d: _made(s, d, "text", "\nAnswer: y = $", "id", ",000$ km").select("conv_id", "turn", M.math_stated(F.col("made"), F.lit("7000")).alias("g")).select("conv_id", "turn", "g.pred", "g.score", "g.acc")
)
query("tool_calls", f"""SELECT conv_id, turn, role AS name, '{{"id":' || conv_id || '}}' AS arguments, text AS content {_FROM}""")(
    lambda s, d: _made(s, d, "text", '<tool_call>\n{"name": "', "role", '", "arguments": {"id": ', "id", "}}\n</tool_call><tool_call>no call</tool_call>").select("conv_id", "turn", F.explode(M.json_calls(F.col("made"))).alias("c"), M.without_calls(F.col("made")).alias("content")).select("conv_id", "turn", "c.name", "c.arguments", "content")
)
query("channel_calls", f"SELECT conv_id, turn, role AS name, conv_id || '!' AS arguments {_FROM}")(
    lambda s, d: _made(s, d, "<|channel|>analysis<|message|>", "text", "<|end|><|start|>assistant<|channel|>commentary to=functions.", "role", " <|constrain|>json<|message|>", "id", "!<|call|>").select("conv_id", "turn", F.explode(M.channel_calls(F.col("made"))).alias("c")).select("conv_id", "turn", "c.name", "c.arguments")
)
query("tag_layout", f"SELECT conv_id, turn, {r('CASE WHEN role = ' + chr(39) + 'user' + chr(39) + ' THEN 1 ELSE 0 END', 'score')} {_FROM}")(
    lambda s, d: _made(s, d, "<think>", "text", "</think>\n<response>", "text", "</response>").select("conv_id", "turn", M.tag_layout(F.col("made"), F.when(F.col("role") == "user", "<response>").otherwise("<tool_call>")).alias("score"))
)

_ASK, _GOT = '<tool_call>{"name": "search", "arguments": {"query": "', '"}}</tool_call><information><document title="'
query("search_reward", f"SELECT conv_id, turn, 'The ' || conv_id AS pred, {r('CASE WHEN conv_id % 2 = 1 THEN 1.0 ELSE 0.85 END', 'score')}, 'role ' || conv_id || '|' || role AS queries, CAST(2 AS INTEGER) AS num_tool_calls {_FROM}")(
    lambda s, d: _made(s, d, "<think>", "text", "</think>", _ASK + "role ", "id", _GOT + "T ", "id", '"/></information>' + _ASK, "role", _GOT + 'U"/></information><answer> The ', "id", "</answer>")
    .withColumn("g", X.search_reward(F.col("made"), F.array(F.concat(F.lit("("), "id", F.lit(")"))), F.when(F.col("conv_id") % 2 == 1, "sequential").otherwise("parallel"), F.lit("which role"), F.array(F.concat(F.lit("t  "), "id"))))
    .select("conv_id", "turn", "g.pred", "g.score", F.array_join("g.queries", "|").alias("queries"), "g.num_tool_calls")
)

# Answers of ten kinds, right, wrong and malformed; a and b are a customer's numbers, odd says whether a tenth of a is.
_KINDS = {  # kind: (given, truth, whether the answer is right), with {a}, {b} and {c} for a, b and what SQL computes from them
    0: ("{a} cm", "{a}", "true", "0"),
    1: ("(x+{b})(x-{b})", "x^2-{c}", "true", "b * b"),
    2: ("({a}, {b})", "({a},{b})", "true", "0"),
    3: ("[{a},{b})", "({a},{b})", "false", "0"),
    4: ("{a}/{c}", r"\frac{1}{2}", "false", "2 * a"),
    5: (r"\frac{{a}}{{c}}", "{a}/{c}", "true", "b + 1"),
    6: (r"\sqrt{{c}}", "{a}", "false", "a * a"),
    7: ("{a}.00", "{a}", "true", "0"),
    8: ("2x+{a}(", "2x+{a}", "false", "0"),
    9: ("2(x+{b})", "2x+{c}", "odd = 0", "2 * b + odd"),
}


def _filled(template: str):
    out = F.lit(template)
    for n in "abc":
        out = F.replace(out, F.lit(f"{{{n}}}"), F.col(n).cast("string"))
    return out


def _graded(s, d):
    rows = table(s, d, "customer").select(F.col("c_custkey").cast("long").alias("a"), F.col("c_nationkey").cast("long").alias("b"), (F.floor(F.col("c_custkey") / 10) % 2).alias("odd"))
    kind = F.col("a") % 10
    pick = lambda i: F.expr("CASE a % 10 " + " ".join(f"WHEN {k} THEN {v[i]}" for k, v in _KINDS.items()) + " END")
    rows = rows.withColumn("c", pick(3))
    choose = lambda i: F.coalesce(*[F.when(kind == k, _filled(v[i])) for k, v in _KINDS.items()])
    rows = rows.withColumns({"given": F.when(F.col("a") % 70 != 67, choose(0)), "truth": choose(1)})
    return rows.select("a", Q.grade_answer(F.col("given"), F.col("truth")).alias("correct"))


query("grade_answer", "SELECT a, a % 70 <> 67 AND CASE a % 10 " + " ".join(f"WHEN {k} THEN {v[2]}" for k, v in _KINDS.items()) + " END AS correct FROM (SELECT CAST(c_custkey AS BIGINT) AS a, c_custkey // 10 % 2 AS odd FROM customer)")(_graded)


def _compared(s, d):
    """Numbers near each other, also as percentages, fractions, tuples, matrices and multiples of pi."""
    p = table(s, d, "part").select(F.col("p_partkey").cast("long").alias("k"), (F.col("p_partkey") * 100 + 700000).cast("long").alias("x")).withColumn("y", F.col("x") + (F.col("k") % 9 - 4) * 25)
    x, y, k = F.col("x").cast("string"), F.col("y").cast("string"), F.col("k") % 6
    join = lambda *parts: F.concat(*[F.lit(q) if isinstance(q, str) else q for q in parts])
    given = F.when(k == 0, x).when(k == 1, join(x, "%")).when(k == 2, join("(", x, ", 1)")).when(k == 3, join(r"\begin{pmatrix} ", x, r" & 2 \\ 0 & 1 \end{pmatrix}")).when(k == 4, join(x, r"\pi")).otherwise(join(r"\frac{", x, "}{7}"))
    truth = F.when(k == 0, y).when(k == 1, join(F.floor(F.col("y") / 100).cast("string"), ".", F.lpad((F.col("y") % 100).cast("string"), 2, "0"))).when(k == 2, join("(", y, ",1.0)")).when(k == 3, join("[[", y, ",2],[0,1]]")).when(k == 4, join(y, r"*\pi")).otherwise(join(y, "/7"))
    return p.select("k", Q.math_equal(given, truth).alias("same"))


query("math_equal", "SELECT k, abs(x - y) <= 1e-4 * greatest(x, y) AS same FROM (SELECT k, x, x + (k % 9 - 4) * 25 AS y FROM (SELECT CAST(p_partkey AS BIGINT) AS k, CAST(p_partkey * 100 + 700000 AS BIGINT) AS x FROM part))")(_compared)
query("grade_response", f"SELECT conv_id, turn, conv_id % 3 <> 0 AS correct, conv_id % 4 = 0 AS layout, CASE WHEN conv_id % 2 = 0 THEN conv_id || '/7' ELSE '\\frac{{' || conv_id || '}}{{7}}' END AS answer {_FROM}")(
    lambda s, d: _made(s, d, "text", " ").withColumn("made", F.concat("made", F.when(F.col("conv_id") % 4 == 0, r"Step 2: \box ").otherwise(""), F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("So the ANSWER is x = "), "id", F.lit("/7. Thanks"))).otherwise(F.concat(F.lit(r"so \boxed{\frac{"), "id", F.lit("}{7}}")))))
    .withColumn("g", Q.grade_response(F.col("made"), F.concat((F.col("conv_id") + F.when(F.col("conv_id") % 3 == 0, 1).otherwise(0)).cast("string"), F.lit("/7")))).select("conv_id", "turn", "g.correct", "g.layout", "g.answer")
)
