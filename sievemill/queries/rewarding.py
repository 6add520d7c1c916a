"""Scorers by source, reward placement and call readers over conversations; null texts and roles count as empty."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rewards as W
from ..operators import toolcalls as C
from ..session import table
from .base import query, r

_FROM = "(SELECT conv_id, turn, coalesce(text, '') AS text, coalesce(role, '') AS role, length(coalesce(text, '')) AS n FROM conversations)"


def _rows(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role")).withColumn("n", F.length("text"))


_SOURCES = ("openai/gsm8k", "HuggingFaceH4/MATH-500", "aime2024", "hiyouga/geometry3k", "searchR1_nq")


def _sourced(s, d):
    """Texts that end in an answer as their source wants it: the number of characters, of which each third is off by one."""
    n = F.col("n").cast("string")
    end = F.element_at(F.array(F.concat(F.lit("\n#### "), n), F.concat(F.lit(" \\boxed{"), n, F.lit("}")), F.concat(F.lit("\nAnswer: "), n), F.concat(F.lit("</think> \\boxed{"), n, F.lit("}.")), F.concat(F.lit("<answer>"), n, F.lit("</answer>"))), (F.col("conv_id") % 5 + 1).cast("int"))
    text = F.when(F.col("conv_id") % 5 == 3, F.concat(F.lit("<think>"), "text", end)).otherwise(F.concat("text", end))
    source = F.element_at(F.array(*map(F.lit, _SOURCES)), (F.col("conv_id") % 5 + 1).cast("int"))
    return _rows(s, d).withColumns({"source": source, "answer": text, "gold": (F.col("n") + (F.col("turn") % 3 == 1).cast("int")).cast("string")})


_RIGHT = "turn % 3 <> 1"
_SCORE = f"CASE conv_id % 5 WHEN 2 THEN CASE WHEN {_RIGHT} THEN 1 ELSE -1 END WHEN 3 THEN CASE WHEN {_RIGHT} THEN 1 ELSE 0.1 END ELSE CASE WHEN {_RIGHT} THEN 1 ELSE 0 END END"
_NAMES = "[" + ", ".join(f"'{x}'" for x in _SOURCES) + "][conv_id % 5 + 1]"
query("score_by_source", f"SELECT conv_id, turn, {_NAMES} AS source, {r(_SCORE, 'score')} FROM {_FROM}")(lambda s, d: _sourced(s, d).select("conv_id", "turn", "source", W.score_by_source(F.col("source"), F.col("answer"), F.col("gold")).alias("score")))
query("evaluate_by_source", f"WITH e AS (SELECT {_NAMES} AS source, conv_id, avg({_SCORE}) AS score FROM {_FROM} GROUP BY 1, 2) SELECT source, {r('avg(score)', 'score')}, count(*) AS n FROM e GROUP BY 1")(
    lambda s, d: W.evaluate(_sourced(s, d).groupBy("source", "conv_id").agg(F.collect_list(F.struct("answer", "gold")).alias("responses")), "source", W.score_by_source(F.col("source"), F.col("response.answer"), F.col("response.gold")))
)
query("rewards_at_last_token", f"SELECT conv_id, turn, {r(_SCORE, 'score')}, CASE WHEN n % 5 = 0 THEN 0 ELSE n % 5 END AS place, {r(f'CASE WHEN n % 5 = 0 THEN 0 ELSE {_SCORE} END', 'total')} FROM {_FROM}")(
    lambda s, d: W.token_rewards(_sourced(s, d), W.score_by_source(F.col("source"), F.col("answer"), F.col("gold")), F.col("n") % 5, F.lit(6))
    .select("conv_id", "turn", "score", F.when(F.col("n") % 5 == 0, 0).otherwise(F.when(F.col("score") == 0, F.col("n") % 5).otherwise(F.array_position(F.transform("rewards", lambda x: x != 0), True))).alias("place"), F.aggregate("rewards", F.lit(0.0), lambda a, x: a + x).alias("total"))
)
query("component_rewards", f"SELECT conv_id, turn, {r('n / 10.0 + turn', 'score')}, {r('CASE WHEN n % 4 = 0 THEN 0 ELSE n / 10.0 END', 'length_total')} FROM {_FROM}")(
    lambda s, d: W.component_rewards(_rows(s, d), F.col("n") % 4, F.lit(5), length=F.col("n") / 10.0, turn=F.col("turn").cast("double")).select("conv_id", "turn", "score", F.aggregate("length_rewards", F.lit(0.0), lambda a, x: a + x).alias("length_total"))
)
query("score_batches_guarded", f"SELECT conv_id, turn, {r('CASE WHEN n % 7 = 0 THEN 0 ELSE 100.0 / (n % 7) END', 'score')} FROM {_FROM}")(
    lambda s, d: W.score_batches(_rows(s, d).select("conv_id", "turn", F.col("n").cast("long").alias("n")), W.guarded(lambda conv_id, turn, n: 100.0 / (n % 7))).select("conv_id", "turn", "score")
)

# Texts that call in one of four ways: in tags, as JSON, cut off, or not at all.
_TOOLS = {"search": ["query"], "open": ["page", "mode"]}


def _calling(s, d):
    c, role = F.col("conv_id").cast("string"), F.col("role")
    tags = F.concat(F.lit("<think><search><query>no</query></search></think><tool_calls><open><page> "), c, F.lit("</page><other>x</other></open>\n<search><query>"), role, F.lit(" ?</query></search></tool_calls>"))
    blocks = F.concat("role", F.lit('<tool_call>{"name": "search", "arguments": {"query": "'), role, F.lit('", "x": 1}}\n{"name": "none", "arguments": {}}</tool_call><tool_call>bad</tool_call><tool_call>{"name": "open", "arguments": "{\\"page\\": '), c, F.lit('}"}</tool_call>'))
    return _rows(s, d).withColumn("made", F.element_at(F.array(tags, blocks, F.concat("role", F.lit(" <open>")), F.concat("role", F.lit(" done"))), (F.col("turn") % 4 + 1).cast("int")))


query(
    "schema_calls",
    f"""SELECT conv_id, turn, u.name AS name, u.arguments AS arguments FROM {_FROM}, unnest(CASE turn % 4
        WHEN 0 THEN [{{'name': 'open', 'arguments': '{{"page": "' || conv_id || '"}}'}}, {{'name': 'search', 'arguments': '{{"query": "' || trim(role || ' ?') || '"}}'}}]
        WHEN 1 THEN [{{'name': 'search', 'arguments': '{{"query": "' || role || '"}}'}}, {{'name': 'open', 'arguments': '{{"page": ' || conv_id || '}}'}}]
        WHEN 2 THEN [{{'name': 'open', 'arguments': '{{}}'}}] ELSE [] END) AS t(u)""",
)(lambda s, d: _calling(s, d).select("conv_id", "turn", F.explode(C.schema_calls(F.col("made"), _TOOLS)).alias("c")).select("conv_id", "turn", "c.*"))


def _braced(s, d):
    c = F.col("conv_id").cast("string")
    call = F.concat(F.lit("<|tool_call>call:find{id:"), c, F.lit(',who:<|"|>'), "role", F.lit(', {x}<|"|>,all:True,none:null,rate:0.5,word: as is}<tool_call|>'))
    return _rows(s, d).withColumn("made", F.concat("text", F.when(F.col("turn") % 3 == 0, F.lit("")).when(F.col("turn") % 3 == 1, call).otherwise(F.concat(call, F.lit(" then <|tool_call>call:cut{a:1}")))))


query(
    "braced_calls",
    f"""SELECT conv_id, turn, text AS content, CASE WHEN turn % 3 = 0 THEN NULL ELSE 'find' END AS name,
        CASE WHEN turn % 3 = 0 THEN NULL ELSE '{{"id": ' || conv_id || ', "who": "' || role || ', {{x}}", "all": true, "none": null, "rate": 0.5, "word": "as is"}}' END AS arguments FROM {_FROM}""",
)(
    lambda s, d: _braced(s, d).withColumn("calls", C.braced_calls(F.col("made")))
    .select("conv_id", "turn", C.before_calls(F.col("made"), F.col("calls")).alias("content"), F.explode_outer("calls").alias("c")).select("conv_id", "turn", "content", "c.name", "c.arguments")
)
