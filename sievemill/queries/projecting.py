"""Canonical samples and token samples over benchmark and conversations; null texts count as empty."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import projections as P
from ..plans import turns as U
from ..session import table
from .base import query

_B = "(SELECT item_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM benchmark)"


def _items(s, d):
    b = table(s, d, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("n", F.length("text"))
    n = F.col("n").cast("string")
    return b.select(
        "item_id", F.col("text").alias("question"), F.concat("text", F.lit(" #### 1,"), n).alias("answer"), F.col("text").alias("problem"), n.alias("truth"), F.col("text").alias("prompt"), F.reverse("text").alias("response"),
        F.array(F.col("item_id").cast("string")).alias("images"), F.lit("nq").alias("data_source"), F.lit("fact").alias("ability"), F.when(F.col("item_id") % 2 == 0, F.struct(F.lit("rule").alias("style"), F.array(n).alias("ground_truth"))).alias("reward_model"), F.array(F.reverse("text")).alias("golden_answers"), F.lit(None).cast("string").alias("metadata"),
    )


_q = lambda t: t.replace("'", "''")
_last = "element_at(prompt, -1).content AS asked"
_index = "extra_info.index AS item_id"
_S, _BX, _G = (f"text || ' {_q(x)}' AS asked" for x in (P.STEP_BY_STEP, P.BOXED, P.GEOMETRY))
query("word_problem_sample", f"SELECT item_id, 'openai/gsm8k' AS data_source, {_S}, '1' || n AS truth, text AS question FROM {_B}")(lambda s, d: P.word_problems(_items(s, d), "train", F.col("item_id")).select(F.expr(_index), "data_source", F.expr(_last), F.col("reward_model.ground_truth").alias("truth"), F.col("extra_info.question").alias("question")))
query("word_problem_tool_sample", f"SELECT item_id, 'grader' AS agent_name, 'Solve.' AS system, {_S}, '1' || n AS created FROM {_B}")(
    lambda s, d: P.word_problems(_items(s, d), "train", F.col("item_id"), system="Solve.", tool="grade", agent="grader").select(F.expr(_index), "agent_name", F.get("prompt", 0)["content"].alias("system"), F.expr(_last), F.col("extra_info.tools_kwargs.grade.create_kwargs.ground_truth").alias("created"))
)
query("competition_sample", f"SELECT item_id, {_BX}, CAST(n AS VARCHAR) AS truth, 'math' AS ability FROM {_B}")(lambda s, d: P.competition(_items(s, d), "test", F.col("item_id"), "math", truth="truth", boxed=True).select(F.expr(_index), F.expr(_last), F.col("reward_model.ground_truth").alias("truth"), "ability"))
query("competition_tool_sample", f"SELECT item_id, text AS asked, CAST(n AS VARCHAR) AS created, true AS tools FROM {_B}")(
    lambda s, d: P.competition(_items(s, d), "test", F.col("item_id"), "aime", truth="truth", tool="code").select(F.expr(_index), F.expr(_last), F.col("extra_info.tools_kwargs.code.create_kwargs.ground_truth").alias("created"), F.col("extra_info.need_tools_kwargs").alias("tools"))
)
query("picture_sample", f"SELECT item_id, {_G}, CAST(item_id AS VARCHAR) AS image FROM {_B}")(lambda s, d: P.pictures(_items(s, d).withColumn("answer", F.col("truth")), "test", F.col("item_id")).select(F.expr(_index), F.expr(_last), F.get("images", 0).alias("image")))
query("picture_tool_sample", f"SELECT item_id, CAST(n AS VARCHAR) AS created FROM {_B}")(lambda s, d: P.pictures(_items(s, d).withColumn("answer", F.col("truth")), "test", F.col("item_id"), tool="grade").select(F.expr(_index), F.col("extra_info.tools_kwargs.grade.create_kwargs.ground_truth").alias("created")))
query("preference_sample", f"SELECT item_id, text AS asked, reverse(text) AS truth, 'model' AS style, 'alignment' AS ability FROM {_B}")(lambda s, d: P.preference_prompts(_items(s, d), "train", F.col("item_id")).select(F.expr(_index), F.expr(_last), F.col("reward_model.ground_truth").alias("truth"), F.col("reward_model.style").alias("style"), "ability"))
query("search_sample", f"SELECT item_id, 'searchR1_nq' AS data_source, 'Find: ' || text AS asked, CASE WHEN item_id % 2 = 0 THEN CAST(n AS VARCHAR) ELSE reverse(text) END AS created FROM {_B}")(
    lambda s, d: P.search_questions(_items(s, d), "train", F.col("item_id"), "Search.", "Find: \n").select(F.expr(_index), "data_source", F.expr(_last), F.get("extra_info.tools_kwargs.search.create_kwargs.ground_truth", 0).alias("created"))
)
query("answer_messages", f"SELECT item_id, unnest(['user', 'assistant']) AS role, unnest([text || ' {_q(P.STEP_BY_STEP)}', text || ' #### 1,' || n]) AS content FROM {_B}")(lambda s, d: P.answer_messages(_items(s, d)).select("item_id", F.explode("messages").alias("m")).select("item_id", "m.*"))
query("runtime_rows", f"SELECT item_id AS index, {_S}, '{{}}' AS interaction_kwargs, '{{\"grade\":{{\"create_kwargs\":{{\"ground_truth\":\"1' || n || '\"}}}}}}' AS tools_kwargs FROM {_B}")(
    lambda s, d: P.runtime_rows(P.word_problems(_items(s, d), "train", F.col("item_id"), tool="grade")).select("index", F.element_at("raw_prompt", -1)["content"].alias("asked"), "interaction_kwargs", "tools_kwargs")
)
query("answer_variants", f"SELECT item_id, CASE WHEN text = reverse(text) THEN text ELSE text || '|' || reverse(text) END AS truths FROM {_B}")(
    lambda s, d: P.with_variants(_items(s, d).select(F.struct(F.array("question").alias("ground_truth")).alias("reward_model"), F.struct("item_id").alias("extra_info"), "response"), F.array("response")).select("extra_info.item_id", F.array_join("extra_info.answer_variants", "|").alias("truths"))
)
query("without_cues", f"SELECT item_id FROM {_B}")(lambda s, d: P.without_cues(_items(s, d).select("item_id", "question"), F.col("question"), ["no such cue 123"]).select("item_id"))
query("judge_messages", f"SELECT item_id, 'Judge:' || chr(10) || '{{\"item_id\":' || item_id || ',\"truth\":\"' || n || '\"}}' AS asked FROM {_B}")(lambda s, d: _items(s, d).select("item_id", F.get(P.judge_messages("Be strict.", "Judge:", "item_id", "truth"), 1)["content"].alias("asked")))

# Token samples: characters as ids.
_TURNS = U.Template("<{role}>", ";")
_C = """c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
    t AS (SELECT conv_id, turn, role, '<' || role || '>' || text || ';' AS whole, length(role) + 2 AS opened FROM c),
    g AS (SELECT conv_id, string_agg(whole, '' ORDER BY turn, role, whole) AS whole, string_agg(CASE WHEN role = 'assistant' THEN repeat('0', opened) || repeat('1', length(whole) - opened) ELSE repeat('0', length(whole)) END, '' ORDER BY turn, role, whole) AS mask FROM t GROUP BY conv_id)"""


def _chats(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    return c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


_join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "")
_chars = lambda c: F.array_join(F.transform(c, lambda x: F.when(x == 0, "_").otherwise(F.chr(x))), "")
query("sft_tokens", f"WITH {_C} SELECT conv_id, md5(mask) AS mask, length(whole) AS n FROM g")(lambda s, d: U.turn_ids(_chats(s, d), U.code_points, _TURNS).select("conv_id", F.md5(_join(F.col("loss_mask"))).alias("mask"), F.size("input_ids").cast("long").alias("n")))
for _cut, _sql in (("left", "right({}, 300)"), ("right", "left({}, 300)")):
    query(f"sft_rows_{_cut}", f"WITH {_C} SELECT conv_id, rpad({_sql.format('mask')}, 300, '0') AS mask, rpad(repeat('1', least(length(whole), 300)), 300, '0') AS attended FROM g")(
        lambda s, d, cut=_cut: U.fit_rows(U.turn_ids(_chats(s, d), U.code_points, _TURNS), 300, truncation=cut).select("conv_id", _join(F.col("loss_mask")).alias("mask"), _join(F.col("attention_mask")).alias("attended"))
    )
query("sft_rows_ragged", f"WITH {_C} SELECT conv_id, left(mask, 300) AS mask, CAST(least(length(whole), 300) - 1 AS INTEGER) AS last FROM g")(lambda s, d: U.fit_rows(U.turn_ids(_chats(s, d), U.code_points, _TURNS), 300, truncation="right", pad=False).select("conv_id", _join(F.col("loss_mask")).alias("mask"), F.element_at("position_ids", -1).alias("last")))
query("sft_agrees", "SELECT DISTINCT conv_id, true AS agrees FROM conversations")(lambda s, d: U.agrees(_chats(s, d), U.code_points, _TURNS).select("conv_id", "agrees"))
query("short_prompts", f"WITH {_C} SELECT conv_id FROM g WHERE length(whole) + 11 <= 900")(lambda s, d: U.short_prompts(_chats(s, d).withColumnRenamed("messages", "prompt"), U.code_points, 900, _TURNS).select("conv_id"))
query("answer_pairs", f"SELECT item_id, rpad(left(text || 'y' || n || chr(3), 120), 120, '_') AS chosen, rpad(left(text || reverse(text) || chr(3), 120), 120, '_') AS rejected, CAST(least(2 * n + 1, 120) AS BIGINT) AS attended FROM {_B}")(
    lambda s, d: U.answer_pairs(_items(s, d).select("item_id", "prompt", F.concat(F.lit("y"), "truth").alias("chosen"), F.col("response").alias("rejected")), U.code_points, 120, 3)
    .select("item_id", _chars(F.get("input_ids", 0)).alias("chosen"), _chars(F.get("input_ids", 1)).alias("rejected"), F.aggregate(F.get("attention_mask", 1), F.lit(0).cast("long"), lambda a, x: a + x).alias("attended"))
)
