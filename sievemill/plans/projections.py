"""Rows of question-and-answer data sets as canonical samples: one projection over the scan, no shuffle.

Every projection gives data_source, prompt, ability, reward_model and extra_info, and takes the number of a row as `index`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .samples import chat, hash_answer, message

# What is appended to questions, and what a system message says.
STEP_BY_STEP = 'Let\'s think step by step and output the final answer after "####".'
BOXED = r"Let's think step by step and output the final answer within \boxed{}."
GEOMETRY = r"You FIRST think about the reasoning process as an internal monologue and then provide the final answer. The reasoning process MUST BE enclosed within <think> </think> tags. The final answer MUST BE put in \boxed{}."


def tool_arguments(tool: str, **create: Column) -> Column:
    """What a tool gets when a sample's instance of it is created."""
    return F.struct(F.struct(F.struct(*[c.alias(n) for n, c in create.items()]).alias("create_kwargs")).alias(tool))


def canonical(rows: DataFrame, source: str, prompt: Column, truth: Column, split: str, index: Column, ability: str = "math", style: str = "rule", tools: Column | None = None, agent: str | None = None, images: Column | None = None, **extra: Column) -> DataFrame:
    """The canonical columns; with tools extra_info says so, with an agent or images there is a column more."""
    info = {"split": F.lit(split), "index": index.cast("long"), **extra}
    if tools is not None:
        info |= {"need_tools_kwargs": F.lit(True), "tools_kwargs": tools}
    more = ([F.lit(agent).alias("agent_name")] if agent else []) + ([images.alias("images")] if images is not None else [])
    model = F.struct(F.lit(style).alias("style"), truth.alias("ground_truth"))
    return rows.select(F.lit(source).alias("data_source"), *more, prompt.alias("prompt"), F.lit(ability).alias("ability"), model.alias("reward_model"), F.struct(*[c.alias(n) for n, c in info.items()]).alias("extra_info"))


def word_problems(rows: DataFrame, split: str, index: Column, source: str = "openai/gsm8k", system: str | None = None, tool: str | None = None, agent: str | None = None) -> DataFrame:
    """rows(question, answer with "#### number"); with a tool that grades, it is given the right number."""
    asked = F.concat("question", F.lit(" " + STEP_BY_STEP))
    truth = hash_answer(F.col("answer"))
    turns = ([("system", F.lit(system))] if system else []) + [("user", asked)]
    return canonical(rows, source, chat(*turns), truth, split, index, tools=tool_arguments(tool, ground_truth=truth) if tool else None, agent=agent, answer=F.col("answer"), question=F.col("question"))


def competition(rows: DataFrame, split: str, index: Column, source: str, problem: str = "problem", truth: str = "answer", system: str | None = None, tool: str | None = None, boxed: bool = False) -> DataFrame:
    """rows(problem, answer) whose answer is the ground truth as it stands."""
    asked = F.concat(F.col(problem), F.lit(" " + BOXED)) if boxed else F.col(problem)
    turns = ([("system", F.lit(system))] if system else []) + [("user", asked)]
    return canonical(rows, source, chat(*turns), F.col(truth), split, index, tools=tool_arguments(tool, ground_truth=F.col(truth)) if tool else None)


def pictures(rows: DataFrame, split: str, index: Column, source: str = "hiyouga/geometry3k", tool: str | None = None) -> DataFrame:
    """rows(problem, answer, images), whose problem holds a mark for each image."""
    asked = F.concat("problem", F.lit(" " + GEOMETRY))
    tools = tool_arguments(tool, ground_truth=F.col("answer")) if tool else None
    return canonical(rows, source, chat(("user", asked)), F.col("answer"), split, index, tools=tools, images=F.col("images"), answer=F.col("answer"), question=F.col("problem"))


def preference_prompts(rows: DataFrame, split: str, index: Column, source: str = "Dahoas/full-hh-rlhf") -> DataFrame:
    """rows(prompt, response) whose reward is a model's; the known response is the ground truth."""
    return canonical(rows, source, chat(("user", F.col("prompt"))), F.col("response"), split, index, ability="alignment", style="model")


def search_questions(rows: DataFrame, split: str, index: Column, system: str, prefix: str) -> DataFrame:
    """rows(question, data_source, ability, golden_answers, reward_model, metadata): the truth of the reward model, or else the golden answers."""
    source = F.concat(F.lit("searchR1_"), F.coalesce("data_source", F.lit("")))
    question = F.coalesce("question", F.lit(""))
    truth = F.coalesce(F.col("reward_model.ground_truth"), F.col("golden_answers"), F.array().cast("array<string>"))
    info = F.struct(
        index.cast("long").alias("index"), F.lit(True).alias("need_tools_kwargs"), question.alias("question"), F.lit(split).alias("split"),
        tool_arguments("search", ground_truth=truth, question=question, data_source=source).alias("tools_kwargs"),
    )
    prompt = chat(("system", F.lit(system)), ("user", F.concat(F.lit(prefix.rstrip("\n")), question)))
    return rows.select(source.alias("data_source"), prompt.alias("prompt"), "ability", "reward_model", info.alias("extra_info"), "metadata")


def answer_messages(rows: DataFrame, question: str = "question", answer: str = "answer", instruction: str = STEP_BY_STEP) -> DataFrame:
    """rows with messages: the question with its instruction, and the answer."""
    return rows.withColumn("messages", F.array(message("user", F.concat(F.col(question), F.lit(" " + instruction))), message("assistant", F.col(answer))))


def runtime_rows(samples: DataFrame, prompt: str = "prompt", media: tuple[str, ...] = ("images", "videos", "audios")) -> DataFrame:
    """Samples as a rollout takes them: raw_prompt, index (0 if extra_info has none), tools and interaction arguments, without media columns."""
    kinds = {f.name: f.dataType for f in samples.schema["extra_info"].dataType.fields} if "extra_info" in samples.columns else {}
    given = lambda n, default: F.coalesce(F.col(f"extra_info.{n}"), default) if n in kinds else default
    text = lambda n: F.coalesce(F.to_json(F.col(f"extra_info.{n}")), F.lit("{}")) if n in kinds else F.lit("{}")
    kept = [c for c in samples.columns if c not in (*media, prompt)]
    return samples.select(*kept, F.col(prompt).alias("raw_prompt"), given("index", F.lit(0).cast("long")).alias("index"), text("tools_kwargs").alias("tools_kwargs"), text("interaction_kwargs").alias("interaction_kwargs"))


def media_of(prompt: Column, kind: str) -> Column:
    """The media of a kind (image, video or audio) in prompts whose messages hold parts (type, text, place): their places in order."""
    return F.flatten(F.transform(prompt, lambda m: F.transform(F.filter(m["content"], lambda p: p["type"] == kind), lambda p: p["place"])))


def without_cues(rows: DataFrame, text: Column, cues: list[str]) -> DataFrame:
    """rows, unless a text still holds one of the cues (any case): then the query fails."""
    hit = F.array_join(F.filter(F.array(*map(F.lit, cues)), lambda c: F.contains(F.lower(text), F.lower(c))), ", ")
    names = [f"`{c}`" for c in rows.columns]
    checked = F.when(F.coalesce(hit, F.lit("")) == "", True).otherwise(F.raise_error(F.concat(F.lit("forbidden in a text: "), hit)).cast("boolean"))
    return rows.where(checked).select(*names)


def with_variants(samples: DataFrame, variants: Column) -> DataFrame:
    """samples whose ground truth is the old one with further variants of the answer, which extra_info lists too."""
    both = F.array_distinct(F.concat(F.col("reward_model.ground_truth"), F.coalesce(variants, F.array().cast("array<string>"))))
    return samples.withColumns({"reward_model": F.col("reward_model").withField("ground_truth", both), "extra_info": F.col("extra_info").withField("answer_variants", both)})


def payload(*fields: str) -> Column:
    """The fields as one JSON text, for a judge's prompt."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def judge_messages(system: str, task: str, *fields: str) -> Column:
    """The chat that asks a judge about a row."""
    return chat(("system", F.lit(system)), ("user", F.concat(F.lit(task + "\n"), payload(*fields))))
