"""Tool-using rollouts as rounds over a table: each row is a state machine, and only active rows take part in a round.

A round lets the model add tokens to all active rows, reads the calls in them, runs the tools on all calls at once, and adds
the answers' tokens, which are outside the loss mask. It writes the rows that ended and those that go on to a folder of its
own; the next round reads the latter. A round that was lost is done again from the one before; rounds that are there are
not. It ends exactly when no row is active.

The model, the reader of calls, the tools and the writer of answers are functions that the caller gives:
generate: rows (id, ids, turn, ...) -> the same rows with `new`, the tokens that the model adds;
read_calls: Column `new` -> array of struct(name, arguments);
use_tools: calls (id, turn, at, name, arguments) -> the same rows with `answer`, a text;
write_answers: Column of answers in the order of their calls -> their tokens.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import _exists

#: Why a row ended.
FULL, NO_CALLS, TURNS, ANSWERS, TOO_LONG = "full", "no calls", "model turns", "tool turns", "answer too long"


@dataclass(frozen=True)
class Limits:
    """Tokens of a response, turns of the model and of the tools (0: no limit), calls of a turn that are run."""

    response: int
    model_turns: int = 0
    tool_turns: int = 0
    calls: int = 1

    @property
    def refusal(self) -> str:
        # Fixed value: what a call beyond the limit is answered.
        return f"<information><format_error>A single turn can execute at most {self.calls} tool calls.</format_error></information>"


def _start(prompts: DataFrame) -> DataFrame:
    """State of prompts(id, ids)."""
    empty = F.array().cast("array<int>")
    return prompts.select("id", F.col("ids").cast("array<int>").alias("ids"), empty.alias("mask"), F.lit(0).alias("turn"), F.lit(0).alias("tool_turn"), F.lit(0).alias("n_calls"), F.lit(None).cast("string").alias("ended"))


def one_round(active: DataFrame, limits: Limits, generate: Callable, read_calls: Callable[[Column], Column], use_tools: Callable, write_answers: Callable[[Column], Column]) -> DataFrame:
    """The rows after the model's and the tools' turn; `ended` says why a row goes no further."""
    columns = active.columns
    fill = lambda value, n: F.array_repeat(F.lit(value), n)
    said = generate(active).withColumn("new", F.coalesce(F.col("new").cast("array<int>"), F.array().cast("array<int>")))
    said = said.withColumns({"ids": F.concat("ids", "new"), "mask": F.concat("mask", fill(1, F.size("new"))), "turn": F.col("turn") + 1})
    said = said.withColumn("calls", read_calls(F.col("new")))
    over = lambda turns, most: F.lit(bool(most)) & (turns >= most)
    why = F.when(F.size("mask") >= limits.response, FULL).when(over(F.col("turn"), limits.model_turns), TURNS).when(over(F.col("tool_turn"), limits.tool_turns), ANSWERS).when(F.coalesce(F.size("calls"), F.lit(0)) <= 0, NO_CALLS)
    said = said.withColumn("ended", why)
    # Calls are rows only as far as they are run; a turn's answers, at most as many, meet in their row again.
    calls = said.where("ended IS NULL").select("id", "turn", F.posexplode(F.slice("calls", 1, limits.calls)).alias("at", "c")).select("id", "turn", "at", "c.name", "c.arguments")
    answers = use_tools(calls).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce(F.col("answer"), F.lit("")).alias("answer")))).alias("got"))
    both = said.join(answers.select(F.col("id").alias("_of"), "got"), F.col("id") == F.col("_of"), "left")
    refused = F.array_repeat(F.lit(limits.refusal), F.greatest(F.size("calls") - limits.calls, F.lit(0)))
    reply = F.when(F.col("ended").isNull(), write_answers(F.concat(F.transform("got", lambda x: x["answer"]), refused)).cast("array<int>"))
    both = both.withColumn("reply", reply).withColumn("ended", F.when(F.col("ended").isNotNull(), F.col("ended")).when(F.size("mask") + F.size("reply") >= limits.response, TOO_LONG))
    goes_on = F.col("ended").isNull()
    add = lambda c, more: F.when(goes_on, F.concat(c, more)).otherwise(F.col(c)).alias(c)
    ran = F.when(F.col("reply").isNotNull(), F.size("calls")).otherwise(0)
    out = both.select(*[c for c in columns if c not in ("ids", "mask", "tool_turn", "n_calls")], add("ids", F.col("reply")), add("mask", fill(0, F.size("reply"))), F.when(goes_on, F.col("tool_turn") + 1).otherwise(F.col("tool_turn")).alias("tool_turn"), (F.col("n_calls") + ran).alias("n_calls"))
    return out.select(*columns)


def roll_out(prompts: DataFrame, path: str, limits: Limits, generate: Callable, read_calls: Callable[[Column], Column], use_tools: Callable, write_answers: Callable[[Column], Column]) -> DataFrame:
    """id, prompt, response, mask (1 for the model's tokens), n_turns, n_calls, ended for each of prompts(id, ids).

    Rounds are written under path; a further call with the same path goes on after the last whole round.
    """
    spark: SparkSession = prompts.sparkSession
    schema = _start(prompts).schema
    done = 0
    while _exists(spark, f"{path}/round={done}/_SUCCESS"):
        done += 1
    if done == 0:
        _write(_start(prompts), path, 0)
        done = 1
    while True:
        active = spark.read.schema(schema).parquet(f"{path}/round={done - 1}").where("ended IS NULL")
        if active.isEmpty():
            break
        _write(one_round(active, limits, generate, read_calls, use_tools, write_answers), path, done)
        done += 1
    rows = spark.read.schema(schema).option("basePath", path).parquet(*[f"{path}/round={r}" for r in range(done)]).where("ended IS NOT NULL")
    n = F.size("mask")
    response = F.slice("ids", F.size("ids") - n + 1, F.greatest(n, F.lit(1)))
    cut = lambda c: F.slice(c, 1, limits.response)
    return rows.select("id", F.slice("ids", F.lit(1), F.size("ids") - n).alias("prompt"), F.when(n > 0, cut(response)).otherwise(F.array().cast("array<int>")).alias("response"), cut(F.col("mask")).alias("mask"), (F.col("turn") + F.col("tool_turn") + 1).alias("n_turns"), "n_calls", "ended")


def _write(rows: DataFrame, path: str, number: int) -> None:
    # Ended and active rows are sorted apart, so that the next round skips the ended ones' row groups.
    rows.sortWithinPartitions(F.col("ended").isNull()).write.mode("overwrite").parquet(f"{path}/round={number}")
