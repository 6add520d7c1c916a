"""Scoring of whole tables: scorers by data source, rewards at the last token, scorers that run as Python."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import SCORERS
from ..session import ship
from . import mathequal as Q
from . import mathtext as M
from . import scoring as S
from . import tokens as T
from .toolcalls import tool_call_reward

#: Which scorer a data source has; a name that ends in * stands for all that begin so.
ROUTES = {
    "openai/gsm8k": "gsm8k",
    "lighteval/MATH": "math_boxed",
    "DigitalLearningGmbH/MATH-lighteval": "math_boxed",
    "HuggingFaceH4/MATH-500": "math_boxed",
    "math_dapo": "math_stated",
    "math": "math_stated",
    "math_dapo_reasoning": "math_stated",
    "aime*": "math_stated",
    "hiyouga/geometry3k": "geometry",
    "searchR1_nq": "search_em",
    "searchR1_triviaqa": "search_em",
    "searchR1_popqa": "search_em",
    "searchR1_hotpotqa": "search_em",
    "searchR1_2wikimultihopqa": "search_em",
    "searchR1_musique": "search_em",
    "searchR1_bamboogle": "search_em",
}


@SCORERS.register("geometry")
def geometry(text: Column, gold: Column, format_share: float = 0.1) -> Column:
    """The boxed answer, graded against the gold one, and to a small share the layout."""
    right = Q.grade_answer(M.boxed_answer(text), gold)
    return (1 - format_share) * F.when(right, 1.0).otherwise(0.0) + format_share * M.think_and_box(text)


SCORERS.register("search_em")(lambda text, gold: S.qa_em(text, F.array(gold)))


@SCORERS.register("tool_layout")
def tool_layout(text: Column, gold: Column, made: Column, wanted: Column) -> Column:
    """struct(score, format_reward, accuracy_reward) of the layout that the gold text has and of its calls (JSON arrays)."""
    form, right = M.tag_layout(text, gold), tool_call_reward(wanted, made)
    return F.struct((form + right).alias("score"), form.alias("format_reward"), right.alias("accuracy_reward"))


def score_by_source(source: Column, text: Column, gold: Column, routes: dict[str, str] | None = None) -> Column:
    """The score by the scorer of a row's data source; an unknown source fails the query."""
    routes = ROUTES | (routes or {})
    by_scorer: dict[str, Column] = {}
    for name, scorer in routes.items():
        hit = F.startswith(source, F.lit(name[:-1])) if name.endswith("*") else source == name
        by_scorer[scorer] = by_scorer[scorer] | hit if scorer in by_scorer else hit
    out = F
    for scorer, hit in by_scorer.items():
        out = out.when(hit, SCORERS.get(scorer)(text, gold).cast("double"))
    return out.otherwise(F.raise_error(F.concat(F.lit("no scorer for source "), F.coalesce(source, F.lit("null")))).cast("double"))


def evaluate(responses: DataFrame, source: str, score: Column, responses_column: str = "responses") -> DataFrame:
    """A row for each source: the mean over its rows of the mean score of a row's responses; score is of column `response`.

    Rows without responses don't count.
    """
    each = responses.withColumn("_row", F.monotonically_increasing_id()).select("*", F.explode(responses_column).alias("response"))
    row = each.groupBy(source, "_row").agg(F.avg(score).alias("_s"))
    return row.groupBy(source).agg(F.avg("_s").alias("score"), F.count(F.lit(1)).alias("n"))


def token_rewards(rows: DataFrame, score: Column, valid: Column, size: Column, **extra: Column) -> DataFrame:
    """rows with rewards (the score at the last valid token of `size`, else 0), score, and further columns of the scorer."""
    return rows.withColumns({"score": score, **extra}).withColumn("rewards", T.last_token_scatter(valid, F.col("score"), size))


def component_rewards(rows: DataFrame, valid: Column, size: Column, **components: Column) -> DataFrame:
    """rows with a rewards array for each component, and score: their sum."""
    out = rows.withColumns({f"{n}_score": c for n, c in components.items()})
    out = out.withColumns({f"{n}_rewards": T.last_token_scatter(valid, F.col(f"{n}_score"), size) for n in components})
    return out.withColumn("score", sum((F.col(f"{n}_score") for n in components), F.lit(0.0)))


def rewards_of(rows: DataFrame, *extra: str) -> DataFrame:
    """The rewards and those further columns that are there."""
    return rows.select("rewards", *[c for c in extra if c in rows.columns])


def score_batches(rows: DataFrame, score: Callable[[pd.DataFrame], list[float]]) -> DataFrame:
    """rows with score, by one call of a Python scorer for each Arrow batch."""
    ship(rows.sparkSession)

    def run(frames):
        for frame in frames:
            yield frame.assign(score=[float(x) for x in score(frame)])

    return rows.mapInPandas(run, rows.select("*", F.lit(0.0).alias("score")).schema)


def guarded(score: Callable[..., float]) -> Callable[[pd.DataFrame], list[float]]:
    """A batch scorer that gives 0 to rows whose score fails."""

    def one(row) -> float:
        try:
            return float(score(*row))
        except Exception:
            return 0.0

    return lambda frame: [one(row) for row in frame.itertuples(index=False)]
