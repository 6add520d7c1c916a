"""Text scorers as column expressions: text columns in, a score, a text or an array out. Null text counts as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..registry import SCORERS

_PUNCTUATION = r"[!-/:-@\[-`{-~]"


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the last match, or null."""
    return F.get(F.reverse(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))), 0)


def answer_tag(text: Column) -> Column:
    """The last <answer>, trimmed; without one empty."""
    return F.coalesce(F.trim(last_match(text, r"(?is)<answer>\s*(.*?)\s*</answer>")), F.lit(""))


def normalize_answer(text: Column) -> Column:
    """Lower case, without ASCII punctuation and the words a, an, the; single spaces."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "), r"(?U)\s+", " "))


def words(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda w: w != "")


def common(a: Column, b: Column) -> Column:
    """Size of the intersection of two bags."""
    times = lambda bag, w: F.size(F.filter(bag, lambda x: x == w))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, w: s + F.least(times(a, w), times(b, w)))


def token_f1(prediction: Column, gold: Column) -> Column:
    """F1 of the normalised words as bags; yes, no and noanswer earn no partial credit."""
    p, g = words(normalize_answer(prediction)), words(normalize_answer(gold))
    special = lambda a: (F.size(a) == 1) & F.get(a, 0).isin("yes", "no", "noanswer")
    n = common(p, g)
    return F.when((special(p) | special(g)) & (p != g), 0.0).otherwise(F.coalesce(F.when(n > 0, 2.0 * n / (F.size(p) + F.size(g))), F.lit(0.0)))


def bag_similarity(a: Column, b: Column) -> Column:
    """Common over all elements of two bags; equal arrays 1, an empty one 0."""
    n = common(a, b)
    return F.when(a == b, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(n / (F.size(a) + F.size(b) - n))


def exact_match(prediction: Column, golds: Column) -> Column:
    p = normalize_answer(prediction)
    return F.exists(golds, lambda g: normalize_answer(g) == p)


def sub_match(prediction: Column, golds: Column) -> Column:
    p = normalize_answer(prediction)
    return F.exists(golds, lambda g: F.contains(p, normalize_answer(g)))


@SCORERS.register("search_qa_em")
def qa_em(text: Column, golds: Column, format_score: float = 0.0, score: float = 1.0, match=exact_match) -> Column:
    """score if the last <answer> is a gold, a quarter of it beyond ten tags; format_score for another answer; 0 without one."""
    found = last_match(text, r"(?s)<answer>(.*?)</answer>")
    many = (F.regexp_count(text, F.lit("<answer>")) > 10) | (F.regexp_count(text, F.lit("</answer>")) > 10)
    return F.when(found.isNull(), 0.0).when(~match(F.trim(found), golds), format_score).when(many, score / 4).otherwise(score)


def numeric_answer(text: Column, strict: bool = True) -> Column:
    """Of the last 300 characters the last "#### number" without commas, or (not strict) the last number that is more than a point."""
    tail = F.right(F.coalesce(text, F.lit("")), F.lit(300))
    if strict:
        return F.regexp_replace(last_match(tail, r"#### (-?[0-9.,]+)"), ",", "")
    found = F.regexp_extract_all(tail, F.lit(r"(-?[0-9.,]+)"), F.lit(1))
    return F.coalesce(F.get(F.reverse(F.filter(found, lambda x: x != ".")), 0), F.get(found, 0))


@SCORERS.register("gsm8k")
def gsm8k(text: Column, gold: Column, strict: bool = True, format_score: float = 0.0, score: float = 1.0) -> Column:
    answer = numeric_answer(text, strict)
    return F.when(answer.isNull(), 0.0).when(answer == gold, score).otherwise(format_score)


def strip_think(text: Column) -> Column:
    return F.regexp_replace(text, r"(?is)<think>.*?</think>", " ")


def think_lengths(text: Column) -> Column:
    """Words of each think block, split at white space."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?is)<think>(.*?)</think>"), F.lit(1)), lambda t: F.size(F.regexp_extract_all(t, F.lit(r"\S+"), F.lit(0))))


def phrase_at(tokens: Column, phrase: Column) -> Column:
    """Positions, from 0, at which the words of a phrase stand in a row."""
    last = F.size(tokens) - F.size(phrase)
    return F.when((F.size(phrase) == 0) | (last < 0), F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(tokens, i + 1, F.size(phrase)) == phrase))
