"""Graders of mathematical answers and readers of tool calls, as column expressions. Null text counts as empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..registry import SCORERS, TOOL_PARSERS
from .scoring import last_match


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _without(c: Column, *parts: str) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p), F.lit("")), parts, c)


def until_closed(rest: Column) -> Column:
    """What stands before the brace that closes one opened just before `rest`; null if none does."""
    parts = F.regexp_extract_all(rest, F.lit(r"[{}]|[^{}]+"), F.lit(0))
    turn = lambda t: F.when(t == "{", 1).when(t == "}", -1).otherwise(0)
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))
    end = F.aggregate(parts, start, lambda s, t: F.when(s["depth"] == 0, s).otherwise(F.struct((s["depth"] + turn(t)).alias("depth"), (s["n"] + 1).alias("n"))))
    return F.when(end["depth"] == 0, F.array_join(F.slice(parts, F.lit(1), F.greatest(end["n"] - 1, F.lit(0))), ""))


def boxed_answer(text: Column) -> Column:
    r"""Content of the last \boxed: of "\boxed " up to a dollar sign if that form occurs, else between its braces; else null."""
    text = _text(text)
    spaced, rest = "\\boxed ", F.substring_index(text, "\\boxed", -1)
    return F.when(F.contains(text, F.lit(spaced)), F.substring_index(F.substring_index(text, spaced, -1), "$", 1)).when(F.contains(text, F.lit("\\boxed")) & F.startswith(rest, F.lit("{")), until_closed(F.substr(rest, F.lit(2))))


def braced_answer(text: Column) -> Column:
    r"""Content of the last "\boxed{", or null."""
    text, mark = _text(text), "\\boxed{"
    return F.when(F.contains(text, F.lit(mark)), until_closed(F.substring_index(text, mark, -1)))


def latex_normal(raw: Column) -> Column:
    """LaTeX answer without layout, units and percent signs, with braces round the arguments of frac and sqrt; null if malformed."""
    s = _without(raw, "\n", "\\!")
    s = F.replace(s, F.lit("\\\\"), F.lit("\\"))
    s = F.regexp_replace(s, "[td]frac", "frac")
    s = _without(s, "\\left", "\\right", "^{\\circ}", "^\\circ", "\\$")
    unit = r"\\text\{ "
    bad = F.regexp_count(s, F.lit(unit)) > 1
    s = F.regexp_replace(s, f"(?s){unit}.*", "")
    s = _without(s, "\\\\%", "\\%")
    s = F.regexp_replace(F.regexp_replace(s, r"([ {])\.", "$10."), r"\A\.", "0.")
    s = F.regexp_replace(s, r"(?s)\A[^=]{0,2}=([^=]*)\z", "$1")
    bad = bad | s.rlike(r"\\sqrt(\\sqrt|\z)")
    s = F.replace(F.regexp_replace(s, r"(?s)\\sqrt([^{])", r"\\sqrt{$1}"), F.lit(" "), F.lit(""))
    # The first \frac with fewer than two characters up to the next: none at all is malformed, one leaves all as they are.
    short = r"(?s)\\frac(|[^{])(?=\\frac|\z)"
    bad = bad | (s.rlike(short) & (F.regexp_extract(s, short, 1) == ""))
    s = F.when(s.rlike(short), s).otherwise(F.regexp_replace(F.regexp_replace(s, r"(?s)\\frac([^{])([^{])", r"\\frac{$1}{$2}"), r"(?s)\\frac([^{])(?=\{)", r"\\frac{$1}"))
    s = F.when(s == "0.5", "\\frac{1}{2}").otherwise(s)
    whole = "(0|-?[1-9][0-9]*)"
    return F.when(~bad, F.regexp_replace(s, rf"\A{whole}/{whole}\z", r"\\frac{$1}{$2}"))


def latex_equal(a: Column, b: Column) -> Column:
    """Equal after latex_normal, or as they are if one of the two is malformed. Two nulls are equal."""
    x, y = latex_normal(a), latex_normal(b)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).when(x.isNull() | y.isNull(), a == b).otherwise(x == y)


@SCORERS.register("math_boxed")
def math_boxed(text: Column, gold: Column) -> Column:
    """1 if the last boxed answer equals the gold one, else 0."""
    answer = boxed_answer(text)
    return F.when(answer.isNotNull() & latex_equal(answer, gold), 1.0).otherwise(0.0)


# What a final answer is rewritten by, in this order, and then freed of.
REWRITTEN = [("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}")]
REMOVED = ["square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots"]


def final_answer(answer: Column) -> Column:
    """A quantitative answer without words, units and markup; what stands after the last equals sign."""
    s = F.substring_index(answer, "=", -1)
    s = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), REWRITTEN, s)
    s = _without(s, *REMOVED)
    s = F.regexp_replace(s, r"(?d).*?\$(.*?)\$.*", r"\$$1\$")
    for tag in ("text", "textbf", "overline"):
        s = F.regexp_replace(s, rf"(?d)\\{tag}\{{(.*?)\}}", "$1")
    s = F.regexp_replace(s, r"(?d)\\boxed\{(.*)\}", "$1")
    s = F.regexp_replace(s, r"(?d)frac([^{])(.)", "frac{$1}{$2}")
    s = F.replace(F.regexp_replace(s, r"sqrt([^{])", "sqrt{$1}"), F.lit("$"), F.lit(""))
    bare = F.replace(s, F.lit(","), F.lit(""))
    return F.regexp_replace(F.when(bare.rlike(r"\A\p{Nd}+\z"), bare).otherwise(s), r"(?U)\A\s+|\s+\z", "")


def stated_answer(text: Column) -> Column:
    """The normal form of the last "Answer: ..." line, else [INVALID]."""
    return final_answer(F.coalesce(last_match(text, r"(?iU)Answer\s*:\s*([^\n]+)"), F.lit("[INVALID]")))


def math_stated(text: Column, gold: Column, strict_box: bool = False) -> Column:
    """(score 1 or -1, acc, pred): the stated answer of the last 300 characters, or (strict) the boxed one of the last 100."""
    tail = F.right(_text(text), F.lit(300))
    pred = braced_answer(F.right(tail, F.lit(100))) if strict_box else stated_answer(tail)
    right = F.coalesce(pred == (gold if strict_box else final_answer(gold)), F.lit(False))
    return F.struct(F.when(right, 1.0).otherwise(-1.0).alias("score"), right.alias("acc"), pred.alias("pred"))


SCORERS.register("math_stated")(lambda text, gold: math_stated(text, gold)["score"])


def think_and_box(text: Column) -> Column:
    r"""1 if the text begins with a think block and has a \boxed{} after it, else 0."""
    return F.when(_text(text).rlike(r"(?s)\A<think>.*</think>.*\\boxed\{.*\}.*\z"), 1.0).otherwise(0.0)


def tag_layout(text: Column, gold: Column, most: float = 1.0, least: float = 0.0) -> Column:
    """most if the text has the layout that the gold's tags ask for (think, then a tool call, a response or both), else least."""
    text, gold = _text(text), _text(gold)
    parts = {"tool_call": r"<tool_call>\n.*?\n</tool_call>", "response": r"<response>.*?</response>"}
    has = {t: F.contains(gold, F.lit(f"<{t}>")) for t in parts}
    once = lambda t: (F.regexp_count(text, F.lit(f"<{t}>")) == 1) & (F.regexp_count(text, F.lit(f"</{t}>")) == 1)

    def fits(*tags: str) -> Column:
        shape = "\\n".join([r"<think>.*?</think>", *(parts[t] for t in tags)])
        return reduce(lambda a, b: a & b, map(once, tags), text.rlike(rf"(?s)\A{shape}\n?\z"))

    ok = F.when(has["tool_call"] & has["response"], fits("tool_call", "response")).when(has["response"], fits("response")).when(has["tool_call"], fits("tool_call")).otherwise(fits())
    return F.when(ok, most).otherwise(least)


@TOOL_PARSERS.register("hermes")
def json_calls(text: Column) -> Column:
    """Array of (name, arguments as compact JSON) of the <tool_call> blocks, in order; blocks that are no such JSON are left out."""
    found = F.regexp_extract_all(_text(text), F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))
    read = lambda m: F.struct(F.try_variant_get(F.try_parse_json(m), "$.name", "string").alias("name"), F.to_json(F.try_variant_get(F.try_parse_json(m), "$.arguments", "variant")).alias("arguments"))
    return F.filter(F.transform(found, read), lambda c: c["name"].isNotNull() & c["arguments"].isNotNull())


def without_calls(text: Column) -> Column:
    return F.regexp_replace(_text(text), r"(?s)<tool_call>.*?</tool_call>", "")


_CHANNEL_CALL = r"(?s)<\|start\|>assistant<\|channel\|>[^<]* to=functions\.([^<]+) <\|constrain\|>json<\|message\|>(.*?)<\|call\|>"


@TOOL_PARSERS.register("gpt-oss")
def channel_calls(text: Column, pad: str | None = None) -> Column:
    """Array of (name, arguments as they stand) of the calls on a channel; those within analysis don't count."""
    text = _without(_text(text), pad) if pad else _text(text)
    text = F.regexp_replace(text, r"(?s)(<\|start\|>assistant)?<\|channel\|>analysis<\|message\|>.*?<\|end\|>", "")
    part = lambda g: F.regexp_extract_all(text, F.lit(_CHANNEL_CALL), F.lit(g))
    return F.arrays_zip(part(1).alias("name"), part(2).alias("arguments"))
