"""Canonical training samples from raw rows, as column expressions: one projection over the scan, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HIDDEN = {"image": "<image>", "video": "<video>", "audio": "<audio>"}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat(*turns: tuple[str, Column]) -> Column:
    return F.array(*[message(r, c) for r, c in turns])


def replace_content(prompt: Column, role: str, content: Column) -> Column:
    """The messages of a role get a new content, others stay."""
    return F.transform(prompt, lambda m: F.when(m["role"] == role, m.withField("content", content)).otherwise(m))


def _fail(*what: Column | str) -> Column:
    return F.raise_error(F.concat(*[F.lit(w) if isinstance(w, str) else F.coalesce(w, F.lit("null")) for w in what]))


def facts(title: Column, sent_id: Column) -> Column:
    """Array of (title, sent_id); unequal sizes fail."""
    zipped = F.zip_with(title, sent_id, lambda t, i: F.struct(t.cast("string").alias("title"), i.cast("int").alias("sent_id")))
    return F.when(F.size(title) == F.size(sent_id), zipped).otherwise(F.array(F.struct(_fail("facts: arrays of different sizes").cast("string").alias("title"), F.lit(0).alias("sent_id"))))


def route(kind: Column, strategy: Column | None = None) -> Column:
    """compare or bridge, by the kind of the question or else by its strategy; neither fails."""
    k = F.lower(strip(F.coalesce(kind, F.lit(""))))
    s = F.lower(strip(F.coalesce(strategy, F.lit("")))) if strategy is not None else F.lit("")
    return F.when(k.isin("comparison", "compare") | s.isin("parallel", "comparison", "compare"), "compare").when((k == "bridge") | s.isin("sequential", "bridge"), "bridge").otherwise(_fail("no route for ", kind).cast("string"))


def multi_hop_sample(rows: DataFrame, split: str, index: Column, system: str, source: str) -> DataFrame:
    """rows(id, question, answer, type, level, context, supporting_facts) as samples with prompt, reward model and extra_info."""
    c = F.col
    kind = F.lower(strip(c("type")))
    parallel = kind == "comparison"
    gold = facts(c("supporting_facts.title"), c("supporting_facts.sent_id"))
    titles = c("context.title")
    context = F.when((F.size(titles) > 0) & (F.size(titles) == F.size("context.sentences")), c("context")).otherwise(F.struct(_fail("context needs as many sentence lists as titles").cast("array<string>").alias("title"), c("context.sentences").alias("sentences")))
    return rows.select(
        F.lit(source).alias("data_source"),
        F.when(kind.isin("comparison", "bridge"), route(kind)).otherwise(_fail("unknown type ", kind).cast("string")).alias("teacher_route"),
        chat(("system", F.lit(system)), ("user", strip(c("question")))).alias("prompt"),
        F.lit("multi_hop_qa").alias("ability"),
        F.struct(F.lit("rule").alias("style"), F.array(strip(c("answer"))).alias("ground_truth")).alias("reward_model"),
        F.struct(
            index.cast("long").alias("index"), c("id").cast("string").alias("id"), F.lit(split).alias("split"), strip(c("question")).alias("question"), kind.alias("question_type"), c("level").cast("string").alias("level"),
            F.when(parallel, "parallel").otherwise("sequential").alias("expected_strategy"), F.when(parallel, F.array(F.lit(2))).otherwise(F.array(F.lit(1), F.lit(1))).alias("expected_call_groups"),
            F.array_distinct(F.transform(gold, lambda f: f["title"])).alias("gold_titles"), gold.alias("gold_facts"), F.array(F.lit("search")).alias("tool_selection"), F.lit(True).alias("need_tools_kwargs"),
            F.struct(F.struct(F.struct(context.alias("context")).alias("create_kwargs")).alias("search")).alias("tools_kwargs"),
        ).alias("extra_info"),
    )


def sentences_of(title: Column, titles: Column, sentences: Column) -> Column:
    """The sentences of a title, by its last entry; none if there is none."""
    entry = F.get(F.filter(F.reverse(F.arrays_zip(titles.alias("t"), sentences.alias("s"))), lambda e: e["t"] == title), 0)
    return F.coalesce(entry["s"], F.array().cast("array<string>"))


def evidence(gold: Column, titles: Column, sentences: Column) -> Column:
    """Up to two passages "[title] sentence" of gold facts; a number out of range gives the first two sentences."""

    def passage(f: Column) -> Column:
        title = strip(F.coalesce(f["title"], F.lit("")))
        s, i = sentences_of(title, titles, sentences), F.coalesce(f["sent_id"], F.lit(0))
        said = F.when((i >= 0) & (i < F.size(s)), F.get(s, i)).otherwise(F.array_join(F.slice(s, 1, 2), " "))
        return F.when(F.size(s) > 0, F.concat(F.lit("["), title, F.lit("] "), said))

    return F.slice(F.filter(F.transform(F.coalesce(gold, F.array().cast("array<struct<title:string,sent_id:int>>")), passage), lambda p: p.isNotNull()), 1, 2)


def gold_documents(gold: Column, titles: Column, sentences: Column) -> Column:
    """Array of (title, paragraph, supporting_sentences) for each distinct title, first seen first."""

    def document(t: Column) -> Column:
        s = sentences_of(t, titles, sentences)
        ids = F.filter(F.transform(F.filter(gold, lambda f: f["title"] == t), lambda f: f["sent_id"]), lambda i: (i >= 0) & (i < F.size(s)))
        return F.struct(t.alias("title"), F.array_join(s, " ").alias("paragraph"), F.transform(ids, lambda i: F.get(s, i)).alias("supporting_sentences"))

    return F.transform(F.array_distinct(F.transform(gold, lambda f: f["title"])), document)


def hash_answer(text: Column) -> Column:
    """The first "#### number" without commas; a text without one fails."""
    found = F.regexp_extract(text, r"#### (-?[0-9.,]+)", 1)
    return F.when(found != "", F.replace(found, F.lit(","), F.lit(""))).otherwise(_fail("no #### answer in ", F.left(text, F.lit(80))).cast("string"))


def clean_choice(text: Column) -> Column:
    """Trimmed, " [title]" as a full stop, other brackets deleted, double spaces halved."""
    s = F.replace(strip(text), F.lit(" [title]"), F.lit(". "))
    return F.replace(F.regexp_replace(s, r"(?d)\[.*?\]", ""), F.lit("  "), F.lit(" "))


def choice_sample(rows: DataFrame, split: str, index: Column, source: str) -> DataFrame:
    """rows(activity_label, ctx_a, ctx_b, endings, label) as multiple-choice samples."""
    b = F.concat(F.upper(F.left("ctx_b", F.lit(1))), F.lower(F.substr(F.col("ctx_b"), F.lit(2))))
    question = clean_choice(F.concat("activity_label", F.lit(": "), "ctx_a", F.lit(" "), b))
    model = F.struct(F.lit("model").alias("style"), F.lit("multiple_choice").alias("eval"), F.col("label").cast("int").alias("ground_truth"), F.transform("endings", clean_choice).alias("choices"))
    return rows.select(F.lit(source).alias("data_source"), chat(("user", question)).alias("prompt"), F.lit("nlp").alias("ability"), model.alias("reward_model"), F.struct(F.lit(split).alias("split"), index.cast("long").alias("index")).alias("extra_info"))


def media_parts(content: Column, before: dict[str, Column] | None = None) -> Column:
    """Array of (type, text, place) of a message: texts between the marks, and marks with their place in the list of their kind.

    before: how many of a kind earlier messages hold (0 if absent).
    """
    marks = "|".join(f"(?<={m})|(?={m})" for m in _HIDDEN.values())
    parts = F.filter(F.split(F.coalesce(content, F.lit("")), marks), lambda p: p != "")

    def part(p: Column, i: Column) -> Column:
        out = F.struct(F.lit("text").alias("type"), p.alias("text"), F.lit(None).cast("int").alias("place"))
        for kind, mark in _HIDDEN.items():
            seen = F.size(F.filter(F.slice(parts, F.lit(1), i), lambda x: x == mark)) + (before or {}).get(kind, F.lit(0))
            out = F.when(p == mark, F.struct(F.lit(kind).alias("type"), F.lit(None).cast("string").alias("text"), seen.cast("int").alias("place"))).otherwise(out)
        return out

    return F.transform(parts, part)


def positional_split(rows: DataFrame, share: float = 0.75, row: str = "row_idx") -> DataFrame:
    """Column split: train for the first share of rows numbered from 0, else test. The count is one number for all."""
    n = rows.agg(F.floor(F.count("*") * share).alias("_cut"))
    return rows.join(F.broadcast(n)).withColumn("split", F.when(F.col(row) < F.col("_cut"), "train").otherwise("test")).drop("_cut")
