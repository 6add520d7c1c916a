"""Sources, caches and canonical samples over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batch as B
from ..plans import samples as S
from ..session import table, work_dir
from ..sources import tables as T
from .base import query


def _qa(s, d):
    """Multi-hop questions made from benchmark items, with a context of two documents."""
    b = table(s, d, "benchmark").where("text IS NOT NULL")
    facts = F.struct(F.array(F.lit("T2"), F.lit("T1"), F.lit("T2")).alias("title"), F.array(F.lit(0), F.lit(1), F.lit(9)).alias("sent_id"))
    context = F.struct(F.array(F.lit("T1"), F.lit("T2")).alias("title"), F.array(F.array(F.col("text"), F.lit("b")), F.array(F.lit("c"))).alias("sentences"))
    return b.select(
        "item_id", F.col("item_id").cast("string").alias("id"), F.concat(F.lit(" \nQ "), "text", F.lit("? ")).alias("question"), F.concat(F.lit(" "), F.col("item_id").cast("string")).alias("answer"),
        F.when(F.col("item_id") % 2 == 1, " Comparison").otherwise("bridge").alias("type"), F.lit("hard").alias("level"), context.alias("context"), facts.alias("supporting_facts"),
    )


def _samples(s, d):
    return S.multi_hop_sample(_qa(s, d), "train", F.col("item_id"), "Answer.", "qa")


_ODD = "item_id % 2 = 1"
query("qa_sample", f"SELECT item_id, 'Q ' || text || '?' AS question, CAST(item_id AS VARCHAR) AS answer, CASE WHEN {_ODD} THEN 'compare' ELSE 'bridge' END AS teacher_route, CASE WHEN {_ODD} THEN 'parallel' ELSE 'sequential' END AS strategy, CASE WHEN {_ODD} THEN '2' ELSE '1,1' END AS call_groups, 'T2,T1' AS gold_titles, '[T2] c|[T1] b' AS evidence FROM benchmark WHERE text IS NOT NULL")(
    lambda s, d: _samples(s, d).select(F.col("extra_info.index").alias("item_id"), F.get("prompt", 1)["content"].alias("question"), F.get("reward_model.ground_truth", 0).alias("answer"), "teacher_route", F.col("extra_info.expected_strategy").alias("strategy"), F.array_join(F.col("extra_info.expected_call_groups").cast("array<string>"), ",").alias("call_groups"), F.array_join("extra_info.gold_titles", ",").alias("gold_titles"), F.array_join(S.evidence(F.col("extra_info.gold_facts"), F.col("extra_info.tools_kwargs.search.create_kwargs.context.title"), F.col("extra_info.tools_kwargs.search.create_kwargs.context.sentences")), "|").alias("evidence"))
)
query("gold_documents", "SELECT item_id, title, paragraph, supporting FROM (SELECT item_id, 'T2' AS title, 'c' AS paragraph, 'c' AS supporting FROM benchmark WHERE text IS NOT NULL UNION ALL SELECT item_id, 'T1', text || ' b', 'b' FROM benchmark WHERE text IS NOT NULL)")(
    lambda s, d: _qa(s, d).select("item_id", F.explode(S.gold_documents(S.facts(F.col("supporting_facts.title"), F.col("supporting_facts.sent_id")), F.col("context.title"), F.col("context.sentences"))).alias("g")).select("item_id", "g.title", "g.paragraph", F.array_join("g.supporting_sentences", "|").alias("supporting"))
)
query("context_documents", "SELECT 'T2' AS title, 'c' AS text FROM benchmark WHERE text IS NOT NULL UNION ALL SELECT 'T1', trim(text, chr(32) || chr(9) || chr(10) || chr(13)) || '|b' FROM benchmark WHERE text IS NOT NULL")(lambda s, d: T.explode_contexts(_qa(s, d)).select("title", F.array_join("sentences", "|").alias("text")))
query("choice_sample", "SELECT conv_id, turn, 'Do: it. ' || role || ' A b c' AS question, 'x ' || role AS choice FROM conversations WHERE role IS NOT NULL")(
    lambda s, d: S.choice_sample(
        table(s, d, "conversations").where("role IS NOT NULL").select(F.lit("Do").alias("activity_label"), F.concat(F.lit("it [title]"), "role").alias("ctx_a"), F.lit("a [x]b C").alias("ctx_b"), F.array(F.concat(F.lit(" [y]x  "), "role")).alias("endings"), F.lit("0").alias("label"), "conv_id", "turn").withColumn("at", F.struct("conv_id", "turn")),
        "train", F.col("conv_id") * 1000 + F.col("turn"), "choice",
    ).select(F.floor(F.col("extra_info.index") / 1000).alias("conv_id"), (F.col("extra_info.index") % 1000).alias("turn"), F.get("prompt", 0)["content"].alias("question"), F.get("reward_model.choices", 0).alias("choice"))
)
query("placeholder_split", "SELECT conv_id, turn, unnest(['text', 'image', 'image', 'text', 'audio']) AS type, unnest([text, NULL, NULL, 'z', NULL]) AS text, unnest([NULL, 0, 1, NULL, 0]) AS place FROM conversations WHERE text <> ''")(
    lambda s, d: table(s, d, "conversations").where("text <> ''").select("conv_id", "turn", F.explode(S.media_parts(F.concat("text", F.lit("<image><image>z<audio>")))).alias("p")).select("conv_id", "turn", "p.*")
)
query("positional_split", "SELECT o_orderkey, CASE WHEN i < floor(n * 0.75) THEN 'train' ELSE 'test' END AS split FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)")(
    lambda s, d: S.positional_split(B.with_row_index(table(s, d, "orders").select("o_orderkey"), "o_orderkey")).select("o_orderkey", "split")
)
query("cache_last_wins", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_type <> 'error') WHERE n = 1")(
    lambda s, d: T.last_wins(table(s, d, "events").where("event_type <> 'error'").select("user_id", "event_id", "value"), ["user_id"], "event_id")
)


def _dumped(s, d):
    path = work_dir(s, "steps")
    rows = table(s, d, "conversations").where("text IS NOT NULL").select("conv_id", "turn", "text")
    for step in (1, 2):
        T.dump_step(rows.where(F.col("conv_id") % 2 == step - 1), path, step, "parquet")
    return T.load_steps(s, path, "parquet", ("the", "\n"))


query("step_dumps", "SELECT conv_id, turn, replace(replace(text, 'the', '*'), chr(10), '*') AS text, conv_id % 2 + 1 AS step FROM conversations WHERE text IS NOT NULL")(_dumped)
query("search_rows", "SELECT doc_id, source FROM documents WHERE contains(coalesce(text, ''), 'the and') OR contains(coalesce(source, ''), 'the and') OR contains(coalesce(lang, ''), 'the and')")(lambda s, d: T.search(table(s, d, "documents"), "the and").select("doc_id", "source"))
query("result_page", "SELECT traj, price FROM (SELECT o_orderkey AS traj, o_totalprice AS price FROM orders ORDER BY price DESC, traj LIMIT 20 OFFSET 40)")(lambda s, d: T.page(table(s, d, "orders").select(F.col("o_orderkey").alias("traj"), F.col("o_totalprice").alias("price")), [F.desc("price"), F.asc("traj")], 40, 20))
