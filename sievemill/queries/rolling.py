"""Rollouts in rounds with a model and tools that are rules, and payloads fetched by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rollouts as R
from ..session import table, work_dir
from ..sources import tables as N
from ..sources.payloads import Payloads
from .base import query

_LIMITS = R.Limits(response=120, model_turns=5, tool_turns=4, calls=2)
_points = lambda c: F.transform(F.filter(F.split(c, ""), lambda x: x != ""), F.ascii)
_text = lambda c: F.array_join(F.transform(c, F.char), "")


def _rollouts(s, d):
    """A customer's row asks in turn t (id * t) mod 4 times how many customers a nation has."""
    customer = table(s, d, "customer")
    counts = customer.groupBy("c_nationkey").agg(F.count("*").alias("n"))

    def generate(rows):
        times = ((F.col("id") * (F.col("turn") + 1)) % 4).cast("int")
        call = F.concat(F.lit("<q>"), ((F.col("id") + F.col("turn")) % 25).cast("string"), F.lit("</q>"))
        return rows.withColumn("new", _points(F.concat(F.lit("t"), (F.col("turn") + 1).cast("string"), F.repeat(call, times))))

    def read_calls(new):
        return F.transform(F.regexp_extract_all(_text(new), F.lit("<q>(\\d+)</q>")), lambda x: F.struct(F.lit("count").alias("name"), x.alias("arguments")))

    def use_tools(calls):
        return calls.join(F.broadcast(counts), F.col("arguments").cast("long") == F.col("c_nationkey"), "left").withColumn("answer", F.concat(F.lit("["), F.coalesce(F.col("n"), F.lit(0)).cast("string"), F.lit("]"))).drop("n", "c_nationkey")

    prompts = customer.select(F.col("c_custkey").alias("id"), _points(F.col("c_name")).alias("ids"))
    short = lambda answers: _points(F.array_join(F.transform(answers, lambda a: F.when(a == _LIMITS.refusal, "[!]").otherwise(a)), ""))
    out = R.roll_out(prompts, work_dir(s, "rollouts"), _LIMITS, generate, read_calls, use_tools, short)
    return out.select("id", _text(F.col("prompt")).alias("prompt"), _text(F.col("response")).alias("response"), F.array_join("mask", "").alias("mask"), F.col("n_turns").cast("long").alias("n_turns"), F.col("n_calls").cast("long").alias("n_calls"), "ended")


query("tool_rollouts", """WITH RECURSIVE n AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1),
    s(id, turn, tools, calls, text, mask, ended) AS (
        SELECT c_custkey, 0, 0, 0, '', '', NULL::VARCHAR FROM customer
        UNION ALL
        SELECT id, turn, CASE WHEN e IS NULL THEN tools + 1 ELSE tools END, CASE WHEN w IS NULL THEN calls + m ELSE calls END,
               CASE WHEN e IS NULL THEN text || answer ELSE text END, CASE WHEN e IS NULL THEN mask || repeat('0', length(answer)) ELSE mask END, e
        FROM (
            SELECT *, coalesce(w, CASE WHEN length(text) + length(answer) >= 120 THEN 'answer too long' END) AS e FROM (
                SELECT id, turn, tools, calls, text, mask, m, CASE WHEN length(text) >= 120 THEN 'full' WHEN turn >= 5 THEN 'model turns' WHEN tools >= 4 THEN 'tool turns' WHEN m = 0 THEN 'no calls' END AS w,
                       repeat('[' || coalesce(n, 0) || ']', least(m, 2)::BIGINT) || repeat('[!]', greatest(m - 2, 0)::BIGINT) AS answer
                FROM (
                    SELECT id, turn + 1 AS turn, tools, calls, text || said AS text, mask || repeat('1', length(said)) AS mask, m, n
                    FROM (SELECT s.*, (id * (turn + 1)) % 4 AS m, 't' || (turn + 1) || repeat('<q>' || ((id + turn) % 25) || '</q>', ((id * (turn + 1)) % 4)::BIGINT) AS said, n.n FROM s LEFT JOIN n ON n.k = (s.id + s.turn) % 25 WHERE s.ended IS NULL)
                )
            )
        )
    )
    SELECT id, c_name AS prompt, left(text, 120) AS response, left(mask, 120) AS mask, CAST(turn + tools + 1 AS BIGINT) AS n_turns, CAST(calls AS BIGINT) AS n_calls, ended FROM s JOIN customer ON c_custkey = id WHERE ended IS NOT NULL""")(_rollouts)


def _separate(s, d):
    """The two longest documents of each source and language by tags alone; then their texts, and what a function made of them."""
    store = Payloads(s, "doc_id", 16)
    docs = table(s, d, "documents")
    keys = store.put(docs.select("doc_id", "source", "lang", "n_chars", "text"), "text")

    @store.bridge(["text"], ["words"])
    def count_words(rows):
        return rows.withColumn("words", F.size(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))).cast("long"))

    from pyspark.sql import Window

    best = keys.withColumn("place", F.row_number().over(Window.partitionBy("source", "lang").orderBy(F.col("n_chars").desc_nulls_last(), "doc_id"))).where("place <= 2").drop("place")
    return store.fetch(count_words(best), "text", "words").select("doc_id", "source", "lang", "words", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


query("payload_separation", "SELECT doc_id, source, lang, CAST(len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS BIGINT) AS words, sha256(coalesce(text, '')) AS text_sha256 FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC NULLS LAST, doc_id) AS place FROM documents) WHERE place <= 2")(_separate)


def _growing(s, d):
    """Lines whose fields and kinds of numbers grow, as one typed table."""
    line = F.when(F.col("turn") % 3 == 0, F.format_string('{"conv": %d, "x": %d}', "conv_id", "turn")).when(F.col("turn") % 3 == 1, F.format_string('{"conv": %d, "x": %d.5, "more": {"a": %d}}', "conv_id", "turn", "turn")).otherwise(F.format_string('{"conv": %d, "more": {"b": "t%d", "a": null}}', "conv_id", "turn"))
    out = N.merged_rows(table(s, d, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL").select(line.alias("line")), "line")
    return out.select("conv", "x", F.col("more.a").alias("a"), F.col("more.b").alias("b"))


query("merged_rows", "SELECT conv_id AS conv, CASE turn % 3 WHEN 0 THEN turn WHEN 1 THEN turn + 0.5 END::DOUBLE AS x, CASE WHEN turn % 3 = 1 THEN turn END AS a, CASE WHEN turn % 3 = 2 THEN 't' || turn END AS b FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL")(_growing)
