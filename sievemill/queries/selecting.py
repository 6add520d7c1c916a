"""Gates, quotas and sample building over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import selection as S
from ..plans.views import trajectories
from ..session import table
from .base import query

query("quota_sample", "SELECT doc_id, source, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place FROM documents) WHERE (lang = 'en' AND place <= 12) OR (lang = 'fr' AND place <= 8)")(
    lambda s, d: S.take_per_class(table(s, d, "documents").select("doc_id", "source", "lang"), "lang", "doc_id", dict(zip(("en", "fr"), S.quotas(20, 0.625)))).select("doc_id", "source", "place")
)
query("first_failing_check", "SELECT doc_id, CASE WHEN n_chars < 200 OR n_chars IS NULL THEN 'short' WHEN lang <> 'en' OR lang IS NULL THEN 'lang' WHEN text LIKE '%  %' OR text IS NULL THEN 'spaces' ELSE 'accepted' END AS verdict FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", S.first_failing(("short", F.col("n_chars") >= 200), ("lang", F.col("lang") == "en"), ("spaces", ~F.contains("text", F.lit("  ")))).alias("verdict"))
)
query("unpivot_pairs", "SELECT url AS prompt, html AS response FROM pages UNION ALL SELECT url, CAST(page_id AS VARCHAR) FROM pages")(lambda s, d: S.unpivot_pairs(table(s, d, "pages").withColumn("id", F.col("page_id").cast("string")), "url", "html", "id"))
query("role_rewrite", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END AS role FROM conversations")(
    lambda s, d: table(s, d, "conversations").select("conv_id", "turn", S.rename_roles(F.col("role"), {"user": "human", "assistant": "gpt", "system": "system"}).alias("role"))
)
query("kk_partition")(lambda s, d: S.balance(trajectories(s, d).select("traj_id", "len"), "traj_id", "len", 8))
query("greedy_partition")(lambda s, d: S.greedy_balance(trajectories(s, d).select("traj_id", "len"), "traj_id", "len", 8))

# Questions with names of a country and choices added, answers of countries (with accents and capitals) and of the text's own words.
_Q = """concat_ws(' ', text, CASE doc_id % 5 WHEN 0 THEN 'by a BRAZILIAN of São Paulo' WHEN 1 THEN 'in ﬁelds of Méxicans, Mexican or not' WHEN 2 THEN 'Rome or Ávila' WHEN 3 THEN 'New-Zealander' END)"""
_A = "CASE doc_id % 7 WHEN 0 THEN 'BRAZIL' WHEN 1 THEN 'México' WHEN 2 THEN 'avila' WHEN 3 THEN 'new zealand' WHEN 4 THEN 'Yes.' WHEN 5 THEN upper(split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3)) END"
query("leakage_reasons", f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'Comparison ' ELSE source END AS kind, {_Q} AS q, {_A} AS a FROM documents),
    w AS (SELECT doc_id, kind, regexp_extract_all(strip_accents(replace(replace(lower(q), 'ﬁ', 'fi'), 'ß', 'ss')), '[a-z0-9]+') AS q, coalesce(regexp_extract_all(strip_accents(replace(lower(a), 'ß', 'ss')), '[a-z0-9]+'), []) AS a FROM t),
    n AS (SELECT *, ' ' || array_to_string(q, ' ') || ' ' AS line, array_to_string(a, ' ') AS name FROM w),
    p AS (SELECT *, contains(line, ' ' || name || ' ') AND (list_has_any(a, ['or', 'and']) OR regexp_matches(line, ' (or|and)( [a-z0-9]+){{0,3}} ' || name || ' ') OR regexp_matches(line, ' ' || name || '( [a-z0-9]+){{0,3}} (or|and) ')) AS choice FROM n)
    SELECT doc_id, CASE WHEN len(a) = 0 OR name IN ('yes', 'no') OR lower(trim(kind)) = 'comparison' OR choice THEN NULL WHEN contains(line, ' ' || name || ' ') THEN 'answer_in_question'
        WHEN (name = 'brazil' AND contains(line, ' brazilian ')) OR (name = 'mexico' AND contains(line, ' mexican ')) OR (name = 'new zealand' AND contains(line, ' new zealander ')) THEN 'country_demonym_in_question' END AS reason FROM p""")(
    lambda s, d: table(s, d, "documents").select("doc_id", S.leakage_reason(F.expr(_Q), F.expr(_A), F.when(F.col("doc_id") % 11 == 0, "Comparison ").otherwise(F.col("source"))).alias("reason"))
)
