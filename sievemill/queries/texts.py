"""Retrieval and text scorers over documents, benchmark, embeddings and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators import scoring as S
from ..operators import searchindex as I
from ..session import table
from .base import query, r

_STOP = "[" + ", ".join(f"'{w}'" for w in R.STOP_WORDS) + "]"
_TERMS = "list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+|[\\x{3400}-\\x{9fff}]'), lambda t: NOT list_contains(" + _STOP + ", t))"
_BM25 = f"""i AS (SELECT doc_id, {_TERMS} AS ts FROM documents), l AS (SELECT doc_id, greatest(len(ts), 1) AS len FROM i), z AS (SELECT count(*) AS n, avg(len) AS a FROM l)
    , q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY 1, 2)
    , p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM i) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2)
    , d AS (SELECT term, count(*) AS df FROM p GROUP BY 1)
    , s AS (SELECT query_id, doc_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / a))) AS score FROM p JOIN q USING (term) JOIN d USING (term) JOIN l USING (doc_id), z GROUP BY 1, 2)
    , lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s QUALIFY rank <= 10)"""
_DENSE = """e AS (SELECT vec_id, embedding FROM embeddings), x AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) AS score FROM e a, e b WHERE a.vec_id % 20 = 0)
    , den AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM x QUALIFY rank <= 10)"""


def _bm25(s, d):
    index = I.index_of(table(s, d, "documents"), (d, "words"), fields={"text": 1.0})
    return I.search(s, index, table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 10)


def _full_text(s, d):
    index = I.index_of(table(s, d, "documents"), (d, "full text"), fields={"source": 3.0, "text": 1.0}, token=I.LETTERS, stop=False, least=0, k1=1.2)
    return I.search(s, index, table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 5, I.floored_idf, False)


def _dense(s, d):
    e = table(s, d, "embeddings")
    return R.dense(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v")), e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 10)


query("bm25_topk", f"WITH {_BM25} SELECT query_id, doc_id, {r('score', 'score')}, CAST(rank AS INTEGER) AS rank FROM lex")(_bm25)
query("dense_topk", f"WITH {_DENSE} SELECT query_id, doc_id, {r('score', 'score')}, CAST(rank AS INTEGER) AS rank FROM den")(_dense)
query("rrf_fusion", f"WITH {_BM25}, {_DENSE}, u AS (SELECT query_id, doc_id, 1.0 / (60 + rank) AS p FROM lex UNION ALL SELECT query_id, doc_id, 2.0 / (60 + rank) FROM den), f AS (SELECT query_id, doc_id, sum(p) AS score FROM u GROUP BY 1, 2) SELECT query_id, doc_id, {r('score', 'score')}, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM f QUALIFY rank <= 5")(
    lambda s, d: R.fuse(5, 60, (_bm25(s, d), 1), (_dense(s, d), 2))
)
query("retrieval_recall", f"WITH {_DENSE}, g AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 20 = 0) SELECT g.query_id, {r('avg(CASE WHEN den.doc_id IS NULL THEN 0 ELSE 1 END)', 'recall')} FROM g LEFT JOIN den ON g.query_id = den.query_id AND g.doc_id = den.doc_id GROUP BY 1")(
    lambda s, d: R.class_recall(_dense(s, d), table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), table(s, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label"))
)
query("corpus_dedupe_first", "SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text")(lambda s, d: R.dedupe(table(s, d, "documents").where("text IS NOT NULL").select("doc_id", "text"), F.col("text"), "doc_id").select("doc_id"))
query("corpus_dedupe_longest", "SELECT doc_id, k AS key FROM (SELECT doc_id, source || lang AS k, row_number() OVER (PARTITION BY source || lang ORDER BY length(text) DESC, doc_id) AS n FROM documents WHERE text IS NOT NULL) WHERE n = 1")(
    lambda s, d: R.dedupe(table(s, d, "documents").where("text IS NOT NULL").select("doc_id", "text", F.concat("source", "lang").alias("key")), F.col("key"), "doc_id", "text").select("doc_id", "key")
)
_MADE = "(SELECT conv_id, turn, '<think>' || text || '</think> so <answer> The ' || role || ', ' || conv_id || '</answer> #### ' || conv_id || ',000' AS text, conv_id || '000' AS gold, role FROM conversations WHERE text IS NOT NULL)"


def _made(s, d):
    c = table(s, d, "conversations").where("text IS NOT NULL")
    text = F.concat(F.lit("<think>"), "text", F.lit("</think> so <answer> The "), "role", F.lit(", "), F.col("conv_id").cast("string"), F.lit("</answer> #### "), F.col("conv_id").cast("string"), F.lit(",000"))
    return c.select("conv_id", "turn", text.alias("text"), F.concat(F.col("conv_id").cast("string"), F.lit("000")).alias("gold"), "role")


def _t():
    return F.col("text")


query("last_answer", f"SELECT conv_id, turn, 'The ' || role || ', ' || conv_id AS answer, lower(role) || ' ' || conv_id AS normal FROM {_MADE}")(lambda s, d: _made(s, d).select("conv_id", "turn", S.answer_tag(_t()).alias("answer"), S.normalize_answer(S.answer_tag(_t())).alias("normal")))
query("numeric_answer", f"SELECT conv_id, turn, gold AS answer, conv_id || ',000' AS loose, {r('1', 'score')} FROM {_MADE}")(lambda s, d: _made(s, d).select("conv_id", "turn", S.numeric_answer(_t()).alias("answer"), S.numeric_answer(_t(), False).alias("loose"), S.gsm8k(_t(), F.col("gold")).alias("score")))
query("qa_em", f"SELECT conv_id, turn, {r('CASE WHEN role = ' + chr(39) + 'user' + chr(39) + ' THEN 1 ELSE 0.1 END', 'em')}, {r('1', 'sub')} FROM {_MADE}")(
    lambda s, d: _made(s, d).select("conv_id", "turn", S.qa_em(_t(), F.array(F.concat(F.lit("a User "), F.col("conv_id").cast("string"))), 0.1).alias("em"), S.qa_em(_t(), F.array(F.col("role")), match=S.sub_match).alias("sub"))
)
query("token_f1", f"SELECT conv_id, turn, {r('CASE WHEN role = ' + chr(39) + 'user' + chr(39) + ' THEN 0.8 ELSE 0.4 END', 'f1')} FROM {_MADE}")(lambda s, d: _made(s, d).select("conv_id", "turn", S.token_f1(S.answer_tag(_t()), F.concat(F.lit("the user of "), F.col("conv_id").cast("string"))).alias("f1")))
query("think_lengths", "SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS INTEGER) AS n FROM conversations WHERE text IS NOT NULL AND NOT regexp_matches(text, '(?i)</?think>')")(lambda s, d: _made(s, d).where(~F.lower("text").rlike("(?s)think>.*think>.*think>")).select("conv_id", "turn", S.think_lengths(_t())[0].alias("n")))

# Each item's own context: its text as two documents' sentences, asked for its first words.
_CTX = """c AS (SELECT item_id, coalesce(text, '') AS text, left(coalesce(text, ''), 40) AS q FROM benchmark)
    , d AS (SELECT item_id, q, 'Alpha' AS title, [left(text, 90), substr(text, 91, 90)] AS ss FROM c UNION ALL SELECT item_id, q, 'beta', [substr(text, 60, 100)] FROM c UNION ALL SELECT item_id, q, 'Gamma', ['nothing'] FROM c)
    , w AS (SELECT item_id, q, title, ss, list_concat(list_concat(t, list_concat(t, t)), x) AS ts FROM (SELECT *, """ + _TERMS.replace("coalesce(text, '')", "title") + """ AS t, """ + _TERMS.replace("coalesce(text, '')", "array_to_string(ss, ' ')") + """ AS x FROM d))
    , m AS (SELECT item_id, avg(greatest(len(ts), 1)) AS mean FROM w GROUP BY 1)
    , a AS (SELECT DISTINCT item_id, unnest(""" + _TERMS.replace("coalesce(text, '')", "q") + """) AS term FROM c)
    , f AS (SELECT w.item_id, w.title, term, len(ts) AS len, len(list_filter(ts, lambda t: t = term)) AS tf FROM w JOIN a ON w.item_id = a.item_id)
    , g AS (SELECT item_id, term, count(*) FILTER (tf > 0) AS df FROM f GROUP BY 1, 2)
    , s AS (SELECT f.item_id, f.title, sum(ln(1 + (3 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * greatest(f.len, 1) / mean))) AS score FROM f JOIN g ON f.item_id = g.item_id AND f.term = g.term JOIN m ON f.item_id = m.item_id GROUP BY 1, 2)
    , b AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, lower(title)) AS n FROM s)"""


def _contexts(s, d):
    t = F.coalesce("text", F.lit(""))
    return table(s, d, "benchmark").select("item_id", F.left(t, F.lit(40)).alias("q"), F.array(F.lit("Alpha"), F.lit("beta"), F.lit("Gamma")).alias("title"), F.array(F.array(F.left(t, F.lit(90)), F.substr(t, F.lit(91), F.lit(90))), F.array(F.substr(t, F.lit(60), F.lit(100))), F.array(F.lit("nothing"))).alias("ss"))


query("context_search", f"WITH {_CTX} SELECT item_id, title, {r('score', 'score')} FROM b WHERE n <= 2 AND round(score, 9) > 0")(
    lambda s, d: _contexts(s, d).select("item_id", F.explode(R.search_context(F.col("q"), F.col("title"), F.col("ss"))).alias("f")).select("item_id", "f.title", "f.score")
)
query("search_answers", f"WITH {_CTX}, n AS (SELECT item_id, count(*) FILTER (n <= 2 AND round(score, 9) > 0) AS k, count(*) FILTER (n <= 2 AND round(score, 9) > 0 AND title = 'Alpha') AS hit FROM b GROUP BY 1) SELECT c.item_id, CASE WHEN trim(q, chr(32) || chr(9) || chr(10) || chr(13)) = '' OR c.item_id % 5 = 0 THEN 0 ELSE coalesce(k, 0) END ::INTEGER AS results, trim(q, chr(32) || chr(9) || chr(10) || chr(13)) = '' OR c.item_id % 5 = 0 AS format_error, {r('CASE WHEN trim(q, chr(32) || chr(9) || chr(10) || chr(13)) = ' + chr(39) * 2 + ' OR c.item_id % 5 = 0 THEN 0 ELSE coalesce(hit, 0) / 2.0 END', 'recall')} FROM c LEFT JOIN n USING (item_id)")(
    lambda s, d: _contexts(s, d).withColumn("g", R.answer_search(F.col("q"), F.col("title"), F.col("ss"), F.col("item_id") % 5 != 0)).select("item_id", "g.results", "g.format_error", R.title_recall(F.col("g.titles"), F.array(F.lit(" ALPHA"), F.lit("x"))).alias("recall"))
)
query("full_text_search", """WITH x AS (SELECT doc_id, regexp_extract_all(lower(coalesce(source, '')), '[\\p{L}\\p{N}]+') AS t, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS b FROM documents), l AS (SELECT doc_id, len(t) + len(b) AS len FROM x), z AS (SELECT count(*) AS n, avg(len) AS a FROM l)
    , q AS (SELECT DISTINCT item_id AS query_id, unnest(""" + _TERMS + f""") AS term FROM benchmark), e AS (SELECT doc_id, unnest(t) AS term, 3.0 AS c FROM x UNION ALL SELECT doc_id, unnest(b), 1.0 FROM x), p AS (SELECT doc_id, term, sum(c) AS tf FROM e WHERE term IN (SELECT term FROM q) GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM p GROUP BY 1)
    , s AS (SELECT query_id, doc_id, sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))) AS score FROM p JOIN q USING (term) JOIN d USING (term) JOIN l USING (doc_id), z GROUP BY 1, 2)
    SELECT query_id, doc_id, {r('score', 'score')}, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""")(_full_text)
