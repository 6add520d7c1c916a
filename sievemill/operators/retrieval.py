"""Lexical and dense retrieval of the best k for each query, their fusion and their recall.

Scores are rounded before they rank, so that the order of a sum decides no tie; further ties go to the smaller id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

TOKEN = "[a-z0-9]+|[\\u3400-\\u9fff]"
#: Bytes of queries that are broadcast at once, scores that a task holds at once (by words, by vectors), and queries that words are looked up for at once.
BLOCK_BYTES, SCORES, CELLS, QUERIES = 8 << 20, 1 << 21, 1 << 19, 1 << 16
#: Words that no index and no query holds.
STOP_WORDS = "a an and are as at be by did do does for from has have how in is it of on or that the to was were what when where which who with".split()


def terms(text: Column) -> Column:
    """Lower-case words and single Chinese characters without STOP_WORDS; of null none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(STOP_WORDS))


def rank(df: DataFrame, k: int | None, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """Column rank, from 1, by score; the best k. Spark cuts each partition to k before it shuffles."""
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.round("score", 9).desc(), doc))
    out = df.withColumn("rank", place)
    return out.where(F.col("rank") <= k) if k else out


def bm25(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, doc_id, score, rank of the best k of docs(doc_id, text) for each of queries(query_id, text).

    One scan counts in how many documents each query word stands, combined map-side. A second scan scores: a task holds
    the queries' weights by word (blocks of at most QUERIES queries and BLOCK_BYTES), scores its documents a chunk at a
    time, and keeps k rows for each query; so a word of very many documents costs no shuffle, and no row for each pair.
    Repeated query words count as often as they stand. Documents without a query word have no row.
    """
    asked = queries.where("query_id is not null").select("query_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    n_queries, size = asked.agg(F.count_distinct("query_id"), F.coalesce(F.sum(F.octet_length("term") + 24), F.lit(0))).first()
    blocks = max(1, -(-size // BLOCK_BYTES), -(-n_queries // QUERIES))
    indexed = docs.where("doc_id is not null").select("doc_id", terms(F.col("text")).alias("terms"))
    totals = indexed.agg(F.count("*").alias("n"), F.avg(F.greatest(F.size("terms"), F.lit(1))).alias("avg_len"))
    n, mean = totals.first()
    held = indexed.select(F.explode(F.array_distinct("terms")).alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    weights = asked.join(held, "term").withColumn("weight", F.col("times") * F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weights = weights.select("query_id", "term", "weight")
    if blocks > 1:
        weights = weights.persist()
    parts = [_bm25_block(indexed, weights.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i), k, k1, b, float(mean or 1)) for i in range(blocks)]
    return rank(reduce(DataFrame.unionByName, parts), k)


def _bm25_block(indexed: DataFrame, weights: DataFrame, k: int, k1: float, b: float, mean: float) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in (*indexed.schema, *weights.schema)}
    import numpy as np
    import pyarrow as pa

    got = weights.orderBy("term", "query_id").toArrow()
    ids, query = np.unique(got["query_id"].to_numpy(), return_inverse=True)
    words = got["term"].combine_chunks()
    vocabulary = words.unique()
    first = np.append(np.flatnonzero(np.append(True, np.diff(words.dictionary_encode().indices.to_numpy()) != 0)) if len(words) else np.zeros(0, int), len(words))
    sent = indexed.sparkSession.sparkContext.broadcast((ids, vocabulary, first, query, got["weight"].to_numpy()))
    most = SCORES

    def run(batches):
        import pyarrow.compute as pc

        ids, vocabulary, first, query, weight = sent.value
        best, docs = np.full((len(ids), 0), 0.0), np.zeros((len(ids), 0), np.int64)
        step = max(1, most // max(1, len(ids)))
        for batch in batches:
            for at in range(0, batch.num_rows if len(ids) else 0, step):
                part = batch.slice(at, step)
                size = part.column(1).value_lengths().to_numpy()
                code = pc.fill_null(pc.index_in(part.column(1).flatten(), value_set=vocabulary), -1).to_numpy()
                doc = np.repeat(np.arange(len(size)), size)[code >= 0]
                key, tf = np.unique(doc * len(vocabulary) + code[code >= 0], return_counts=True)
                doc, code = key // len(vocabulary), key % len(vocabulary)
                share = tf * (k1 + 1) / (tf + k1 * (1 - b + b * np.maximum(size[doc], 1) / mean))
                n = first[code + 1] - first[code]
                row = np.repeat(first[code] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                score = np.bincount(query[row] * len(size) + np.repeat(doc, n), weight[row] * np.repeat(share, n), len(ids) * len(size)).reshape(len(ids), -1)
                score = np.hstack([best, score])
                known = np.hstack([docs, np.broadcast_to(part.column(0).to_numpy(), (len(ids), len(size)))])
                top = np.lexsort((known, -np.round(score, 9)), axis=-1)[:, :k]
                best, docs = np.take_along_axis(score, top, 1), np.take_along_axis(known, top, 1)
        q, j = np.nonzero(best > 0)
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(docs[q, j]), pa.array(best[q, j])], names=["query_id", "doc_id", "score"])

    return indexed.mapInArrow(run, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double")


def dense(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The best k of vectors(doc_id, v) for each of queries(query_id, q) by inner product in double precision.

    Queries go in blocks of at most BLOCK_BYTES, split by the hash of their id. A block is broadcast as a matrix, one scan
    of the vectors multiplies with it, a tile of queries and rows with at most CELLS scores at a time, and keeps k rows per
    query and task; only scores that reach a query's k-th best so far are sorted. The best k of all tasks stay; vectors are
    never shuffled. Null vectors, vectors that hold a null and those of another width than the widest query take no part.
    """
    ship(vectors.sparkSession)
    whole = lambda c: F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull())
    asked = queries.where(F.col("query_id").isNotNull() & whole("q")).select("query_id", F.col("q").cast("array<double>").alias("q"))
    n, width = asked.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    rows = vectors.where(F.col("doc_id").isNotNull() & whole("v") & (F.size("v") == width)).select("doc_id", F.col("v").cast("array<double>").alias("v"))
    blocks = max(1, -(-n * width * 8 // BLOCK_BYTES))
    asked = asked.where(F.size("q") == width)
    parts = [_dense_block(rows, asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b), k, width) for b in range(blocks)]
    return rank(reduce(DataFrame.unionByName, parts), k)


def _best(best, docs, score, fresh, k: int):
    """(scores, docs): for each query the k best of those held and of new ones; score has a column for each of fresh. NaN comes first, as Spark sorts it."""
    import numpy as np

    if best.shape[1] == k:
        limit = np.round(best[:, -1], 9)
        row, col = np.nonzero(~(score < (limit - 1e-9 - 1e-14 * np.abs(limit))[:, None]))
        new = np.round(score[row, col], 9)
        near = np.isnan(new) | (new > limit[row]) | ((new == limit[row]) & (fresh[col] < docs[row, -1]))
        row, col = row[near], col[near]
    else:
        row, col = np.nonzero(np.ones(score.shape, bool))
    if not len(row):
        return best, docs
    asked, held = np.unique(row), best.shape[1]
    query = np.concatenate([np.repeat(asked, held), row])
    s, d = np.concatenate([best[asked].ravel(), score[row, col]]), np.concatenate([docs[asked].ravel(), fresh[col]])
    order = np.lexsort((d, -np.round(s, 9), ~np.isnan(s), query))
    start = np.searchsorted(query[order], asked)
    top = order[np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order)))) < k]
    s, d = s[top].reshape(len(asked), -1), d[top].reshape(len(asked), -1)
    if len(asked) == len(best):
        return s, d
    best[asked], docs[asked] = s, d
    return best, docs


def _dense_block(rows: DataFrame, block: DataFrame, k: int, width: int) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in (*rows.schema, *block.schema)}
    got = block.toArrow()
    sent = rows.sparkSession.sparkContext.broadcast((got["query_id"].to_numpy(), got["q"].combine_chunks().flatten().to_numpy().reshape(len(got), width)))
    most, tile = CELLS, max(1, CELLS // max(256, 4 * k))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        ids, q = sent.value
        held, seen = {}, 0  # by first query: the best of a tile of queries
        for batch in batches:
            v, names = batch.column(1).flatten().to_numpy().reshape(len(batch), width), batch.column(0).to_numpy()
            for t in range(0, len(ids) if len(v) else 0, tile):
                asked, at = q[t : t + tile], 0
                best, docs = held.get(t) or (np.zeros((len(asked), 0)), np.zeros((len(asked), 0), names.dtype))
                while at < len(v):
                    step = min(most // len(asked), max(k, seen + at))  # few rows first: there is no limit yet that a score has to reach
                    best, docs = _best(best, docs, asked @ v[at : at + step].T, names[at : at + step], k)
                    at += step
                held[t] = best, docs
            seen += len(v)
        for t, (best, docs) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[t : t + tile], docs.shape[1])), pa.array(docs.ravel()), pa.array(best.ravel())], names=["query_id", "doc_id", "score"])

    return rows.mapInArrow(run, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double")


def fuse(k: int, constant: int = 60, *rankings: tuple[DataFrame, float]) -> DataFrame:
    """Reciprocal-rank fusion: the sum of weight / (constant + rank) over rankings of (query_id, doc_id, rank)."""
    parts = [df.select("query_id", "doc_id", (F.lit(float(w)) / (constant + F.col("rank"))).alias("part")) for df, w in rankings]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return rank(both.groupBy("query_id", "doc_id").agg(F.sum("part").alias("score")), k)


def recall(found: DataFrame, gold: DataFrame) -> DataFrame:
    """For each query of gold(query_id, doc_id) the share of its documents that found holds; repeats count once."""
    gold = gold.distinct()
    hit = gold.join(found.select("query_id", "doc_id", F.lit(1).alias("hit")).distinct(), ["query_id", "doc_id"], "left")
    return hit.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def class_recall(found: DataFrame, labels: DataFrame, queries: DataFrame) -> DataFrame:
    """For each of queries(query_id, label) the share of all labels(doc_id, label) with its label that found holds; by counts, not pairs."""
    size = labels.groupBy("label").agg(F.count_distinct("doc_id").alias("size"))
    hits = found.select("query_id", "doc_id").distinct().join(labels.distinct(), "doc_id").join(queries.withColumnRenamed("label", "own"), "query_id").where("label = own").groupBy("query_id").agg(F.count("*").alias("hits"))
    return queries.join(size, "label").join(hits, "query_id", "left").select("query_id", (F.coalesce("hits", F.lit(0)) / F.col("size")).alias("recall"))


# One sample's own documents, within its row ------------------------------------------------------------------------------

# What a search tool says.
BAD_CALL = '<information><format_error>Could not parse your tool call. Please use the correct format: <tool_call>{"name": "search", "arguments": {"query": "your search query"}}</tool_call></format_error></information>'
NO_QUERY = '<information><format_error>Invalid or empty query. Please retry using the correct format: <tool_call>{"name": "search", "arguments": {"query": "your search query"}}</tool_call></format_error></information>'


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def search_context(query: Column, title: Column, sentences: Column, k: int = 2, title_weight: int = 3, k1: float = 1.5, b: float = 0.75) -> Column:
    """Array of (score, title, sentences): the best k of a row's documents by BM25 over title (counted title_weight times) and text; none without a score."""
    body = lambda s: F.array_join(s, " ")
    docs = F.zip_with(title, sentences, lambda t, s: F.struct(t.alias("title"), s.alias("sentences"), F.concat(F.flatten(F.array_repeat(terms(t), title_weight)), terms(body(s))).alias("terms")))
    asked = F.array_distinct(terms(query))
    size = lambda d: F.greatest(F.size(d["terms"]), F.lit(1))

    def ranked(ds):
        mean = F.aggregate(ds, F.lit(0.0), lambda a, d: a + size(d)) / F.size(ds)

        def score(d, m):
            def add(a, w):
                tf = F.size(F.filter(d["terms"], lambda t: t == w))
                df = F.size(F.filter(ds, lambda o: F.array_contains(o["terms"], w)))
                return a + F.log(1 + (F.size(ds) - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size(d) / m))

            return F.aggregate(asked, F.lit(0.0), add)

        scored = _let(mean, lambda m: F.transform(ds, lambda d: F.struct((-F.round(score(d, m), 9)).alias("low"), F.lower(d["title"]).alias("by"), d["title"].alias("title"), d["sentences"].alias("sentences"), score(d, m).alias("score"))))
        best = F.filter(F.slice(F.array_sort(scored), 1, k), lambda d: d["low"] < 0)
        return F.transform(best, lambda d: F.struct(d["score"], d["title"].alias("title"), d["sentences"].alias("sentences")))

    return _let(docs, ranked)


def escaped(text: Column, quote: bool = True) -> Column:
    """Text for markup: & < > and, if asked, quotes as entities."""
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(F.replace(out, F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;")) if quote else out


def rendered(query: Column, found: Column, most: int = 2400) -> Column:
    """What the tool answers: of each found document its title and sentences, up to `most` characters of them."""

    def clipped(s):
        def add(a, x):
            part = F.left(x, F.greatest(F.lit(most) - a["n"], F.lit(0)))
            return F.struct((a["n"] + F.length(part)).alias("n"), F.when(a["n"] < most, F.concat(a["out"], F.array(escaped(part)))).otherwise(a["out"]).alias("out"))

        return F.aggregate(s, F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out")), add)["out"]

    one = lambda d: F.array_join(F.concat(F.array(F.concat(F.lit('<document title="'), escaped(d["title"]), F.lit('">'))), clipped(d["sentences"]), F.array(F.lit("</document>"))), "\n")
    asked = F.concat(F.lit("<query>"), escaped(query), F.lit("</query>"))
    none = F.concat(F.lit("<information>"), asked, F.lit("<no_results /></information>"))
    return F.when(F.size(found) == 0, none).otherwise(F.array_join(F.concat(F.array(F.lit("<information>"), asked), F.transform(found, one), F.array(F.lit("</information>"))), "\n"))


def answer_search(query: Column, title: Column, sentences: Column, parsed: Column | None = None, most_query: int = 70, **how) -> Column:
    """struct(text, results, titles, format_error) of a search call over a row's own documents."""
    asked = F.regexp_replace(F.coalesce(query, F.lit("")), r"(?U)\A\s+|\s+\z", "")
    long = F.concat(F.lit("<information><format_error>Query is too long ("), F.length(asked).cast("string"), F.lit(f" characters, maximum {most_query}). Please provide a concise, entity-focused search query.</format_error></information>"))
    error = F.when(~(parsed if parsed is not None else F.lit(True)), BAD_CALL).when(asked == "", NO_QUERY).when(F.length(asked) > most_query, long)
    found = F.when(error.isNull(), search_context(asked, title, sentences, **how))
    return _let(found, lambda f: F.struct(F.coalesce(error, rendered(asked, f)).alias("text"), F.coalesce(F.size(f), F.lit(0)).alias("results"), F.transform(f, lambda d: d["title"]).alias("titles"), error.isNotNull().alias("format_error")))


def title_recall(retrieved: Column, gold: Column) -> Column:
    """The share of distinct gold titles among the retrieved ones; titles are compared folded, with single blanks."""
    plain = lambda c: F.array_distinct(F.filter(F.transform(c, lambda t: F.trim(F.regexp_replace(F.lower(t), r"(?U)\s+", " "))), lambda t: t != ""))
    want = plain(F.coalesce(gold, F.array().cast("array<string>")))
    return F.when(F.size(want) > 0, F.size(F.array_intersect(want, plain(F.coalesce(retrieved, F.array().cast("array<string>"))))) / F.size(want)).otherwise(0.0)


def dedupe(df: DataFrame, key: Column, order: str, longest: str | None = None) -> DataFrame:
    """One row of each key: the first by `order`, or that with the longest text, then the first."""
    by = F.struct(*([-F.length(longest)] if longest else []), F.col(order))
    best = df.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*df.columns), by).alias("r"))
    return best.select("r.*")
