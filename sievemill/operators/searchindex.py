"""A persistent inverted index on Parquet, and the exact best k by BM25 from it.

Documents are dealt into shards by a hash of their id. A row of the index is the block of one term in one shard: the
documents, how much the term weighs in each (saturated count, without idf), and the greatest of these weights. The rows
lie in folders by a hash of their term, sorted by term and shard, so that a search opens the folders of its terms only, and
a term that very many documents hold is many rows over several files.

A search first reads terms, counts and greatest weights: their sums over a query's terms bound what any document of a shard
can score. The shards with the highest bounds are scored, which gives a lower limit for the k-th score, and then only
those others whose bound reaches it. Documents and weights of all other blocks are never used, and no row is made for a
pair of document and query: a shard's blocks meet its queries in one task, which keeps k rows for each.

doc_id has to be unique; rows without one are not indexed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship, work_dir
from .retrieval import STOP_WORDS, TOKEN, rank, terms

#: Scores that a task holds at once, queries that meet a shard at once, shards that a query is scored in first, documents whose words are counted at once.
SCORES, QUERIES, FIRST, PIECE = 1 << 20, 1 << 14, 2, 256
#: A full-text index's words: letters and digits of any script.
LETTERS = r"[\p{L}\p{N}]+"
_META = "n long, length double, k1 double, b double, shards long, buckets long, kind string"


def _tokens(text: Column, token: str, stop: bool) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(token), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(STOP_WORDS)) if stop else found


def build(docs: DataFrame, path: str, fields: dict[str, float], token: str = TOKEN, stop: bool = True, least: int = 1, k1: float = 1.5, b: float = 0.75, shard_docs: int = 4096, buckets: int = 64) -> None:
    """Index the fields of docs(doc_id, ...) under path; fields: column -> how much one of its words counts.

    A document is as long as it has words in all fields, but at least `least`. Texts are read and cut into words once.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    spark = docs.sparkSession
    ship(spark)
    rows = docs.where(F.col("doc_id").isNotNull())
    shards = max(1, -(-rows.count() // shard_docs))
    rows = rows.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"), *[_tokens(F.col(c), token, stop).alias(f"f{i}") for i, c in enumerate(fields)])
    counts, weights, piece = len(fields), list(fields.values()), PIECE
    kind = docs.schema["doc_id"].dataType.simpleString()

    def counted(part: pa.RecordBatch, before: int) -> tuple:
        """(ids, sizes, for each field its words, and word, document and weight of each pair of them) of some documents of a shard, `before` of which were counted."""
        size, pairs = 0, []
        for i in range(counts):
            column = part.column(2 + i)
            length = column.value_lengths().to_numpy(zero_copy_only=False)
            size = size + length
            coded = column.flatten().dictionary_encode()
            key, times = np.unique(coded.indices.to_numpy().astype(np.int64) * len(part) + np.repeat(np.arange(len(part)), length), return_counts=True)
            pairs.append((coded.dictionary, (key // len(part)).astype(np.int32), (key % len(part) + before).astype(np.int32), times * float(weights[i])))
        return part.column(0).take(pa.array(np.arange(len(part)))), np.maximum(size, least), pairs  # a copy, so that the batch can go

    def blocks(held: list[tuple], shard: int) -> pa.RecordBatch:
        ids, size, pairs = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]), [p for h in held for p in h[2]]
        n, cut = len(ids), np.cumsum([0] + [len(p[0]) for p in pairs])
        coded = pa.concat_arrays([p[0] for p in pairs]).dictionary_encode()
        of = coded.indices.to_numpy()
        key, tf = np.concatenate([of[c:][p[1]].astype(np.int64) * n + p[2] for c, p in zip(cut, pairs, strict=False)]), np.concatenate([p[3] for p in pairs])
        order = np.argsort(key, kind="stable")
        key, tf = key[order], tf[order]
        first = np.flatnonzero(np.append(True, np.diff(key) != 0)) if len(key) else np.zeros(0, np.int64)
        key, tf = key[first], np.add.reduceat(tf, first) if len(key) else tf  # a word may stand in several fields
        code, doc = key // n, key % n
        edge = np.append(np.flatnonzero(np.append(True, np.diff(code) != 0)), len(code)) if len(code) else np.zeros(1, np.int64)
        edges = pa.array(np.append(edge, edge[-1] + 1).astype(np.int32))  # the last row, without a term, has the shard's totals
        names = pc.take(coded.dictionary, pa.array(code[edge[:-1]])).cast(pa.string()) if len(code) else pa.array([], pa.string())
        lists = [pa.ListArray.from_arrays(edges, x) for x in (ids.take(pa.array(np.append(doc, 0))), pa.array(np.append(tf, float(n))), pa.array(np.append(size[doc], size.sum()).astype(np.int64)))]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([names, pa.array([None], pa.string())]), pa.array([shard] * len(edge), pa.int64()), *lists], names=["term", "shard", "docs", "tf", "len"])

    def run(batches):
        held, shard, n = [], None, 0
        for batch in batches:
            shard_of = batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard_of)) + 1).tolist(), len(shard_of)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if a == z:
                    continue
                if held and shard_of[a] != shard:
                    yield blocks(held, shard)
                    held, n = [], 0
                shard = int(shard_of[a])
                for at in range(a, z, piece):
                    held.append(counted(batch.slice(at, min(piece, z - at)), n))
                    n += len(held[-1][0])
        if held:
            yield blocks(held, shard)

    schema = f"term string, shard long, docs array<{kind}>, tf array<double>, len array<long>"
    raw = f"{path}/raw"
    rows.repartition("shard").sortWithinPartitions("shard", "doc_id").mapInArrow(run, schema).write.parquet(raw)
    made = spark.read.schema(schema).parquet(raw)
    n, length = made.where("term IS NULL").agg(F.coalesce(F.sum(F.col("tf")[0]), F.lit(0.0)), F.coalesce(F.sum(F.col("len")[0]), F.lit(0))).first()
    mean = length / n if n else 1.0
    share = F.zip_with("tf", "len", lambda t, size: t * (k1 + 1) / (t + k1 * (1 - b + b * size / F.lit(mean or 1.0))))
    out = made.where("term IS NOT NULL").select(F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("bucket"), "term", "shard", "docs", share.alias("share")).withColumn("top", F.array_max("share")).withColumn("n", F.size("docs").cast("long"))
    out.repartitionByRange("bucket", "term", "shard").sortWithinPartitions("bucket", "term", "shard").write.partitionBy("bucket").parquet(f"{path}/blocks")
    spark.createDataFrame([(int(n), float(length), k1, b, shards, buckets, kind)], _META).coalesce(1).write.parquet(f"{path}/meta")
    _delete(spark, raw)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def blocks_of(spark: SparkSession, path: str, asked: DataFrame) -> tuple[DataFrame, dict, int]:
    """(rows of the index in the folders that may hold terms of asked(query_id, term), its settings, number of queries); other folders are not opened."""
    meta = spark.read.schema(_META).parquet(f"{path}/meta").first().asDict()
    # As many numbers as there are folders, at most.
    held, queries = asked.agg(F.collect_set(F.pmod(F.xxhash64("term"), F.lit(meta["buckets"]))), F.count_distinct("query_id")).first()
    rows = spark.read.schema(f"term string, shard long, docs array<{meta['kind']}>, share array<double>, top double, n long, bucket int").parquet(f"{path}/blocks")
    return rows.where(F.col("bucket").isin(held)), meta, queries


def probability_idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def floored_idf(n: Column, df: Column) -> Column:
    """The odds of a document without the term; terms that half of all documents hold still count a little."""
    odds = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(odds <= 0, 1e-6).otherwise(odds)


def _written(df: DataFrame, name: str) -> DataFrame:
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, idf: Callable[[Column, Column], Column] = probability_idf, repeats: bool = True) -> DataFrame:
    """query_id, doc_id, score, rank: the best k documents of the index at path for each of queries(query_id, text).

    A word of a query counts as often as it stands there if `repeats`. Documents without a word of it have no row.
    """
    ship(spark)
    asked = queries.where("query_id IS NOT NULL").select("query_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    asked = _written(asked, "asked-terms")
    index, meta, n_queries = blocks_of(spark, path, asked)
    parts = max(1, -(-n_queries // QUERIES))
    heads = index.select("term", "shard", "n", "top").join(asked.select("term").distinct(), "term", "left_semi")
    found = heads.groupBy("term").agg(F.sum("n").alias("df"))
    times = F.col("times") if repeats else F.lit(1)
    weights = asked.join(found, "term").select("query_id", "term", (times * idf(F.lit(meta["n"]), F.col("df"))).alias("weight"))
    bounds = weights.join(heads, "term").groupBy("query_id", "shard").agg(F.sum(F.col("weight") * F.col("top")).alias("bound"), F.collect_list(F.struct("term", "weight")).alias("terms"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "shard"))
    bounds = _written(bounds.withColumn("place", place), "score-bounds")
    first = _written(_scored(index, bounds.where(F.col("place") <= FIRST), k, parts), "first-scores")
    limit = rank(first, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("limit"))
    rest = bounds.where(F.col("place") > FIRST).join(limit, "query_id", "left").where(F.col("limit").isNull() | (F.col("bound") >= F.col("limit") - 1e-8))
    return rank(first.unionByName(_scored(index, rest, k, parts)), k)


def _scored(index: DataFrame, wanted: DataFrame, k: int, parts: int) -> DataFrame:
    """query_id, doc_id, score: the best k of each shard for each of wanted(query_id, shard, terms)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    asked = wanted.select("shard", F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("part"), "query_id", F.explode("terms").alias("t")).select("shard", "part", "query_id", "t.term", "t.weight")
    needed = asked.select("term", "shard", "part").distinct()
    posts = index.select("term", "shard", "docs", "share").join(needed, ["term", "shard"]).select("term", F.col("shard").alias("s"), F.col("part").alias("p"), "docs", "share")
    kinds = {f.name: f.dataType.simpleString() for f in wanted.schema} | {"doc_id": index.schema["docs"].dataType.elementType.simpleString()}
    most = SCORES

    def run(posts: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["query_id", "doc_id", "score"]
        posts, asked = posts.combine_chunks(), asked.combine_chunks().sort_by("query_id")
        lists = posts["docs"].combine_chunks() if len(posts) else None
        if lists is None or not len(asked):
            return pa.table([asked["query_id"].slice(0, 0), posts["docs"].combine_chunks().flatten().slice(0, 0), pa.array([], pa.float64())], names=names)
        flat = lists.flatten()
        ids = pc.unique(flat).take(pc.sort_indices(pc.unique(flat)))
        doc, share = pc.index_in(flat, ids).to_numpy(), posts["share"].combine_chunks().flatten().to_numpy()
        size = lists.value_lengths().to_numpy()
        start = np.cumsum(size) - size
        code = pc.index_in(asked["term"], posts["term"].combine_chunks())
        known = code.is_valid()
        asked, code = asked.filter(known), code.filter(known).to_numpy()
        weight, query = asked["weight"].to_numpy(), asked["query_id"].combine_chunks()
        query = query.combine_chunks() if isinstance(query, pa.ChunkedArray) else query
        unique = query.unique()
        at = pc.index_in(query, unique).to_numpy()  # rising, as the rows are sorted by query
        step, out_q, out_d, out_s = max(1, most // len(ids)), [], [], []
        for lo in range(0, len(unique), step):
            hi = min(lo + step, len(unique))
            a, z = np.searchsorted(at, lo), np.searchsorted(at, hi)
            # Pairs of a query's word and a document that has it, a quarter of the scores at once.
            cuts = [a, *(a + 1 + np.flatnonzero(np.diff(np.cumsum(size[code[a:z]]) // max(1, most // 4)))).tolist(), z]
            score = np.zeros((hi - lo) * len(ids))
            for x, y in zip(cuts, cuts[1:], strict=False):
                n = size[code[x:y]]
                row = np.repeat(start[code[x:y]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                score += np.bincount(np.repeat((at[x:y] - lo) * len(ids), n) + doc[row], np.repeat(weight[x:y], n) * share[row], len(score))
            score = score.reshape(hi - lo, -1)
            top = np.argsort(-np.round(score, 9), axis=1, kind="stable")[:, :k]  # equal scores: the smaller id, which comes first
            best = np.take_along_axis(score, top, 1)
            q, j = np.nonzero(best > 0)
            out_q.append(q + lo)
            out_d.append(top[q, j])
            out_s.append(best[q, j])
        return pa.table([unique.take(pa.array(np.concatenate(out_q))), ids.take(pa.array(np.concatenate(out_d))), pa.array(np.concatenate(out_s))], names=names)

    return posts.groupBy("s", "p").cogroup(asked.groupBy("shard", "part")).applyInArrow(run, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double")


_built: dict[tuple, str] = {}


def index_of(docs: DataFrame, key: tuple, **how) -> str:
    """The path of an index of docs, which must read files; built once in an application for these files as they are now, and `how`."""
    spark = docs.sparkSession
    files = docs.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = files.agg(F.count("*"), F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)"))).first()
    name = (spark.sparkContext.applicationId, *key, *state)
    if name not in _built:
        path = work_dir(spark, "index")
        build(docs, path, **how)
        _built[name] = path
    return _built[name]
