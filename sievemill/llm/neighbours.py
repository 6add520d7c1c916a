"""Approximate nearest neighbours by multi-index hashing.

Vectors become codes of up to BITS bits: the principal axes of a bounded sample, turned by a rotation that is learned
so that signs lose least. A code is split into m substrings of about log2(rows) bits, each with an index from its values
to rows. Codes within radius r of a query agree with it in at least one substring to within r // m bits (pigeonhole), so
probing every index with all values that near finds them all; their floats are then ranked by cosine in double precision.

1. Probe: the index is a table of (substring, value, code, row), and a query's values with up to one bit flipped meet it by an
   equality join on (substring, value); floats are read for the rows that are found within the radius. A query is done once its
   k-th nearest is so near that a nearer row would have lain within that radius (see Coder.reach). Buckets of over BUCKET
   rows are left out, and queries that probe one are not done.
2. Blocks: for all other queries the radius grows further, up to the one that the sample's own nearest pairs need. By then a
   ball has more values than the index has keys, so the index is held by blocks of vectors, each with its substring
   tables from values to lists of rows, and each pair of a block of queries and one of vectors yields at most k rows a query.
   Rings of values are looked up step by step while a ring is smaller than the table has keys; then one pass over the
   block's codes, 8 bytes a row, finds what is left within the radius.
3. Queries that still have fewer than k neighbours are searched in all blocks without a radius.

How much the index spares depends on the data. Near copies end with the probe; for vectors in no clusters, whose nearest
differ in about four of ten bits, a fifth of all rows lies within the radius and must be scored.

Bounds: rotation and radius come from at most SAMPLE vectors (those with the least hash of their id); every vector is indexed.
Defined results: vectors that are null, zero, hold null or non-finite components, have no id, or are not of the
commonest length take no part; a repeated vec_id counts once, with the least of its vectors; copies are all found, ties
go to the smaller id; an empty table or a single vector gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import combinations
from math import acos, asin, comb, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

BITS, SAMPLE, BLOCK, QUERY_BLOCK, REACH = 64, 4096, 8192, 2048, 0.985
#: Rows of a (substring, value) up to which the probe takes it; and queries that a block searches at once.
BUCKET, AT_ONCE = 4096, 64


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Coder:
    """Rotated binary codes, learned from rows of unit vectors; n: rows that will be indexed."""

    def __init__(self, x: np.ndarray, k: int, n: int):
        rng = np.random.default_rng(11)
        self.mean = x.mean(0)
        z = x - self.mean
        self.bits = min(BITS, x.shape[1])
        _, axes = np.linalg.eigh(z.T @ z)
        v = z @ axes[:, ::-1][:, : self.bits]
        r = np.linalg.qr(rng.standard_normal((self.bits, self.bits)))[0]
        for _ in range(30):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        self.turn = axes[:, ::-1][:, : self.bits] @ r
        m = min(self.bits, max(2, round(self.bits / max(8.0, log2(max(2, n))))))
        self.parts = [(int(p[0]), len(p)) for p in np.array_split(np.arange(self.bits), m)]
        self.spread = max(1e-6, float(np.quantile(np.sqrt((z * z).sum(1)), 0.05)))
        # The radius that holds the share REACH of the sample's own nearest pairs; denser data have nearer ones.
        q = x[:512]
        s = q @ x.T
        s[np.arange(len(q)), np.arange(len(q))] = -2
        codes = self.code(x)
        near = np.argpartition(-s, max(min(k, len(x) - 1) - 1, 0), axis=1)[:, : min(k, len(x) - 1)]
        self.radius = int(np.quantile(np.bitwise_count(codes[: len(q), None] ^ codes[near]), REACH, method="higher"))
        # Least cosine whose pairs lie within each radius; never rising with it.
        grid = np.linspace(1, -1, 401)
        need = np.array([self._needed(c) for c in grid])
        self.reach = np.array([grid[need <= b].min(initial=2.0) for b in range(self.bits + 1)])

    def _needed(self, cosine: float) -> int:
        """The radius that holds the share REACH of pairs with this cosine: bits differ with the angle, seen from the mean, over pi."""
        p = 2 * asin(min(1.0, sqrt(max(0.0, (1 - cosine) / 2)) / self.spread)) / pi if self.spread < 1 else acos(max(-1.0, min(1.0, cosine))) / pi
        below = 0.0
        for b in range(self.bits + 1):
            below += comb(self.bits, b) * p**b * (1 - p) ** (self.bits - b)
            if below >= REACH:
                return b
        return self.bits

    def code(self, x: np.ndarray) -> np.ndarray:
        bits = (x - self.mean) @ self.turn >= 0
        return (bits.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def substring(self, codes: np.ndarray, part: int) -> np.ndarray:
        at, width = self.parts[part]
        return (codes >> np.uint64(at)) & np.uint64((1 << width) - 1)


def ring(width: int, flips: int) -> np.ndarray:
    """All values of `width` bits with `flips` of them set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), flips)], np.uint64)


class Index:
    """Substring tables over a block of unit vectors: values, and the rows of each."""

    def __init__(self, ids: np.ndarray, unit_vectors: np.ndarray, coder: Coder):
        self.ids, self.unit, self.coder = ids, unit_vectors, coder
        self.codes = coder.code(unit_vectors)
        self.tables = []
        for part in range(len(coder.parts)):
            values = coder.substring(self.codes, part)
            rows = np.argsort(values, kind="stable")
            keys, first = np.unique(values[rows], return_index=True)
            self.tables.append((keys, np.append(first, len(rows)), rows))

    def bucket(self, part: int, own: np.ndarray, flips: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) pairs whose substrings differ in exactly `flips` bits."""
        keys, first, rows = self.tables[part]
        values = own[:, None] ^ ring(self.coder.parts[part][1], flips)[None, :]
        slot = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
        q, at = np.nonzero(keys[slot] == values)
        key = slot[q, at]
        n = first[key + 1] - first[key]
        return np.repeat(q, n), rows[np.repeat(first[key] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]

    def probed(self, codes: np.ndarray, flips: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) pairs within the radius whose nearest substrings differ in `flips` bits."""
        found = []
        for part in range(len(self.tables)):
            i, j = self.bucket(part, self.coder.substring(codes, part), flips)
            apart = codes[i] ^ self.codes[j]
            # A row counts where its nearest substring (the first of several) is probed.
            new = np.bitwise_count(apart) <= radius
            for other in range(len(self.tables)):
                if other != part:
                    new &= np.bitwise_count(self.coder.substring(apart, other)) >= flips + (other < part)
            found.append((i[new], j[new]))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        return i, j

    def passed(self, codes: np.ndarray, flips: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) pairs within the radius whose nearest substrings differ in `flips` bits or more."""
        i, j = np.nonzero(np.bitwise_count(codes[:, None] ^ self.codes[None, :]) <= radius)
        apart = codes[i] ^ self.codes[j]
        new = np.ones(len(i), bool)
        for part in range(len(self.tables)):
            new &= np.bitwise_count(self.coder.substring(apart, part)) >= flips
        return i[new], j[new]

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, radius: int | None):
        """(query_id, vec_id, score) of up to k rows for each query, within the radius; and how many floats were read."""
        out, scored = [], 0
        parts = len(self.tables)
        for a in range(0, len(ids), AT_ONCE):
            qid, qu = ids[a : a + AT_ONCE], queries[a : a + AT_ONCE]
            codes = self.coder.code(qu)
            live = np.arange(len(qid))
            held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            last_step = -1 if radius is None else radius // parts
            for flips in range(max(0, last_step) + 1):
                few = all(comb(width, flips) < len(keys) for (_, width), (keys, _, _) in zip(self.coder.parts, self.tables, strict=True))
                if radius is None:
                    i, j = (x.ravel() for x in np.indices((len(qid), len(self.ids))))
                else:
                    i, j = self.probed(codes[live], flips, radius) if few else self.passed(codes[live], flips, radius)
                    i = live[i]
                own = qid[i] != self.ids[j]
                i, j = i[own], j[own]
                scored += len(i)
                held = [np.concatenate(x) for x in zip(held, (i, j, (qu[i] * self.unit[j]).sum(1)), strict=True)]
                by = np.lexsort((self.ids[held[1]], -held[2], held[0]))
                by = by[np.arange(len(by)) - np.searchsorted(held[0][by], held[0][by]) < k]
                held = [x[by] for x in held]
                if radius is None or not few:
                    break
                # Done are queries whose k-th nearest is so near that all nearer rows are within what has been probed.
                full = np.bincount(held[0], minlength=len(qid)) >= k
                last = np.searchsorted(held[0], np.arange(len(qid)), "right") - 1
                if len(held[0]):
                    certain = full & (held[2][np.maximum(last, 0)] >= self.coder.reach[min(self.coder.bits, parts * flips + parts - 1)])
                    live = live[~certain[live]]
                if not len(live):
                    break
            out.append((qid[held[0]], self.ids[held[1]], held[2]))
        return [np.concatenate(c) for c in zip(*out, strict=True)], scored


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): the vectors that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    fit = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(fit)
    width = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    rows = rows.where(F.size("v") == (width["w"] if width else 0))
    twice = common.written(rows.groupBy("vec_id").count().where("count > 1").select("vec_id"), "repeated-ids")
    if twice.isEmpty():
        return rows
    return rows.join(twice, "vec_id", "left_anti").unionByName(rows.join(twice, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v")))


def coded(rows: DataFrame, coder: Coder) -> DataFrame:
    """(vec_id, code, u): rows with their codes, and their vectors at length one."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                u = unit(batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1))
                edges = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * u.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(coder.code(u).view(np.int64)), pa.ListArray.from_arrays(edges, pa.array(u.ravel()))], names=["vec_id", "code", "u"])

    return common.written(rows.select("vec_id", "v").mapInArrow(run, "vec_id long, code long, u array<double>"), "codes")


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """(block, ids, x): matrices of up to `size` vectors."""

    def run(batches):
        ids, xs, n, no = [], [], 0, 0

        def flush():
            nonlocal ids, xs, n, no
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([(TaskContext.get().partitionId() << 32) + no]), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.concatenate(xs).tobytes()], pa.binary())], names=["block", "ids", "x"])
                ids, xs, n, no = [], [], 0, no + 1

        for batch in batches:
            for a in range(0, batch.num_rows, size):
                b = batch.slice(a, size)
                if n + b.num_rows > size:
                    yield from flush()
                ids.append(b.column(0).to_numpy())
                xs.append(b.column(1).flatten().to_numpy())
                n += b.num_rows
        yield from flush()

    return rows.mapInArrow(run, "block long, ids binary, x binary")


def _substring(code, at: int, width: int):
    return F.shiftrightunsigned(code, at).bitwiseAND((1 << width) - 1) if width < 64 else code


def probe(table: DataFrame, queries: DataFrame, coder: Coder, k: int, flips: int = 1) -> DataFrame:
    """(query_id, vec_id, score, rank) for the queries that the index itself answers, `flips` bits around each substring.

    table, queries: rows of coded(). Candidates are rows within the radius that so many flips cover.
    """
    m = len(coder.parts)
    radius = m * flips + m - 1
    code = F.col("code")
    posts = table.select("vec_id", "code", F.posexplode(F.array(*[_substring(code, *p) for p in coder.parts])).alias("part", "value"))
    sizes = posts.groupBy("part", "value").count()
    heavy = common.written(sizes.where(F.col("count") > BUCKET).select("part", "value"), "heavy-buckets")
    ball = lambda p: F.array(*[_substring(code, *p).bitwiseXOR(F.lit(int(x))) for f in range(flips + 1) for x in ring(p[1], f)])
    balls = F.array(*[ball(p) for p in coder.parts])
    probes = queries.select(F.col("vec_id").alias("query_id"), F.col("code").alias("q_code"), F.posexplode(balls).alias("part", "ball")).select("query_id", "q_code", "part", F.explode("ball").alias("value"))
    light = posts if heavy.isEmpty() else posts.join(heavy, ["part", "value"], "left_anti")
    apart = code.bitwiseXOR(F.col("q_code"))
    first = F.array_position(F.array(*[F.bit_count(_substring(apart, *p)) <= flips for p in coder.parts]), True) - 1
    hits = probes.join(light, ["part", "value"]).where((F.bit_count(apart) <= radius) & (F.col("vec_id") != F.col("query_id")) & (F.col("part") == first)).select("query_id", "vec_id")
    floats = hits.join(table.select("vec_id", "u"), "vec_id").join(queries.select(F.col("vec_id").alias("query_id"), F.col("u").alias("q_u")), "query_id")
    score = F.aggregate(F.zip_with("u", "q_u", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = common.written(floats.select("query_id", "vec_id", score.alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "probed")
    done = ranked.where((F.col("rank") == k) & (F.col("score") >= float(coder.reach[min(coder.bits, radius)]))).select("query_id")
    if not heavy.isEmpty():
        done = done.join(probes.join(heavy, ["part", "value"], "left_semi").select("query_id").distinct(), "query_id", "left_anti")
    return common.written(ranked.join(done, "query_id", "left_semi"), "answered")


def nearest(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The k nearest of every vector whose id `every` divides, by cosine: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    common.prepare(spark)
    rows = usable(vectors)
    out_schema = "query_id long, vec_id long, score double"
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    if sample.num_rows < 2:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    coder = Coder(unit(sample["v"].combine_chunks().flatten().to_numpy().reshape(sample.num_rows, -1)), k, rows.count())
    table = coded(rows, coder)
    queries = table.where(F.col("vec_id") % every == 0)
    answered = probe(table, queries, coder, k)
    data = common.written(blocks(table.select("vec_id", "u"), BLOCK), "vector-blocks")
    stripes = min(1024, data.count())

    def found(left: DataFrame, radius: int | None) -> DataFrame:
        q = blocks(left.select("vec_id", "u"), QUERY_BLOCK).select(F.col("ids").alias("q_ids"), F.col("x").alias("q_x"), F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"))
        d = data.withColumn("stripe", F.pmod(F.xxhash64("block"), F.lit(stripes)).cast("int"))
        pairs = d.hint("shuffle_merge").join(q, "stripe").select("block", "ids", "x", "q_ids", "q_x")

        def run(batches):
            last, index = None, None
            for batch in batches:
                for block, *raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    ids, x, q_ids, q_x = (np.frombuffer(r, t) for r, t in zip(raw, (np.int64, float) * 2, strict=True))
                    if block != last:
                        last, index = block, Index(ids, x.reshape(len(ids), -1), coder)
                    got, _ = index.search(q_ids, q_x.reshape(len(q_ids), -1), k, radius)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], names=["query_id", "vec_id", "score"])

        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = pairs.mapInArrow(run, out_schema).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return common.written(ranked, "nearest")

    for radius in (coder.radius, None):
        left = queries.join(answered.select(F.col("query_id").alias("vec_id")).distinct(), "vec_id", "left_anti")
        if left.isEmpty():
            break
        near = found(left, radius)
        whole = near if radius is None else near.join(near.groupBy("query_id").count().where(F.col("count") >= k).select("query_id"), "query_id", "left_semi")
        answered = answered.unionByName(whole.select(answered.columns))
    return answered.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
