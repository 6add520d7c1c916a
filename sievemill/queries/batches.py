"""Batch algebra over orders, numbered by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batch as B
from ..session import table
from .base import query

_BASE = "b AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx, o_orderkey AS k, o_custkey AS c, o_orderstatus AS s FROM orders), z AS (SELECT count(*) AS n FROM orders)"


def _orders(spark, sf_dir):
    return B.with_row_index(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("s")), "k")


def _q(name: str, body: str):
    return lambda f: query(name, f"WITH {_BASE} {body}")(lambda spark, sf_dir: f(_orders(spark, sf_dir)))


_q("batch_rows", "SELECT row_idx, k, c, s FROM b")(lambda b: b)
_q("batch_repeat", "SELECT row_idx * 3 + i AS row_idx, k FROM b, range(3) r(i)")(lambda b: B.repeat(b.select("row_idx", "k"), 3))
_q("batch_repeat_tiled", "SELECT row_idx + n * i AS row_idx, k FROM b, z, range(3) r(i)")(lambda b: B.repeat(b.select("row_idx", "k"), 3, interleave=False))
_q("sample_level_repeat", "SELECT row_idx, k, CAST(i AS INTEGER) AS copy FROM b, range(3) r(i) WHERE i < c % 4")(lambda b: B.repeat_each(b.withColumn("times", F.col("c") % 4), "times").select("row_idx", "k", "copy"))
_q("slice_step", "SELECT (row_idx - 5) // 7 AS row_idx, k FROM b, z WHERE row_idx >= 5 AND row_idx < n - 10 AND (row_idx - 5) % 7 = 0")(lambda b: B.slice_rows(b.select("row_idx", "k"), 5, -10, 7))
_q("gather", "SELECT c AS row_idx, b2.k, b2.s FROM (SELECT DISTINCT c, c * 3 % n AS at FROM b, z) p JOIN (SELECT row_idx, k, s FROM b) b2 ON b2.row_idx = p.at")(
    lambda b: B.gather(b.select("row_idx", "k", "s"), b.select("c").distinct().select(F.col("c").alias("pos"), (F.col("c") * 3 % b.count()).alias("row_idx")))
)
_q("chunk", "SELECT row_idx // (n // 10) AS chunk, count(*) AS n, min(k) AS low, max(k) AS high FROM b, z GROUP BY 1")(lambda b: B.chunk(b, 10).groupBy("chunk").agg(F.count("*").alias("n"), F.min("k").alias("low"), F.max("k").alias("high")))
_q("split", "SELECT row_idx, k, row_idx // 64 AS part FROM b")(lambda b: B.split(b.select("row_idx", "k"), 64))
_q("split_drop_remainder", "SELECT row_idx, k, row_idx // (n // 7) AS part FROM b, z WHERE row_idx < n // 7 * 7")(lambda b: B.split_equal(b.select("row_idx", "k"), 7))
_q("loader_drop_last", "SELECT row_idx, k, row_idx // 64 AS batch FROM b, z WHERE row_idx < n // 64 * 64")(lambda b: B.loader_batches(b.select("row_idx", "k"), 64, True))
_q("loader_keep_last", "SELECT row_idx, k, row_idx // 64 AS batch FROM b")(lambda b: B.loader_batches(b.select("row_idx", "k"), 64, False))
_q("minibatches", "SELECT row_idx, k, CAST(e AS INTEGER) AS epoch, row_idx // 50 AS batch FROM b, range(2) r(e)")(lambda b: B.minibatches(b.select("row_idx", "k"), 50, 2))
query("minibatches_shuffled")(lambda spark, sf_dir: B.minibatches(_orders(spark, sf_dir).select("row_idx", "k"), 50, 2, seed=1))
_q("pad_to_divisor", "SELECT row_idx, k, false AS is_pad FROM b UNION ALL SELECT n + row_idx, k, true FROM b, z WHERE row_idx < (64 - n % 64) % 64")(lambda b: B.pad_to_divisor(b.select("row_idx", "k"), 64))
_q("pad_unpad", "SELECT row_idx, k FROM b")(lambda b: B.unpad(B.pad_to_divisor(b.select("row_idx", "k"), 64)))
_q("pad_with_row", "SELECT row_idx, k FROM b UNION ALL SELECT n + i, k FROM b, z, range(5) r(i) WHERE row_idx = n - 1")(lambda b: B.pad_with_row(b.select("row_idx", "k"), 5, last=True))
_q("upsample", "SELECT row_idx, k, s, false AS is_padding FROM b UNION ALL SELECT n + i, -1, NULL, true FROM z, range(64) r(i) WHERE i < (64 - n % 64) % 64")(lambda b: B.upsample(b.select("row_idx", "k", "s"), 64, k=F.lit(-1)))
_q("horizontal_union", "SELECT row_idx, k, c, s FROM b")(lambda b: B.union_columns(b.select("row_idx", "k", "c"), b.select("row_idx", "k", "s")))
_q("vertical_concat", "SELECT row_idx, k FROM b UNION ALL SELECT n + row_idx, c FROM b, z")(lambda b: B.concat(b.select("row_idx", "k"), b.select("row_idx", F.col("c").alias("k"))))
_q("pop_rename", "SELECT row_idx, s AS status FROM b")(lambda b: B.rename(B.pop(b, "s")[0], ["s"], ["status"]))
_q("fold_unfold", "SELECT row_idx, k FROM b")(lambda b: B.unfold(B.fold(b.select("row_idx", "k"), 16), 16))
_q("unfold_columns", "SELECT row_idx * 2 + i AS row_idx, s, CASE WHEN i = 0 THEN k ELSE c END AS v FROM b, range(2) r(i)")(
    lambda b: B.unfold_chunks(b.select("row_idx", "s", F.array("k", "c").alias("v")), 2, "v").select("row_idx", "s", F.col("v")[0].alias("v"))
)
_q("transition_matrix", "SELECT count(*) FILTER (s <> 'F' AND c % 2 = 1) AS n_00, count(*) FILTER (s <> 'F' AND c % 2 = 0) AS n_01, count(*) FILTER (s = 'F' AND c % 2 = 1) AS n_10, count(*) FILTER (s = 'F' AND c % 2 = 0) AS n_11 FROM b")(
    lambda b: B.transition(b.select("row_idx", (F.col("s") == "F").alias("hit")), b.select("row_idx", (F.col("c") % 2 == 0).alias("hit")), "hit")
)
