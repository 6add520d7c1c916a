"""Balancing plans, batch by batch: a customer's orders by their nation-sized batches, and rows dealt to workers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import balancing as A
from ..operators import batch as B
from ..plans.views import trajectories, with_sql
from ..session import table
from .base import query, r

_BATCH = "b AS (SELECT traj_id, uid, len, uid % 5 AS batch FROM traj), z AS (SELECT batch, count(*) AS n, sum(len) AS tokens, count(DISTINCT uid) AS users FROM b GROUP BY batch)"


def _batches(s, d):
    return trajectories(s, d).select("traj_id", "uid", "len", (F.col("uid") % 5).alias("batch"))


def _summary(df, planned, *extra):
    """What SQL can say of a plan: rows, tokens and parts of each batch, and whether each row has a place of its own."""
    joined = planned.join(df.select("traj_id", "len", "uid"), "traj_id")
    return joined.groupBy("batch").agg(F.count(F.lit(1)).alias("rows"), F.sum("len").alias("tokens"), F.countDistinct("part").alias("parts"), (F.countDistinct("part", "place") == F.count(F.lit(1))).alias("apart"), *extra)


query("token_budget_batches", with_sql("traj", body=f", {_BATCH} SELECT batch, n AS rows, CAST(tokens AS BIGINT) AS tokens, CAST(ceil(ceil(tokens / 2000.0) / 2) * 2 AS BIGINT) AS parts, true AS apart FROM z"))(
    lambda s, d: _summary(df := _batches(s, d), A.micro_batch_plan(df, "batch", "traj_id", "len", 2000, divisor=2))
)
query("rank_balance", with_sql("traj", body=f", {_BATCH} SELECT batch, n // 4 * 4 AS rows, CAST(4 AS BIGINT) AS parts, n // 4 AS most FROM z"))(
    lambda s, d: A.rank_plan(A.trimmed(_batches(s, d), "batch", "traj_id", 4), "batch", "traj_id", "len", 4).groupBy("batch", "part").count().groupBy("batch").agg(F.sum("count").alias("rows"), F.countDistinct("part").alias("parts"), F.max("count").alias("most"))
)
query("group_balanced", with_sql("traj", body=f", {_BATCH}, u AS (SELECT batch, uid, row_number() OVER (PARTITION BY batch ORDER BY uid) AS k FROM (SELECT DISTINCT batch, uid FROM b)), t AS (SELECT u.* FROM u JOIN z USING (batch) WHERE k <= users // 3 * 3) SELECT batch, count(*) AS users, CAST(3 AS BIGINT) AS parts, count(*) // 3 AS most FROM t GROUP BY batch"))(
    lambda s, d: (
        (df := _batches(s, d)).join(A.group_plan(df, "batch", "uid", "len", 3), ["batch", "uid"]).groupBy("batch", "uid").agg(F.min("part").alias("part"), F.countDistinct("part").alias("split"))
        .where("split = 1").groupBy("batch", "part").count().groupBy("batch").agg(F.sum("count").alias("users"), F.count(F.lit(1)).alias("parts"), F.max("count").alias("most"))
    )
)


query(
    "seqlen_unbalance",
    with_sql("traj", body=f", {_BATCH}, i AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY traj_id) - 1 AS i FROM b), c AS (SELECT i.batch, i.i // (z.n // 4) AS c, sum(len) AS s FROM i JOIN z USING (batch) GROUP BY 1, 2), q AS (SELECT batch, min(s) AS lo, max(s) AS hi FROM c GROUP BY batch) SELECT batch, CAST(lo AS BIGINT) AS min, CAST(hi AS BIGINT) AS max, CAST(hi - lo AS BIGINT) AS minmax_diff, {r('tokens / 4', 'mean')}, true AS better FROM q JOIN z USING (batch)"),
)(
    lambda s, d: A.unbalance(
        A.numbered((df := _batches(s, d)).join(A.spread(df, "batch", "traj_id", A.cost_column(F.col("len")), 4), ["batch", "traj_id"]), "batch", "traj_id"), "batch", "len", 4
    ).select("batch", "min", "max", "minmax_diff", "mean", (F.col("balanced_max") - F.col("balanced_min") <= F.col("minmax_diff")).alias("better"))
)


query("permutation_inverse", with_sql("traj", body="SELECT uid, array_to_string(list(n ORDER BY k), ',') AS back FROM (SELECT uid, row_number() OVER (PARTITION BY uid ORDER BY len DESC, traj_id) - 1 AS n, row_number() OVER (PARTITION BY uid ORDER BY traj_id) - 1 AS k FROM traj) GROUP BY uid"))(
    lambda s, d: trajectories(s, d).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct(F.col("traj_id").alias("t"), F.col("len").alias("l")))).alias("a"))
    .withColumn("o", F.transform(F.array_sort(F.transform("a", lambda x, i: F.struct((-x["l"]).alias("l"), x["t"].alias("t"), i.alias("i")))), lambda x: x["i"]))
    .select("uid", F.array_join(F.transform(A.inverse(F.col("o")), lambda x: x.cast("string")), ",").alias("back"))
)
query("round_up", "SELECT o_orderkey, CAST(ceil(o_custkey / 8.0) AS BIGINT) AS parts, CAST(ceil(o_custkey / 8.0) * 8 AS BIGINT) AS rounded FROM orders")(lambda s, d: table(s, d, "orders").select("o_orderkey", A.ceil_div(F.col("o_custkey"), 8).alias("parts"), A.round_up(F.col("o_custkey"), 8).alias("rounded")))

_ORDERS = "o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_orderkey AS k FROM orders), z AS (SELECT count(*) AS n, CAST(ceil(count(*) / 7.0) AS BIGINT) AS size FROM orders)"


def _orders(s, d):
    df = B.with_row_index(table(s, d, "orders").select(F.col("o_orderkey").alias("k")), "k")
    return df, df.count()


query("dispatch_all", "SELECT r_regionkey, CAST(w AS INTEGER) AS worker FROM region, range(3) t(w)")(lambda s, d: A.to_all(table(s, d, "region").select("r_regionkey"), 3))
query("dispatch_ranks", f"WITH {_ORDERS}, p AS (SELECT i, k FROM o UNION ALL SELECT i + n, k FROM o, z WHERE i < size * 7 - n) SELECT i AS row_idx, k, CAST(i // size AS INTEGER) AS rank FROM p, z")(lambda s, d: A.to_ranks(*_orders(s, d), 7))
query("dispatch_mesh_collect", f"WITH {_ORDERS} SELECT i AS row_idx, k, CAST(i // size AS INTEGER) AS rank FROM o, z")(
    lambda s, d: A.from_mesh(A.to_mesh(A.to_ranks(*(x := _orders(s, d)), 7), [w // 2 for w in range(14)]), [w % 2 == 1 for w in range(14)], x[1])
)
