"""Domain views over the driver's tables, each as a DataFrame and as SQL for the comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table

_LINE_ORDER = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]

SQL = {
    "traj": """traj AS (
        SELECT o_custkey AS uid, o_orderkey AS traj_id, o_orderpriority AS session,
               sum(l_extendedprice * (1 - l_discount)) / 1e5 AS score, sum(l_quantity) / 10 AS score2, CAST(sum(l_quantity) AS BIGINT) AS len
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3)""",
    "tokens": f"""tokens AS (
        SELECT o_custkey AS uid, o_orderkey AS traj_id,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_LINE_ORDER)}) AS t,
               CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END AS mask, l_extendedprice / 1e5 AS reward, l_tax AS value,
               -(0.05 + l_discount) AS old_logp, -(0.05 + l_tax) AS logp, -(0.05 + (l_discount + l_tax) / 2) AS rollout_logp,
               l_quantity / 100 AS sum_pi_sq, l_extendedprice / 1e5 - 0.4 AS adv
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey)""",
    "val": """val AS (
        SELECT event_type AS source, user_id AS uid, value, CAST(json_extract(props, '$.k') AS BIGINT) AS pred,
               row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS n, event_id, ts FROM events)""",
}


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, traj_id, session, score, score2, len: an order as a trajectory of its customer's prompt."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 1e5).alias("score"), (F.sum("l_quantity") / 10).alias("score2"), F.sum("l_quantity").cast("long").alias("len"))
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey).select(F.col("o_custkey").alias("uid"), F.col("o_orderkey").alias("traj_id"), F.col("o_orderpriority").alias("session"), "score", "score2", "len")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each order line as a token of its trajectory, numbered from 1."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("uid"))
    place = Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER)
    lines = table(spark, sf_dir, "lineitem").withColumn("t", F.row_number().over(place))
    c = F.col
    return orders.join(lines, c("o_orderkey") == c("l_orderkey")).select(
        "uid", c("l_orderkey").alias("traj_id"), c("t").cast("long").alias("t"), F.when(c("l_returnflag") != "N", 1).otherwise(0).alias("mask"), (c("l_extendedprice") / 1e5).alias("reward"), c("l_tax").alias("value"),
        (-(0.05 + c("l_discount"))).alias("old_logp"), (-(0.05 + c("l_tax"))).alias("logp"), (-(0.05 + (c("l_discount") + c("l_tax")) / 2)).alias("rollout_logp"), (c("l_quantity") / 100).alias("sum_pi_sq"), (c("l_extendedprice") / 1e5 - 0.4).alias("adv"),
    )


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, traj_id, tok: the tokens of a trajectory as an array of structs, in order; the form that token operators take."""
    names = ["t", "mask", "reward", "value", "old_logp", "logp", "rollout_logp", "sum_pi_sq", "adv"]
    return tokens(spark, sf_dir).groupBy("uid", "traj_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("tok"))


def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, uid, value, pred, n: events as validation samples, numbered from 1 within (source, uid)."""
    place = Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("user_id").alias("uid"), "value", F.get_json_object("props", "$.k").cast("long").alias("pred"), F.row_number().over(place).cast("long").alias("n"), "event_id", "ts")


def with_sql(*names: str, body: str) -> str:
    """body after the named views, and after CTEs of its own if it starts with a comma."""
    return "WITH " + ", ".join(SQL[n] for n in names) + (" " if body.lstrip().startswith(",") else " ") + body
