"""Joins by time and stored sketches over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sketches as K
from ..operators import timejoin
from ..session import table, work_dir
from .base import query, r


def _events(s, d, kind):
    return table(s, d, "events").where(F.col("event_type") == kind).select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")


query("as_of_join", f"""SELECT p.event_id, v.event_id AS view, {r("p.value - v.value", "gain")} FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")(
    lambda s, d: timejoin.as_of(_events(s, d, "purchase"), _events(s, d, "view"), "user_id", "ts", "event_id", 6 * 3600).select("event_id", F.col("match.event_id").alias("view"), (F.col("value") - F.col("match.value")).alias("gain"))
)
query("interval_join", """SELECT e.event_id AS error, c.event_id AS click FROM events e JOIN events c ON e.user_id = c.user_id AND c.ts BETWEEN e.ts - INTERVAL 5 HOUR AND e.ts + INTERVAL 90 MINUTE
    WHERE e.event_type = 'error' AND c.event_type = 'click'""")(
    lambda s, d: timejoin.within(_events(s, d, "error"), _events(s, d, "click"), "user_id", "ts", 5 * 3600, 5400, 4 * 3600).select(F.col("left.event_id").alias("error"), F.col("right.event_id").alias("click"))
)

_SHARES = (0.5, 0.95, 0.99)


def _sketched(s, d):
    """Sketches of each thousand events, stored, then merged by type; each estimate is held against its exact rank in the table."""
    events, path = table(s, d, "events"), work_dir(s, "sketches")
    K.sketches(events.withColumn("step", F.expr("event_id div 1000")), ["event_type", "step"], F.col("value"), F.col("user_id")).write.parquet(path)
    whole = K.merged(s.read.parquet(path), ["event_type"])
    named = whole.select(F.col("event_type").alias("name"), "n", K.quantile(0.0).alias("low"), K.quantile(1.0).alias("high"), K.distinct().alias("_d"), *[K.quantile(q).alias(f"_{k}") for k, q in enumerate(_SHARES)])
    exact = events.join(named, events.event_type == named.name).groupBy("name", "n", "low", "high", "_d").agg(
        F.count_distinct("user_id").alias("_u"), *[F.struct(F.avg((F.col("value") < F.col(f"_{k}")).cast("int")).alias("below"), F.avg((F.col("value") <= F.col(f"_{k}")).cast("int")).alias("upto")).alias(f"_{k}") for k in range(3)]
    )
    fits = [(F.col(f"_{k}.below") <= q + 2 * K.RANK_ERROR) & (F.col(f"_{k}.upto") >= q - 2 * K.RANK_ERROR) for k, q in enumerate(_SHARES)]
    named_fits = [c.alias(f"p{int(q * 100)}") for c, q in zip(fits, _SHARES, strict=True)]
    return exact.select("name", "n", "low", "high", *named_fits, (F.abs(F.col("_d") / F.col("_u") - 1) <= 3 * K.DISTINCT_ERROR).alias("users"))


query("merged_sketches", f"SELECT event_type AS name, count(value) AS n, {r('min(value)', 'low')}, {r('max(value)', 'high')}, true AS p50, true AS p95, true AS p99, true AS users FROM events WHERE event_type IS NOT NULL GROUP BY 1")(_sketched)
