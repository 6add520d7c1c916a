"""Stateful stream operators over events, each run over all that the table holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import work_dir
from ..streaming import event_time, runner, state
from .base import query

_K = "CAST(json_extract(props, '$.k') AS BIGINT)"
_STATUS = f"CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' AND {_K} < 3 THEN 'running' ELSE 'success' END"


def _events(s, d):
    return runner.stream_table(s, f"{d}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def _run(s, name, out):
    return runner.run_to_table(out, work_dir(s, name))


def _queue(s, d, take):
    out = state.bounded_queue(_events(s, d), F.col("user_id"), F.col("event_id"), F.col("event_id"), take, 10)
    return state.queue_statistics(_run(s, "queue", out))


query("stream_count_window", "WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS c FROM events) SELECT user_id AS key, i // 8 AS window, i % 8 AS place, event_id AS item FROM e WHERE i < c - c % 8")(
    lambda s, d: _run(s, "windows", state.count_windows(_events(s, d), F.col("user_id"), F.col("event_id"), F.col("event_id"), 8))
)
query("stream_drop_oldest", "SELECT user_id AS key, count(*) AS produced, CAST(0 AS BIGINT) AS consumed, greatest(count(*) - 10, 0) AS dropped, least(count(*), 10) AS size FROM events GROUP BY 1")(lambda s, d: _queue(s, d, F.lit(False)))
query("stream_queue")(lambda s, d: _queue(s, d, F.col("event_type").isin("purchase", "view")))
query("stream_staleness", f"SELECT event_type AS key, count(*) AS n, count(*) FILTER (WHERE {_K} < 50) AS stale FROM events GROUP BY 1")(
    lambda s, d: runner.run_to_state(state.stale_counts(_events(s, d), F.col("event_type"), F.col("k"), 50), work_dir(s, "staleness"))
)
query("stream_step_barrier", f"WITH e AS (SELECT user_id, {_K} AS k, {_STATUS} AS status, row_number() OVER (PARTITION BY user_id, {_K} ORDER BY event_id DESC) AS r FROM events), l AS (SELECT * FROM e WHERE r = 1) SELECT user_id AS key, k AS item FROM l WHERE status = 'success' AND user_id NOT IN (SELECT user_id FROM l WHERE status = 'running')")(
    lambda s, d: _run(s, "barrier", state.step_barrier(_events(s, d), F.col("user_id"), F.col("k"), F.col("event_id"), F.when(F.col("event_type") == "error", "failed").when((F.col("event_type") == "signup") & (F.col("k") < 3), "running").otherwise("success")))
)


def _timed(s, d):
    return runner.stream_table(s, f"{d}/events.parquet").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))


query("stream_sliding_counts", """WITH b AS (SELECT event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events)
    SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM b GROUP BY 1, 2 HAVING max(start) + INTERVAL 2 HOUR <= (SELECT max(ts) - INTERVAL 30 MINUTE FROM events)""")(
    lambda s, d: _run(s, "sliding", event_time.closed_windows(_timed(s, d), "ts", "30 minutes", "2 hours", "1 hour", ["event_type"], n=F.count("*"))).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")
)
query("stream_sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM g GROUP BY user_id, g HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 30 MINUTE FROM events)""")(
    lambda s, d: _run(s, "sessions", event_time.closed_sessions(_timed(s, d), "ts", "30 minutes", "6 hours", ["user_id"], n=F.count("*"))).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
)
query("stream_interval_join", "SELECT p.event_id AS purchase, v.event_id AS view FROM events p JOIN events v ON p.user_id = v.user_id AND v.ts >= p.ts - INTERVAL 12 HOUR AND v.ts <= p.ts WHERE p.event_type = 'purchase' AND v.event_type = 'view'")(
    lambda s, d: _run(s, "interval", event_time.within(_timed(s, d).where("event_type = 'purchase'"), _timed(s, d).where("event_type = 'view'"), "user_id", "ts", "30 minutes", "12 hours").select(F.col("event_id").alias("purchase"), F.col("right_event_id").alias("view")))
)
