"""Metrics over order lines as tokens and events as validation samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..plans.views import sequences, validation, with_sql
from ..session import table
from .base import query, r

_VAR = "(sum({0} * {0}) - sum({0}) * sum({0}) / count(*)) / (count(*) - 1)"
query(
    "data_metrics",
    with_sql(
        "tokens",
        body=f""", q AS (SELECT traj_id, sum(reward) AS score, sum(mask) AS n FROM tokens GROUP BY traj_id)
        , a AS (SELECT {r("avg(score)", "score_mean")}, {r("max(score)", "score_max")}, {r("min(score)", "score_min")}, {r("avg(n)", "length_mean")}, CAST(max(n) AS BIGINT) AS length_max, CAST(min(n) AS BIGINT) AS length_min,
          {r("avg(CASE WHEN n >= 6 THEN 1 ELSE 0 END)", "clip_ratio")}, {r("avg(CASE WHEN n = 0 THEN 1 ELSE 0 END)", "abort_ratio")} FROM q)
        , b AS (SELECT {", ".join(r(f"{f}({c})", f"{n}_{s}") for c, n in (("adv", "adv"), ("value", "value")) for f, s in (("avg", "mean"), ("max", "max"), ("min", "min")))},
          {r(f"1 - {_VAR.format('adv')} / ({_VAR.format('(adv + value)')} + 1e-5)", "explained_variance")} FROM tokens WHERE mask = 1)
        SELECT * FROM a, b""",
    ),
)(lambda s, d: (lambda df: df.withColumns({c: F.col(c).cast("long") for c in ("length_max", "length_min")}))(M.data_metrics(sequences(s, d), 6)))
query("reward_extra_metrics", f"SELECT event_type AS name, {r('avg(value)', 'mean')} FROM events WHERE event_id % 3 <> 0 GROUP BY 1")(
    lambda s, d: M.reward_extra_metrics(table(s, d, "events").select(F.col("event_type").alias("name"), F.when(F.col("event_id") % 3 == 0, F.when(F.col("event_id") % 2 == 0, "text").otherwise("NaN")).otherwise(F.col("value").cast("string")).alias("value")))
)
query("throughput_metrics", with_sql("tokens", body=f"SELECT count(*) AS tokens, CAST(2 AS DOUBLE) AS seconds, {r('count(*) / 16.0', 'tokens_per_device_second')} FROM tokens").replace("CAST(2 AS DOUBLE) AS seconds", r("2", "seconds")))(lambda s, d: M.throughput(sequences(s, d), 2, 8))
query("timing_metrics", with_sql("tokens", body=f"SELECT p AS phase, {r('sec', 'seconds')}, {r('sec * 1000.0 / CASE WHEN p = ' + chr(39) + 'gen' + chr(39) + ' THEN sum(mask) ELSE count(*) END', 'ms_per_token')} FROM tokens, (VALUES ('gen', 3), ('ref', 2), ('update', 7)) v(p, sec) GROUP BY p, sec"))(
    lambda s, d: M.timings(sequences(s, d), {"gen": 3, "ref": 2, "update": 7})
)
_P = "abs(exp(old_logp) - exp(rollout_logp))"
query("debug_probs_corr", with_sql("tokens", body=f"SELECT 1 AS valid, {r(f'max({_P})', 'diff_max')}, {r(f'avg({_P})', 'diff_mean')}, {r(f'stddev_samp({_P})', 'diff_std')}, {r('corr(exp(old_logp), exp(rollout_logp))', 'pearson')} FROM tokens WHERE mask = 1"))(lambda s, d: M.debug_probabilities(sequences(s, d)))
query(
    "variance_proxy",
    with_sql(
        "tokens",
        body=f""", q AS (SELECT sum(adv * mask) / (sum(mask) + 1e-8) AS a, sum((1 - 2 * exp(logp) + sum_pi_sq) * mask) AS w FROM tokens GROUP BY traj_id)
        , p AS (SELECT avg(a * a * greatest(w, 0)) AS power, avg(a * a) AS a2, avg(w) AS w, count(*) AS n FROM q)
        SELECT {r("0.0025", "signal")}, {r("power", "power")}, {r("greatest(0, (power - 0.0025) / (n - 1))", "noise")}, {r("a2", "a_squared")}, {r("w", "w")} FROM p""",
    ),
)(lambda s, d: M.variance_proxies(sequences(s, d), 0.05))
query("slow_ratio", f"WITH q AS (SELECT quantile_cont(value, 0.9) AS q FROM events) SELECT {r('avg(CASE WHEN value > q THEN 1 ELSE 0 END)', 'ratio')}, {r('min(value)', 'min')}, {r('max(value)', 'max')} FROM events, q")(lambda s, d: M.slow_ratio(table(s, d, "events"), "value", 0.1))
query("spec_decode_ratio", f"SELECT {r('avg(CASE WHEN user_id % 7 > 0 THEN value / (user_id % 7) ELSE 0 END)', 'accept_rate')} FROM events")(lambda s, d: table(s, d, "events").agg(M.mean_ratio(F.col("value"), F.col("user_id") % 7).alias("accept_rate")))
_NAMED = "(SELECT CASE event_id % 4 WHEN 0 THEN 'time_max' WHEN 1 THEN 'minmax_diff' WHEN 2 THEN 'mini_batch' ELSE 'loss' END AS name, value FROM events)"
query("metric_reduce_by_name", f"SELECT name, {r('CASE WHEN name LIKE ' + chr(39) + '%max%' + chr(39) + ' THEN max(value) WHEN name LIKE ' + chr(39) + '%min%' + chr(39) + ' THEN min(value) ELSE avg(value) END', 'value')} FROM {_NAMED} GROUP BY name")(
    lambda s, d: M.reduce_by_name(table(s, d, "events").select(F.element_at(F.array(*map(F.lit, ("time_max", "minmax_diff", "mini_batch", "loss"))), (F.col("event_id") % 4 + 1).cast("int")).alias("name"), "value"))
)
query("metric_window_agg", f"SELECT event_id // 100 AS step, event_type AS name, {r('avg(value)', 'mean')}, {r('max(value)', 'high')}, {r('sum(value)', 'total')} FROM events GROUP BY 1, 2")(
    lambda s, d: table(s, d, "events").groupBy(F.expr("event_id div 100").alias("step"), F.col("event_type").alias("name")).agg(F.avg("value").alias("mean"), F.max("value").alias("high"), F.sum("value").alias("total"))
)
query("latency_percentiles", "SELECT event_type AS name, " + ", ".join(r(f"quantile_cont(value, {q})", f"p{int(q * 100)}") for q in (0.5, 0.95, 0.99)) + " FROM events GROUP BY 1")(
    lambda s, d: table(s, d, "events").groupBy(F.col("event_type").alias("name")).agg(*[F.percentile("value", F.lit(q)).alias(f"p{int(q * 100)}") for q in (0.5, 0.95, 0.99)])
)


def _samples(s, d):
    return validation(s, d).select("source", "uid", "n", (F.col("value") > 50).alias("ok"), (F.col("pred") % 2 == 0).alias("strat"))


_KS = "(VALUES (1), (2), (4), (8)) v(k)"
_FIRST = ", f AS (SELECT source, uid, count(*) AS c, min(CASE WHEN value > 50 THEN n END) AS hit, min(CASE WHEN pred % 2 = 0 THEN n END) AS strat, min(CASE WHEN value > 50 AND pred % 2 = 0 THEN n END) AS joint FROM val GROUP BY 1, 2)"
_RATES = ", ".join(r(f"avg(CASE WHEN {h} <= k THEN 1 ELSE 0 END)", h) for h in ("hit", "strat", "joint"))


def _pass(by=None, full=None):
    return lambda s, d: M.pass_at_k(_samples(s, d), [1, 2, 4, 8], ["source", "uid"], by, full, hit=F.col("ok"), strat=F.col("strat"), joint=F.col("ok") & F.col("strat"))


query("pass_at_k", with_sql("val", body=_FIRST + f" SELECT CAST(k AS INTEGER) AS k, count(*) AS groups, {_RATES} FROM f, {_KS} GROUP BY k"))(_pass())
query("pass_at_k_by_source", with_sql("val", body=_FIRST + f" SELECT source, CAST(k AS INTEGER) AS k, count(*) AS groups, {_RATES} FROM f, {_KS} GROUP BY source, k"))(_pass("source"))
query("pass_at_k_full_groups", with_sql("val", body=_FIRST + f" SELECT CAST(k AS INTEGER) AS k, count(*) AS groups, {_RATES} FROM f, {_KS} WHERE c = 13 GROUP BY k"))(_pass(None, 13))
query(
    "val_majority",
    with_sql(
        "val",
        body=f""", v AS (SELECT source, uid, pred, count(*) AS votes, min(n) AS o FROM val GROUP BY 1, 2, 3)
        , b AS (SELECT *, row_number() OVER (PARTITION BY source, uid ORDER BY votes DESC, o) AS rk FROM v)
        SELECT b.source, b.uid, b.pred, b.votes, {r("val.value", "value")} FROM b JOIN val ON b.source = val.source AND b.uid = val.uid AND b.o = val.n WHERE rk = 1""",
    ),
)(lambda s, d: M.majority(validation(s, d), ["source", "uid"], "pred", "value"))
query(
    "val_mean_std",
    with_sql(
        "val",
        body=f""", g AS (SELECT source, uid, count(*) AS c, avg(value) AS m, stddev_pop(value) AS d FROM val GROUP BY 1, 2)
        , u AS (SELECT source, 'mean@' || c AS metric, m AS x FROM g UNION ALL SELECT source, 'std@' || c, d FROM g WHERE c > 1)
        SELECT source, metric, {r("avg(x)", "value")} FROM u GROUP BY 1, 2""",
    ),
)(lambda s, d: M.validation_metrics(validation(s, d), ["source", "uid"], draws=1).where(F.col("metric").rlike("^(mean|std)@")))
query("val_bootstrap")(lambda s, d: M.validation_metrics(validation(s, d), ["source", "uid"], vote="pred"))
query(
    "grouped_report",
    with_sql("val", body=f"SELECT source, count(*) AS n, {r('avg(value)', 'mean')}, {r('avg(CASE WHEN value > 50 THEN 1 ELSE 0 END)', 'hit_rate')}, {r('avg(CASE WHEN value > 50 AND pred % 2 = 0 THEN 1 ELSE 0 END)', 'joint')} FROM val GROUP BY GROUPING SETS ((source), ())"),
)(lambda s, d: validation(s, d).rollup("source").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.avg((F.col("value") > 50).cast("int")).alias("hit_rate"), F.avg(((F.col("value") > 50) & (F.col("pred") % 2 == 0)).cast("int")).alias("joint")))
