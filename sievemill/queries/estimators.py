"""Advantage estimators over orders as trajectories of their customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grouped as G
from ..plans.views import tokens, trajectories, with_sql
from .base import query, r

_STATS = ", s AS (SELECT *, count(*) OVER g AS n, avg(score) OVER g AS m, stddev_samp(score) OVER g AS d FROM traj WINDOW g AS (PARTITION BY uid))"


def _sql(expr: str, ctes: str = _STATS, source: str = "s") -> str:
    return with_sql("traj", body=f"{ctes} SELECT uid, traj_id, {r(expr, 'advantage')} FROM {source}")


def _of(f, **options):
    return lambda spark, sf_dir: f(trajectories(spark, sf_dir), **options).select("uid", "traj_id", "advantage")


_GRPO = "CASE WHEN n = 1 THEN score / (1 + 1e-6) ELSE (score - m) / (d + 1e-6) END"
query("grpo_adv", _sql(_GRPO))(_of(G.grpo))
query("grpo_mean_only", _sql("CASE WHEN n = 1 THEN score ELSE score - m END"))(_of(G.grpo, by_std=False))
query("rloo_loop", _sql("CASE WHEN n = 1 THEN score ELSE n / (n - 1.0) * (score - m) END"))(_of(G.rloo))
query("rloo_vec", _sql("CASE WHEN n = 1 THEN 0 ELSE n / (n - 1.0) * (score - m) END"))(_of(G.rloo_vectorized))
query("opo_adv", _sql("score - CASE WHEN n = 1 THEN 0 ELSE b END", _STATS + ", o AS (SELECT *, sum(score * len) OVER g / sum(len) OVER g AS b FROM s WINDOW g AS (PARTITION BY uid))", "o"))(_of(G.opo))
query("gpg_adv", _sql("a * (score - CASE WHEN n = 1 THEN 0 ELSE m END)", _STATS + ", z AS (SELECT count(*) / CAST(greatest(count(*) FILTER (score <> 0), 1) AS DOUBLE) AS a FROM traj)", "s, z"))(_of(G.gpg))
query("passk_adv", _sql("CASE WHEN k = 1 AND n > 1 THEN (score - nx) / (d + 1e-6) ELSE 0 END", _STATS + ", o AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS nx FROM s WINDOW w AS (PARTITION BY uid ORDER BY score DESC, traj_id))", "o"))(_of(G.grpo_passk, strict=False))
_WHITEN = """
    , t1 AS (SELECT sum(x * len) / (sum(len) + 1e-8) AS mu, sum(len) AS n FROM c)
    , t2 AS (SELECT sum((x - mu) * (x - mu) * len) / (n + 1e-8) * n / (n - 1) AS var FROM c, t1 GROUP BY n)"""
query("rfpp_baseline_adv", _sql("(x - mu) / sqrt(var + 1e-8)", _STATS + ", c AS (SELECT *, score - CASE WHEN n = 1 THEN 0 ELSE m END AS x FROM s)" + _WHITEN, "c, t1, t2").replace("count(*) OVER g AS n,", "count(*) OVER g AS gn,").replace("WHEN n = 1 THEN 0 ELSE m", "WHEN gn = 1 THEN 0 ELSE m"))(_of(G.reinforce_pp_baseline))
query(
    "gdpo_adv",
    with_sql(
        "traj",
        body=f"""
        , s AS (SELECT *, count(*) OVER g AS gn, avg(score) OVER g AS m1, stddev_samp(score) OVER g AS d1, avg(score2) OVER g AS m2, stddev_samp(score2) OVER g AS d2 FROM traj WINDOW g AS (PARTITION BY uid))
        , c AS (SELECT *, CASE WHEN gn = 1 THEN (score + score2) / (1 + 1e-6) ELSE (score - m1) / (d1 + 1e-6) + (score2 - m2) / (d2 + 1e-6) END AS x FROM s)
        {_WHITEN} SELECT uid, traj_id, {r("(x - mu) / sqrt(var + 1e-8)", "advantage")} FROM c, t1, t2""",
    ),
)(_of(G.gdpo))
query(
    "session_final_broadcast",
    with_sql(
        "traj",
        body=f"""
        , f AS (SELECT * FROM traj QUALIFY row_number() OVER (PARTITION BY uid, session ORDER BY traj_id DESC) = 1)
        , s AS (SELECT *, count(*) OVER g AS n, avg(score) OVER g AS m, stddev_samp(score) OVER g AS d FROM f WINDOW g AS (PARTITION BY uid))
        SELECT traj.uid, traj.traj_id, {r(_GRPO.replace("score", "s.score"), "advantage")} FROM traj JOIN s USING (uid, session)""",
    ),
)(_of(G.session_final))
query("group_mean_std", with_sql("traj", body=f"SELECT uid, CAST(count(*) AS BIGINT) AS n, {r('CASE WHEN count(*) = 1 THEN 0 ELSE avg(score) END', 'mean')}, {r('CASE WHEN count(*) = 1 THEN 1 ELSE stddev_samp(score) END', 'std')} FROM traj GROUP BY uid"))(
    lambda spark, sf_dir: G.group_mean_std(trajectories(spark, sf_dir)).groupBy("uid").agg(F.first("group_n").alias("n"), F.first("group_mean").alias("mean"), F.first("group_std").alias("std"))
)
query("filter_groups_without_spread", with_sql("traj", body="SELECT uid, traj_id FROM traj WHERE uid IN (SELECT uid FROM traj GROUP BY uid HAVING stddev_samp(score) > 0.3)"))(
    lambda spark, sf_dir: (lambda t: t.join(t.groupBy("uid").agg(F.stddev_samp("score").alias("d")).where("d > 0.3"), "uid", "left_semi").select("uid", "traj_id"))(trajectories(spark, sf_dir))
)


@query("pf_ppo_resample")
def pf_ppo_resample(spark, sf_dir):
    return G.resample_by_weight(trajectories(spark, sf_dir)).select("draw", "uid", "traj_id", "score")


_RETURNS = """, rt AS (SELECT *, sum(reward * mask) OVER (PARTITION BY traj_id ORDER BY t DESC) AS ret, sum((1 - 2 * exp(old_logp) + sum_pi_sq) * mask) OVER (PARTITION BY traj_id ORDER BY t) AS w,
        {step} AS step FROM tokens)
    , base AS (SELECT uid, step, sum(ret * w) / (sum(w) + 1e-8) AS b FROM rt WHERE mask = 1 GROUP BY 1, 2)
    , sizes AS (SELECT uid, traj_id, sum(mask) AS len, row_number() OVER (PARTITION BY uid ORDER BY sum(mask) DESC, traj_id DESC) AS k, count(*) OVER (PARTITION BY uid) AS n FROM tokens GROUP BY uid, traj_id {having})
    , top AS (SELECT uid, max(n) AS n, max(CASE WHEN k = 1 THEN traj_id END) AS first, max(CASE WHEN k = 1 THEN len END) AS l1, max(CASE WHEN k = 2 THEN len END) AS l2 FROM sizes GROUP BY uid)
    SELECT rt.uid, rt.traj_id, rt.t, {adv}, {ret} FROM rt LEFT JOIN base USING (uid, step) LEFT JOIN top USING (uid)"""
_OTB = r("(ret - CASE WHEN coalesce(n, 1) = 1 OR (traj_id = first AND l1 > l2 AND step > l2) THEN 0 ELSE coalesce(b, 0) END) * mask", "advantage")
query("otb_adv", with_sql("tokens", body=_RETURNS.format(step="t", having="", adv=_OTB, ret=r("ret", "ret"))))(lambda spark, sf_dir: G.optimal_token_baseline(tokens(spark, sf_dir)).select("uid", "traj_id", "t", "advantage", "ret"))
query("tir_otb_adv", with_sql("tokens", body=_RETURNS.format(step="sum(mask) OVER (PARTITION BY traj_id ORDER BY t)", having="HAVING sum(mask) > 0", adv=_OTB, ret=r("ret", "ret"))))(
    lambda spark, sf_dir: G.optimal_token_baseline(tokens(spark, sf_dir), compact=True).select("uid", "traj_id", "t", "advantage", "ret")
)
query("remax_returns", with_sql("tokens", body=f", rt AS (SELECT *, sum(reward * mask) OVER (PARTITION BY traj_id ORDER BY t DESC) AS ret FROM tokens) SELECT traj_id, t, {r('ret', 'ret')}, {r('(ret - value) * mask', 'advantage')} FROM rt"))(
    lambda spark, sf_dir: G.remax(tokens(spark, sf_dir), F.col("value")).select("traj_id", "t", "ret", "advantage")
)
