"""Rollout correction by named settings, combined losses, and responses cut from whole sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import correction as C
from ..operators import ragged as R
from ..operators import tokens as T
from ..plans.views import sequences, with_sql
from .base import query, r

#: Tighter than the settings' own, so that the tables' tokens are on both sides.
BOUNDS = {"seq_sum_k1": "0.95_1.1", "seq_mean_k1": "0.98_1.02", "seq_mean_k3": 0.0003}
WEIGHT = {"token": 1.01, "sequence": 1.05}


def _how(name: str) -> C.Correction:
    how = C.preset(name)
    changes = {"reject_threshold": BOUNDS[how.reject]} if how.reject else {}
    if how.weights:
        changes["threshold"] = "0.99_1.01" if "icepop" in name else WEIGHT[how.weights]
    return C.preset(name, **changes)


def _sql(how: C.Correction, new: str, old: str) -> str:
    """CTEs w (a row for each token: traj_id, mask, keep, weight) of a correction of the log ratio new - old."""
    lr = f"greatest(least({new} - {old}, 20), -20)"
    keep = "1"
    if how.reject:
        level, _, k = how.reject.rpartition("_")
        low, high = T.parse_bounds(how.reject_threshold, k == "k1")
        x = {"k1": "-l", "k3": "(exp(l) - 1 - l)"}[k]
        s = f"sum({x} * mask) OVER g" + ("" if level == "seq_sum" else " / (sum(mask) OVER g + 1e-8)")
        keep = f"CASE WHEN {s} " + (f"BETWEEN ln({low!r}) AND ln({high!r})" if k == "k1" else f"<= {high!r}") + " THEN 1 ELSE 0 END"
    weight = "1.0"
    if how.weights:
        low, high = T.parse_is_threshold(how.threshold)
        raw = "exp(l)" if how.weights == "token" else "exp(greatest(least(sum(d * mask) OVER g, 20), -20))"
        weight = f"mask * (CASE WHEN {raw} BETWEEN {low} AND {high} THEN {raw} ELSE 0 END)" if low else f"least({raw} * mask, {high})"
    return f", s AS (SELECT *, {lr} AS l, {new} - {old} AS d FROM tokens), w AS (SELECT *, {keep} AS keep, {weight} AS weight FROM s WINDOW g AS (PARTITION BY traj_id))"


for _name in C.PRESETS:
    _h = _how(_name)
    query(f"correction_{_name}", with_sql("tokens", body=_sql(_h, "old_logp", "rollout_logp") + f" SELECT traj_id, CAST(sum(mask * keep) AS DOUBLE) AS kept, {r('sum(weight * mask)', 'weight')} FROM w GROUP BY traj_id"))(
        lambda s, d, h=_h: C.correct(sequences(s, d), h).select("traj_id", T.valid("tok").alias("kept"), T.total("tok", lambda x: (x["weight"] if h.weights else F.lit(1.0)) * x["mask_before"]).alias("weight"))
    )

_RATIO = "exp(greatest(least(logp - rollout_logp, 20), -20))"
_UP = f"greatest(-adv * {_RATIO}, -adv * greatest(least({_RATIO}, 1.2), 0.8))"
for _name in ("bypass_ppo_clip", "bypass_ppo_clip_geo_rs", "bypass_ppo_clip_k3_rs", "bypass_pg_is", "bypass_pg_token_icepop", "bypass_pg_geo_rs", "bypass_pg_geo_rs_seq_tis", "bypass_pg_geo_rs_token_tis"):
    _h = _how(_name)
    _body = f"CASE WHEN adv < 0 THEN least(-adv * 3, {_UP}) ELSE {_UP} END" if _h.loss == "ppo_clip" else "-adv * logp * weight"
    query(f"{_name}_loss", with_sql("tokens", body=_sql(_h, "logp", "rollout_logp") + f" SELECT {r(f'sum(({_body}) * mask * keep) / sum(mask * keep)', 'loss')} FROM w"))(lambda s, d, h=_h: C.bypass_loss(sequences(s, d), h).select("loss"))

_PPO = "exp(greatest(least(logp - old_logp, 20), -20))"
_PG = f"greatest(-adv * {_PPO}, -adv * greatest(least({_PPO}, 1.2), 0.8))"
_PG = f"(CASE WHEN adv < 0 THEN least(-adv * 3, {_PG}) ELSE {_PG} END)"
_KL = "(exp(rollout_logp - logp) - (rollout_logp - logp) - 1)"
_m = lambda x: f"sum({x} * mask) / sum(mask)"
_ENT = _m("sum_pi_sq")
query("entropy_loss", with_sql("tokens", body=f"SELECT {r(_ENT, 'loss')} FROM tokens"))(lambda s, d: C.entropy_loss(sequences(s, d), lambda x: x["sum_pi_sq"]))
query("policy_loss_combined", with_sql("tokens", body=f"SELECT {r(_m(_PG), 'pg_loss')}, {r(_ENT, 'entropy_loss')}, {r(_m(_KL), 'kl_loss')}, {r(f'{_m(_PG)} - 0.01 * {_ENT} + 0.1 * {_m(_KL)}', 'loss')} FROM tokens"))(
    lambda s, d: C.policy_loss(sequences(s, d), entropy=lambda x: x["sum_pi_sq"], entropy_coef=0.01, kl_coef=0.1).select("pg_loss", "entropy_loss", "kl_loss", "loss")
)
query("correction_metrics", with_sql("tokens", body=_sql(C.Correction(None), "old_logp", "rollout_logp") + f""", q AS (SELECT traj_id, sum(old_logp * mask) / (sum(mask) + 1e-8) AS t, sum(rollout_logp * mask) / (sum(mask) + 1e-8) AS o, sum((rollout_logp - old_logp) * mask) AS kl, sum(mask) AS m FROM tokens GROUP BY traj_id)
    SELECT {r('sum(kl) / (sum(m) + 1e-8)', '"rollout_corr/kl"')}, {r('avg(exp(-t))', '"rollout_corr/training_ppl"')}, {r('max(o - t)', '"rollout_corr/log_ppl_diff_max"')} FROM q"""))(
    lambda s, d: C.correction_metrics(sequences(s, d), C.Correction(None)).select("`rollout_corr/kl`", "`rollout_corr/training_ppl`", "`rollout_corr/log_ppl_diff_max`")
)

# Sequences of a prompt (the first two tokens or fewer) and a response; a list's text names the tokens' numbers.
_PARTS = ", q AS (SELECT traj_id, list(t ORDER BY t) AS ts, greatest(len(ts) - 2, 0) AS n FROM tokens GROUP BY traj_id)"
_text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("long").cast("string")), ",")


def _parts(s, d):
    return sequences(s, d).select("traj_id", F.transform("tok", lambda x: x["t"].cast("double")).alias("ts")).withColumn("n", F.greatest(F.size("ts") - 2, F.lit(0)))


query("response_outputs", with_sql("tokens", body=_PARTS + " SELECT traj_id, array_to_string(ts[len(ts) - n : len(ts) - 1], ',') AS ts FROM q WHERE len(ts) > n + 1"))(lambda s, d: _parts(s, d).where(F.size("ts") > F.col("n") + 1).select("traj_id", _text(R.response_outputs(F.col("ts"), F.col("n"))).alias("ts")))
query("padded_responses", with_sql("tokens", body=_PARTS + " SELECT traj_id, array_to_string(list_concat(ts[len(ts) - n : len(ts) - 1], [0 FOR x IN range(9 - n)]), ',') AS ts FROM q WHERE len(ts) > n + 1"))(
    lambda s, d: _parts(s, d).where(F.size("ts") > F.col("n") + 1).select("traj_id", _text(R.padded_responses(F.col("ts"), F.col("n"), 9)).alias("ts"))
)
query("trimmed_responses", with_sql("tokens", body=_PARTS + " SELECT traj_id, array_to_string(ts[1 : n], ',') AS ts FROM q"))(lambda s, d: _parts(s, d).select("traj_id", _text(R.trimmed(T.pad(F.col("ts"), 20, F.lit(0.0)), F.col("n"))).alias("ts")))
query("attention_mask", with_sql("tokens", body=_PARTS + " SELECT traj_id, array_to_string([CASE WHEN i <= len(ts) THEN 1 ELSE 0 END FOR i IN range(1, 11)], ',') AS mask FROM q"))(lambda s, d: _parts(s, d).select("traj_id", _text(R.attention_mask(F.col("ts"), 10)).alias("mask")))
query("response_mask", with_sql("tokens", body=" SELECT traj_id, array_to_string(list(mask ORDER BY t)[-3:], ',') AS mask FROM tokens GROUP BY traj_id"))(lambda s, d: sequences(s, d).select("traj_id", _text(R.response_mask(F.transform("tok", lambda x: x["mask"]), F.lit(3))).alias("mask")))
query("shared_prefixes", "SELECT o_custkey AS uid, arg_min(o_orderstatus, o_orderkey) AS prompt, array_to_string(list(o_orderpriority ORDER BY o_orderkey), ',') AS responses, CAST(count(*) AS INTEGER) AS size FROM orders GROUP BY o_custkey")(
    lambda s, d: R.shared_prefixes(s.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("uid"), "o_orderkey", F.col("o_orderstatus").alias("prompt"), F.col("o_orderpriority").alias("responses")), "uid", "prompt", "responses", "o_orderkey").withColumn("responses", F.array_join("responses", ","))
)
