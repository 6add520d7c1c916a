"""Token-array operators over order lines as tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tokens as T
from ..plans.views import sequences, with_sql
from ..session import table
from .base import query, r

_SEQ = sequences
_K = "greatest(least(logp - old_logp, 20), -20)"
_R = f"exp({_K})"
_C = f"greatest(least({_R}, 1.2), 0.8)"


def _mean(expr: str, name: str) -> str:
    return r(f"sum(({expr}) * mask) / (sum(mask) + 1e-8)", name)


def _loss(expr: str, *means: str, mode: str = "token-mean") -> str:
    """SQL of a loss over long tokens."""
    extra = (", " + ", ".join(means)) if means else ""
    if mode == "token-mean":
        return with_sql("tokens", body=f"SELECT {r(f'sum(({expr}) * mask) / sum(mask)', 'loss')}{extra} FROM tokens")
    seq = "s" if mode == "seq-mean-token-sum" else "s / (m + 1e-8)"
    sums = f", q AS (SELECT traj_id, sum(({expr}) * mask) AS s, sum(mask) AS m FROM tokens GROUP BY traj_id), l AS (SELECT {r(f'sum({seq}) FILTER (m > 0) / count(*) FILTER (m > 0)', 'loss')} FROM q)"
    tail = f", e AS (SELECT {', '.join(means)} FROM tokens) SELECT * FROM l, e" if means else " SELECT * FROM l"
    return with_sql("tokens", body=sums + tail)


_UP = f"greatest(-adv * {_R}, -adv * {_C})"
query("ppo_loss", _loss(f"CASE WHEN adv < 0 THEN least(-adv * 3, {_UP}) ELSE {_UP} END", _mean(f"CASE WHEN -adv * {_C} > -adv * {_R} THEN 1 ELSE 0 END", "clipfrac"), _mean(f"-{_K}", "ppo_kl"), _mean(f"CASE WHEN {_UP} > -adv * 3 AND adv < 0 THEN 1 ELSE 0 END", "clipfrac_lower")))(lambda s, d: T.ppo(_SEQ(s, d)))
query("ppo_loss_weighted", _loss(f"(CASE WHEN adv < 0 THEN least(-adv * 3, {_UP}) ELSE {_UP} END) * (value + 1)", mode="seq-mean-token-mean"))(
    lambda s, d: T.ppo(_SEQ(s, d).withColumn("tok", F.transform("tok", lambda x: x.withField("w", x["value"] + 1))), mode="seq-mean-token-mean", weight="w").select("loss")
)
for _name, _f, _keep in (
    ("dppo_tv", T.dppo_tv, lambda pos: "exp(logp) - exp(old_logp) <= 0.02" if pos else "exp(logp) - exp(old_logp) >= -0.02"),
    ("dppo_kl", T.dppo_kl, lambda pos: f"exp(old_logp) * (old_logp - logp) + (1 - exp(old_logp)) * ln((1 - exp(old_logp) + 1e-8) / (1 - exp(logp) + 1e-8)) <= 0.005 OR exp(logp) {'<=' if pos else '>='} exp(old_logp)"),
):
    _bound = 0.02 if _name == "dppo_tv" else 0.005
    _gate = f"(CASE WHEN (CASE WHEN adv > 0 THEN {_keep(True)} ELSE {_keep(False)} END) THEN 1 ELSE 0 END)"
    query(_name, _loss(f"-adv * least({_R}, 20) * logp * {_gate}", _mean(f"1 - {_gate}", "clipfrac"), _mean(f"-{_K}", "ppo_kl")))(lambda s, d, f=_f, b=_bound: f(_SEQ(s, d), low=b, high=b).select("loss", "clipfrac", "ppo_kl"))
query(
    "gspo_loss",
    with_sql(
        "tokens",
        body=f"""
        , k AS (SELECT *, exp(least(sum((logp - old_logp) * mask) OVER g / greatest(sum(mask) OVER g, 1), 10)) AS sr FROM tokens WINDOW g AS (PARTITION BY traj_id))
        , q AS (SELECT traj_id, sum(mask) AS m, sum(greatest(-adv * sr, -adv * greatest(least(sr, 1.2), 0.8)) * mask) AS s FROM k GROUP BY traj_id)
        , l AS (SELECT {r("sum(s / (m + 1e-8)) FILTER (m > 0) / count(*) FILTER (m > 0)", "loss")} FROM q)
        , e AS (SELECT {_mean("old_logp - logp", "ppo_kl")} FROM tokens) SELECT * FROM l, e""",
    ),
)(lambda s, d: T.gspo(_SEQ(s, d)).select("loss", "ppo_kl"))
_TAU = "(CASE WHEN adv > 0 THEN 1.0 ELSE 1.05 END)"
query("sapo_loss", _loss(f"-(4.0 / {_TAU} / (1 + exp(-{_TAU} * ({_R} - 1)))) * adv", _mean(f"-{_K}", "ppo_kl"), mode="seq-mean-token-mean"))(lambda s, d: T.sapo(_SEQ(s, d)))
query("gpg_loss", _loss("-logp * adv"))(lambda s, d: T.gpg_loss(_SEQ(s, d)))
query("cispo_loss", _loss(f"-{_C} * adv * logp", _mean(f"CASE WHEN {_R} <> {_C} THEN 1 ELSE 0 END", "clipfrac"), _mean(f"-{_K}", "ppo_kl")))(lambda s, d: T.cispo(_SEQ(s, d)))
query("reinforce_loss", _loss("-adv * logp", _mean("rollout_logp - logp", "ppo_kl"), mode="seq-mean-token-sum"))(lambda s, d: T.reinforce(_SEQ(s, d)))
query("sft_loss", _loss("-logp"))(lambda s, d: T.sft_loss(_SEQ(s, d)))
query(
    "geo_mean_loss",
    with_sql(
        "tokens",
        body=f"""
        , k AS (SELECT *, logp - old_logp AS k, greatest(least(logp - old_logp, 0.02), -0.02) AS kc, sign(adv) AS sg FROM tokens)
        , q AS (SELECT traj_id, sum(mask) AS m, sum(adv * mask) AS a, sum(sg * least(sg * k, sg * kc) * mask) AS x FROM k GROUP BY traj_id)
        , l AS (SELECT {r("avg(-(a / (m + 1e-8)) * exp(x / (m + 1e-8)))", "loss")} FROM q)
        , e AS (SELECT {_mean("CASE WHEN k <> kc AND adv > 0 THEN 1 ELSE 0 END", "clipfrac")}, {_mean("-k", "ppo_kl")}, {_mean("CASE WHEN k <> kc AND adv < 0 THEN 1 ELSE 0 END", "clipfrac_lower")} FROM k)
        SELECT * FROM l, e""",
    ),
)(lambda s, d: T.geo_mean(_SEQ(s, d), 0.02, 0.02))
query(
    "kl_cov_loss",
    with_sql(
        "tokens",
        body=f"""
        , v AS (SELECT *, (adv - avg(adv) OVER ()) * (logp - avg(logp) OVER ()) AS cov, count(*) OVER () AS n FROM tokens WHERE mask = 1)
        , k AS (SELECT *, row_number() OVER (ORDER BY round(cov, 12) DESC, traj_id, t) <= greatest(1, floor(n * 0.01)) AS top FROM v)
        SELECT {r("avg(-adv * exp(logp - old_logp) + CASE WHEN top THEN abs(logp - old_logp) ELSE 0 END)", "loss")}, {r("avg(abs(logp - old_logp))", "ppo_kl")}, CAST(count(*) FILTER (top) AS BIGINT) AS n_top FROM k""",
    ),
)(lambda s, d: T.kl_cov(_SEQ(s, d), ratio=0.01))
query("clip_cov_loss")(lambda s, d: T.clip_cov(_SEQ(s, d), ratio=0.01, cov_low=0.0001, cov_high=0.01))
_VC = "least(greatest(value * 1.2 + 0.1, value - 0.05), value + 0.05)"
_E1, _E2 = "power(value * 1.2 + 0.1 - reward, 2)", f"power({_VC} - reward, 2)"
query("value_loss", _loss(f"0.5 * greatest({_E1}, {_E2})", _mean(f"CASE WHEN {_E2} > {_E1} THEN 1 ELSE 0 END", "clipfrac")))(lambda s, d: T.value_loss(_SEQ(s, d), lambda x: x["reward"], lambda x: x["value"] * 1.2 + 0.1, clip=0.05))
query(
    "agg_loss_modes",
    with_sql(
        "tokens",
        body=f"""
        , q AS (SELECT traj_id, sum(reward * mask) AS s, sum(mask) AS m, count(*) AS z FROM tokens GROUP BY traj_id)
        SELECT 'token-mean' AS mode, {r("sum(s) / sum(m)", "loss")} FROM q
        UNION ALL SELECT 'seq-mean-token-sum', {r("sum(s) FILTER (m > 0) / count(*) FILTER (m > 0)", "loss")} FROM q
        UNION ALL SELECT 'seq-mean-token-sum-norm', {r("sum(s) FILTER (m > 0) / count(*) FILTER (m > 0) / max(z)", "loss")} FROM q
        UNION ALL SELECT 'seq-mean-token-mean', {r("sum(s / (m + 1e-8)) FILTER (m > 0) / count(*) FILTER (m > 0)", "loss")} FROM q""",
    ),
)(lambda s, d: T.aggregate_modes(_SEQ(s, d), lambda x: x["reward"]))


def _arrays(name: str, value: str, sql: str, f):
    @query(name, sql)
    def run(spark, sf_dir):
        df = f(_SEQ(spark, sf_dir))
        pairs = F.zip_with(F.transform("tok", lambda x: x["t"]), F.col(value), lambda t, v: F.struct(t.alias("t"), v.alias(value)))
        return df.select("traj_id", F.explode(pairs).alias("e")).select("traj_id", "e.*")


for _kind, _e in (("k1", "old_logp - rollout_logp"), ("abs", "abs(old_logp - rollout_logp)"), ("k2", "0.5 * (old_logp - rollout_logp) * (old_logp - rollout_logp)"), ("k3", "exp(rollout_logp - old_logp) - (rollout_logp - old_logp) - 1")):
    _arrays(f"kl_{_kind}", "kl", with_sql("tokens", body=f"SELECT traj_id, t, {r(_e, 'kl')} FROM tokens"), lambda q, k=_kind: q.withColumn("kl", F.transform("tok", lambda x: T.kl_forward(x["old_logp"], x["rollout_logp"], k))))
_arrays("reward_minus_kl", "reward", with_sql("tokens", body=f"SELECT traj_id, t, {r('reward - 0.1 * (old_logp - rollout_logp) * mask', 'reward')} FROM tokens"), lambda q: T.reward_minus_kl(q, 0.1).withColumn("reward", F.transform("tok", lambda x: x["reward"])))
query("mean_sequence_kl", with_sql("tokens", body=f", q AS (SELECT sum((old_logp - rollout_logp) * mask) / (sum(mask) + 1e-8) AS k FROM tokens GROUP BY traj_id) SELECT {r('avg(k)', 'kl')} FROM q"))(lambda s, d: T.mean_sequence_kl(_SEQ(s, d)))
#: Advantage of a valid token: discounted deltas of the valid tokens from it on; a masked token has that of the next valid one.
_GAE = """
    , n AS (SELECT *, min(CASE WHEN mask = 1 THEN t END) OVER (PARTITION BY traj_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nt FROM tokens)
    , v AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY t) AS k, coalesce(lead(value) OVER (PARTITION BY traj_id ORDER BY t), 0) AS nv FROM tokens WHERE mask = 1)
    , a AS MATERIALIZED (SELECT traj_id, t, sum(power(0.99 * 0.95, k) * (reward + 0.99 * nv - value)) OVER (PARTITION BY traj_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / power(0.99 * 0.95, k) AS adv FROM v)
    , g AS MATERIALIZED (SELECT n.traj_id, n.t, n.mask, n.value, coalesce(a.adv, 0) AS adv FROM n LEFT JOIN a ON a.traj_id = n.traj_id AND a.t = n.nt)"""
_arrays("gae_returns", "ret", with_sql("tokens", body=f"{_GAE} SELECT traj_id, t, {r('adv + value', 'ret')} FROM g"), lambda q: T.gae(q, 0.99, 0.95))
_arrays(
    "gae_adv", "adv_white",
    with_sql("tokens", body=_GAE + f""", m1 AS (SELECT sum(adv * mask) / (sum(mask) + 1e-8) AS mu, sum(mask) AS n FROM g), m2 AS (SELECT sum((adv - mu) * (adv - mu) * mask) / (n + 1e-8) * n / (n - 1) AS var FROM g, m1 GROUP BY n)
        SELECT traj_id, t, {r("(adv - mu) / sqrt(var + 1e-8) * mask", "adv_white")} FROM g, m1, m2"""),
    lambda q: T.whiten_array(T.gae(q, 0.99, 0.95), "adv_raw", "adv_white"),
)
_arrays(
    "reinforce_pp_returns", "ret",
    with_sql("tokens", body=f"""
        SELECT i.traj_id, i.t, {r("sum(power(0.9, j.t - i.t) * j.reward)", "ret")} FROM tokens i JOIN tokens j ON i.traj_id = j.traj_id AND j.t >= i.t
        WHERE NOT EXISTS (SELECT 1 FROM tokens x WHERE x.traj_id = i.traj_id AND x.mask = 0 AND x.t > i.t AND x.t <= j.t) GROUP BY 1, 2"""),
    lambda q: T.reinforce_plus_plus(q, 0.9),
)
_arrays(
    "whiten_tokens", "white",
    with_sql("tokens", body=f""", m1 AS (SELECT sum(reward * mask) / (sum(mask) + 1e-8) AS mu, sum(mask) AS n FROM tokens), m2 AS (SELECT sum((reward - mu) * (reward - mu) * mask) / (n + 1e-8) * n / (n - 1) AS var FROM tokens, m1 GROUP BY n)
        SELECT traj_id, t, {r("(reward - mu) / sqrt(var + 1e-8) * mask", "white")} FROM tokens, m1, m2"""),
    lambda q: T.whiten_array(q.withColumn("reward", F.transform("tok", lambda x: x["reward"])), "reward", "white"),
)

#: Thresholds by option, such that each rejects some.
RS = {"token_k1": "1.02", "token_k2": 0.0005, "token_k3": 0.0005, "seq_sum_k1": "0.95_1.1", "seq_sum_k2": 0.002, "seq_sum_k3": 0.002, "seq_mean_k1": "0.98_1.02", "seq_mean_k2": 0.0003, "seq_mean_k3": 0.0003, "seq_max_k2": 0.0008, "seq_max_k3": 0.0008}
_LR = "greatest(least(old_logp - rollout_logp, 20), -20)"
_STAT = {"k1": f"-{_LR}", "k2": f"0.5 * {_LR} * {_LR}", "k3": f"exp({_LR}) - 1 - {_LR}"}
for _option, _t in RS.items():
    _level, _, _k = _option.rpartition("_")
    _low, _high = T.parse_bounds(_t, _k == "k1")
    _test = f"{{}} BETWEEN ln({_low!r}) AND ln({_high!r})" if _k == "k1" else f"{{}} <= {_high!r}"
    _value = {"token": "x", "seq_sum": "sum(x * mask) OVER g", "seq_mean": "sum(x * mask) OVER g / (sum(mask) OVER g + 1e-8)", "seq_max": "coalesce(max(CASE WHEN mask = 1 THEN x END) OVER g, 0)"}[_level]
    query(
        f"rs_{_option}",
        with_sql(
            "tokens",
            body=f""", s AS (SELECT traj_id, mask, {_STAT[_k]} AS x FROM tokens), k AS (SELECT traj_id, mask, CASE WHEN {_test.format(_value)} THEN 1 ELSE 0 END AS keep FROM s WINDOW g AS (PARTITION BY traj_id))
            , q AS (SELECT traj_id, sum(mask) AS n, sum(mask * keep) AS kept FROM k GROUP BY traj_id)
            SELECT {r("sum(n - kept) / (sum(n) + 1e-8)", "masked_fraction")}, {r("avg(CASE WHEN kept < n THEN 1.0 ELSE 0 END)", "seq_masked_fraction")} FROM q""",
        ),
    )(lambda s, d, o=_option, t=_t: T.rejection_metrics(_SEQ(s, d), {o: t}))

_W = {"is_token_tis": ("token", "1.01", "least(exp(l), 1.01)", "exp(l)"), "is_seq_tis": ("sequence", "1.05", "least(exp(ls), 1.05)", "exp(ls)"), "is_icepop": ("token", "0.99_1.01", "CASE WHEN exp(l) BETWEEN 0.99 AND 1.01 THEN exp(l) ELSE 0 END", "exp(l)")}
for _name, (_level, _t, _cut, _raw) in _W.items():
    _high = float(_t.split("_")[-1])
    query(
        _name,
        with_sql(
            "tokens",
            body=f""", s AS (SELECT traj_id, mask, {_LR} AS l, greatest(least(sum((old_logp - rollout_logp) * mask) OVER (PARTITION BY traj_id), 20), -20) AS ls FROM tokens)
            , w AS (SELECT traj_id, mask, ({_cut}) * mask AS w, {_raw} * mask AS raw FROM s)
            , q AS (SELECT traj_id, sum(mask) AS m, sum(w * mask) AS sw, sum(least(w, {_high}) * mask) AS sc, sum(least(w, {_high}) * least(w, {_high}) * mask) AS sq, sum(CASE WHEN raw > {_high} THEN mask ELSE 0 END) AS u, sum(CASE WHEN raw < 1 / CAST({_high} AS DOUBLE) THEN mask ELSE 0 END) AS d FROM w GROUP BY traj_id)
            , e AS (SELECT sum(sc) / (sum(m) + 1e-8) AS mc, sum(sq) / (sum(m) + 1e-8) AS mq FROM q)
            SELECT {r("sum(sw) / (sum(m) + 1e-8)", "is_mean")}, {r("sum(u) / (sum(m) + 1e-8)", "fraction_high")}, {r("sum(d) / (sum(m) + 1e-8)", "fraction_low")}, {r("sqrt(greatest(max(mq) - max(mc) * max(mc), 0))", "is_std")},
                {r("1 / (max(mq) / ((max(mc) + 1e-8) * (max(mc) + 1e-8)))", "effective_sample_size")}, {r("avg(sw / (m + 1e-8))", "seq_mean")}, {r("max(sw / (m + 1e-8))", "seq_max")} FROM q, e""",
        ),
    )(lambda s, d, level=_level, t=_t, h=_high: T.importance_metrics(T.importance_weights(_SEQ(s, d), level, t), h))
query(
    "offpolicy_metrics",
    with_sql(
        "tokens",
        body=f""", q AS (SELECT traj_id, sum(mask) AS m, sum(old_logp * mask) / (sum(mask) + 1e-8) AS tr, sum(rollout_logp * mask) / (sum(mask) + 1e-8) AS ro, sum((rollout_logp - old_logp) * mask) AS kl,
            sum((exp(old_logp - rollout_logp) - (old_logp - rollout_logp) - 1) * mask) AS k3, sum(exp(2 * {_LR}) * mask) AS c, exp(2 * greatest(least(sum((old_logp - rollout_logp) * mask), 20), -20)) AS s FROM tokens GROUP BY traj_id)
        SELECT {r("avg(exp(-tr))", "training_ppl")}, {r("avg(-tr)", "training_log_ppl")}, {r("sum(kl) / (sum(m) + 1e-8)", "kl")}, {r("sum(k3) / (sum(m) + 1e-8)", "k3_kl")}, {r("avg(exp(-ro))", "rollout_ppl")}, {r("avg(-ro)", "rollout_log_ppl")},
            {r("avg(ro - tr)", "log_ppl_diff")}, {r("avg(abs(ro - tr))", "log_ppl_abs_diff")}, {r("max(ro - tr)", "log_ppl_diff_max")}, {r("min(ro - tr)", "log_ppl_diff_min")}, {r("avg(exp(ro - tr))", "ppl_ratio")}, {r("sum(c) / (sum(m) + 1e-8) - 1", "chi2_token")}, {r("avg(s) - 1", "chi2_seq")} FROM q""",
    ),
)(lambda s, d: T.offpolicy_metrics(_SEQ(s, d)))


def _conversations(spark, sf_dir):
    """conv_id, ids: the lengths of the turns' texts as token ids, in order."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.pmod(F.length("text"), F.lit(7)).cast("long").alias("v")).alias("s"))
    return c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["v"]).alias("ids"))


_IDS = "WITH c AS (SELECT conv_id, list(length(text) % 7 ORDER BY turn) AS ids FROM conversations GROUP BY conv_id)"
_JOIN = "array_to_string({}, ',')"
_text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
query("first_eos_mask", f"{_IDS} SELECT conv_id, {_JOIN.format('list_transform(ids, lambda x, i: CASE WHEN list_position(ids, 3) > 0 AND i > list_position(ids, 3) THEN 0 ELSE 1 END)')} AS mask FROM c")(lambda s, d: _conversations(s, d).select("conv_id", _text(T.first_eos_mask(F.col("ids"), [3])).alias("mask")))
for _cut, _sql in (("left", "ids[len(ids) - 3:]"), ("right", "ids[1:4]"), ("middle", "list_concat(ids[1:2], ids[len(ids) - 1:])")):
    query(f"truncate_pad_{_cut}", f"{_IDS} SELECT conv_id, {_JOIN.format(f'CASE WHEN len(ids) > 4 THEN {_sql} ELSE list_concat([-1 FOR x IN range(4 - len(ids))], ids) END')} AS ids FROM c")(
        lambda s, d, cut=_cut: _conversations(s, d).select("conv_id", _text(T.fit_length(F.col("ids"), 4, F.lit(-1).cast("long"), truncation=cut)).alias("ids"))
    )
query("ragged_round_trip", f"{_IDS} SELECT conv_id, {_JOIN.format('ids')} AS ids FROM c")(
    lambda s, d: _conversations(s, d).select("conv_id", _text(T.drop_masked(T.pad(F.col("ids"), 500, F.lit(-1).cast("long")), T.pad(F.transform("ids", lambda x: F.lit(1)), 500, F.lit(0)))).alias("ids"))
)
query("last_token_scatter", "WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) SELECT conv_id, array_to_string(list_transform(range(1, n + 3), lambda i: CASE WHEN i = n THEN 'x' ELSE '.' END), '') AS places FROM c")(
    lambda s, d: _conversations(s, d).select("conv_id", F.array_join(F.transform(T.last_token_scatter(F.size("ids"), F.lit(2.5), F.size("ids") + 2), lambda x: F.when(x > 0, "x").otherwise(".")), "").alias("places"))
)
query("overlong_penalty", f"SELECT doc_id, {r('least(-(n_chars - 1500) / 500.0 * 0.5, 0)', 'penalty')} FROM documents")(lambda s, d: table(s, d, "documents").select("doc_id", T.overlong_penalty(F.col("n_chars"), 2000, 500, 0.5).alias("penalty")))
