"""Rollout correction as a whole: named settings, weights and rejection together, and losses that bypass the old policy."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import LOSSES
from . import tokens as T


@dataclass(frozen=True)
class Correction:
    """weights: token, sequence or None, up to (or within) a threshold; reject: an option of T.RS_OPTIONS, or None."""

    weights: str | None = "sequence"
    threshold: str | float = 2.0
    normalize: bool = False
    reject: str | None = None
    reject_threshold: str | float | None = None
    bypass: bool = False
    loss: str = "ppo_clip"


_GEO, _K3 = {"reject": "seq_mean_k1", "reject_threshold": "0.999_1.001"}, {"reject": "seq_mean_k3", "reject_threshold": 0.01}
_PG = {"bypass": True, "loss": "reinforce"}
#: The settings that have a name.
PRESETS = {
    "decoupled_token_is": Correction("token"),
    "decoupled_seq_is": Correction("sequence"),
    "decoupled_token_icepop": Correction("token", "0.5_5.0"),
    "decoupled_seq_is_rs": Correction("sequence", reject="seq_sum_k1", reject_threshold="0.5_2.0"),
    "decoupled_geo_rs": Correction(None, **_GEO),
    "decoupled_geo_rs_seq_tis": Correction("sequence", **_GEO),
    "decoupled_geo_rs_token_tis": Correction("token", **_GEO),
    "decoupled_k3_rs": Correction(None, **_K3),
    "decoupled_k3_rs_seq_tis": Correction("sequence", **_K3),
    "decoupled_k3_rs_token_tis": Correction("token", **_K3),
    "bypass_ppo_clip": Correction(None, bypass=True),
    "bypass_ppo_clip_geo_rs": Correction(None, bypass=True, **_GEO),
    "bypass_ppo_clip_k3_rs": Correction(None, bypass=True, **_K3),
    "bypass_pg_is": Correction("sequence", **_PG),
    "bypass_pg_token_icepop": Correction("token", "0.5_5.0", **_PG),
    "bypass_pg_geo_rs": Correction(None, **_GEO, **_PG),
    "bypass_pg_geo_rs_seq_tis": Correction("sequence", **_GEO, **_PG),
    "bypass_pg_geo_rs_token_tis": Correction("token", **_GEO, **_PG),
    "disabled": Correction(None),
}


def preset(name: str, **changes) -> Correction:
    if name not in PRESETS:
        raise ValueError(f"unknown correction {name!r}; known: {', '.join(PRESETS)}")
    return replace(PRESETS[name], **changes)


def correct(seqs: DataFrame, how: Correction) -> DataFrame:
    """seqs with tok.mask after rejection (tok.mask_before is the old one), and tok.weight if weights are asked for.

    Weights and rejection both see the old mask. Sequences without any valid token stay as they are.
    """
    if how.reject and how.reject_threshold is None:
        raise ValueError("rejection needs a threshold")
    if how.weights:
        seqs = T.importance_weights(seqs, how.weights, how.threshold, how.normalize)
    options = {o.strip(): t.strip() for o, t in zip(how.reject.split(","), str(how.reject_threshold).split(","), strict=True)} if how.reject else {}
    return T.rejection_mask(seqs, options)


def correction_metrics(seqs: DataFrame, how: Correction) -> DataFrame:
    """One row: the metrics of weights and rejection, as far as they are asked for, and of the policies' difference."""
    out = T.offpolicy_metrics(seqs)
    if how.weights:
        out = out.join(F.broadcast(T.importance_metrics(T.importance_weights(seqs, how.weights, how.threshold, how.normalize), T.parse_is_threshold(how.threshold)[1])))
    if how.reject:
        options = dict(zip(how.reject.split(","), str(how.reject_threshold).split(","), strict=True))
        out = out.join(F.broadcast(T.rejection_metrics(seqs, options)))
    return out.withColumnsRenamed({c: f"rollout_corr/{c}" for c in out.columns})


def bypass(seqs: DataFrame) -> DataFrame:
    """seqs whose old policy is the rollout policy."""
    return seqs.withColumn("tok", F.transform("tok", lambda x: x.withField("old_logp", x["rollout_logp"])))


@LOSSES.register("bypass_mode")
def bypass_loss(seqs: DataFrame, how: Correction, mode: str = "token-mean", **clip) -> DataFrame:
    """The loss of the current policy against the rollout policy; PPO's own ratio corrects, so only reinforce is weighted."""
    current = seqs.withColumn("tok", F.transform("tok", lambda x: x.withField("old_logp", x["logp"])))
    ready = bypass(correct(current, how))
    if how.loss == "reinforce":
        return T.reinforce(ready, mode, "weight" if how.weights else None)
    if how.loss == "ppo_clip":
        return T.ppo(ready, mode=mode, **clip)
    raise ValueError(f"unknown loss {how.loss!r}")


def entropy_loss(seqs: DataFrame, entropy: T.Token, mode: str = "token-mean") -> DataFrame:
    """One row: the aggregate of the tokens' entropies."""
    return T.loss_table(seqs, entropy, mode)


def policy_loss(seqs: DataFrame, loss: str = "vanilla", entropy: T.Token | None = None, entropy_coef: float = 0.0, kl_coef: float = 0.0, kl_kind: str = "k3", mode: str = "token-mean") -> DataFrame:
    """One row: pg_loss of a registered loss, less the entropy, plus the KL to the reference (tok.rollout_logp); loss is their sum."""
    out = LOSSES.get(loss)(seqs, mode=mode).withColumnRenamed("loss", "pg_loss")
    parts = {"entropy_loss": entropy} if entropy else {}
    if kl_coef:
        parts["kl_loss"] = lambda x: T.kl_forward(x["logp"], x["rollout_logp"], kl_kind)
    for name, f in parts.items():
        out = out.join(F.broadcast(T.loss_table(seqs, f, mode).select(F.col("loss").alias(name))))
    total = F.col("pg_loss")
    if entropy:
        total = total - entropy_coef * F.col("entropy_loss")
    if kl_coef:
        total = total + kl_coef * F.col("kl_loss")
    return out.withColumn("loss", total)
