"""Token-array operators: sequences (uid, traj_id, tok: array of structs) -> arrays, or a row of scalars.

Everything within a trajectory is a higher-order function over its array and never shuffles; only one partial sum a
sequence enters an aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import LOSSES
from .batch import ROW, with_row_index

Token = Callable[[Column], Column]
BOUND = 20.0


def total(tok: Column | str, f: Token) -> Column:
    """Sum of f over the tokens."""
    tok = F.col(tok) if isinstance(tok, str) else tok
    return F.aggregate(tok, F.lit(0.0), lambda s, x: s + f(x).cast("double"))


def masked(tok: Column | str, f: Token) -> Column:
    return total(tok, lambda x: f(x) * x["mask"])


def valid(tok: Column | str) -> Column:
    return total(tok, lambda x: x["mask"])


def clamp(x: Column, low: float | None, high: float | None) -> Column:
    x = x if low is None else F.greatest(x, F.lit(low))
    return x if high is None else F.least(x, F.lit(high))


AGGREGATIONS = ("token-mean", "seq-mean-token-sum", "seq-mean-token-sum-norm", "seq-mean-token-mean")


def reduce_loss(s: Column, m: Column, size: Column, mode: str) -> Column:
    """An aggregate over sequences; s: masked sum, m: valid tokens, size: tokens. Fully masked sequences don't count."""
    some = m > 0
    if mode == "token-mean":
        return F.sum(s) / F.sum(m)
    if mode == "seq-mean-token-sum":
        return F.sum(F.when(some, s)) / F.count_if(some)
    if mode == "seq-mean-token-sum-norm":
        return F.sum(F.when(some, s)) / F.count_if(some) / F.max(size)
    if mode == "seq-mean-token-mean":
        return F.sum(F.when(some, s / (m + 1e-8))) / F.count_if(some)
    raise ValueError(f"unknown aggregation {mode!r}")


def loss_table(seqs: DataFrame, loss: Token, mode: str = "token-mean", **means: Token) -> DataFrame:
    """One row: `loss` by the aggregation, and the masked mean of each further token function."""
    parts = {"_s": masked("tok", loss), "_m": valid("tok"), "_z": F.size("tok")} | {f"_{k}": masked("tok", f) for k, f in means.items()}
    df = seqs.select(*[v.alias(k) for k, v in parts.items()])
    return df.agg(reduce_loss(F.col("_s"), F.col("_m"), F.col("_z"), mode).alias("loss"), *[(F.sum(f"_{k}") / (F.sum("_m") + 1e-8)).alias(k) for k in means])


def aggregate_modes(seqs: DataFrame, loss: Token) -> DataFrame:
    """One row for each aggregation mode: mode, loss."""
    df = seqs.select(masked("tok", loss).alias("s"), valid("tok").alias("m"), F.size("tok").alias("z"))
    row = df.agg(*[reduce_loss(F.col("s"), F.col("m"), F.col("z"), m).alias(m) for m in AGGREGATIONS])
    return row.select(F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(f"`{m}`").alias("loss")) for m in AGGREGATIONS])).alias("e")).select("e.*")


def _ratio(x: Column) -> Column:
    return F.exp(clamp(x["logp"] - x["old_logp"], -BOUND, BOUND))


def _kl(x: Column) -> Column:
    return -clamp(x["logp"] - x["old_logp"], -BOUND, BOUND)


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def _weighted(f: Token, weight: str | None) -> Token:
    return (lambda x: f(x) * x[weight]) if weight else f


@LOSSES.register("vanilla", "ppo")
def ppo(seqs: DataFrame, low: float = 0.2, high: float = 0.2, c: float = 3.0, mode: str = "token-mean", weight: str | None = None) -> DataFrame:
    """Dual-clip PPO."""
    l1 = lambda x: -x["adv"] * _ratio(x)
    l2 = lambda x: -x["adv"] * clamp(_ratio(x), 1 - low, 1 + high)
    up = lambda x: F.greatest(l1(x), l2(x))
    floor = lambda x: -x["adv"] * c
    loss = lambda x: F.when(x["adv"] < 0, F.least(floor(x), up(x))).otherwise(up(x))
    return loss_table(seqs, _weighted(loss, weight), mode, clipfrac=lambda x: _flag(l2(x) > l1(x)), ppo_kl=_kl, clipfrac_lower=lambda x: _flag((up(x) > floor(x)) & (x["adv"] < 0)))


def _gated(keep: Callable, name: str):
    def loss(seqs: DataFrame, low: float = 0.2, high: float = 0.2, c: float = 20.0, mode: str = "token-mean", weight: str | None = None) -> DataFrame:
        gate = lambda x: _flag(F.when(x["adv"] > 0, keep(x, high, True)).otherwise(keep(x, low, False)))
        body = lambda x: -x["adv"] * clamp(_ratio(x), None, c) * x["logp"] * gate(x)
        return loss_table(seqs, _weighted(body, weight), mode, clipfrac=lambda x: 1.0 - gate(x), ppo_kl=_kl, clipfrac_lower=lambda x: _flag(_ratio(x) > c) * gate(x))

    loss.__name__ = name
    return LOSSES.register(name)(loss)


def _tv(x: Column, bound: float, up: bool) -> Column:
    step = F.exp(x["logp"]) - F.exp(x["old_logp"])
    return step <= bound if up else step >= -bound


def _binary_kl(x: Column, bound: float, up: bool) -> Column:
    p, q = F.exp(x["logp"]), F.exp(x["old_logp"])
    kl = q * (x["old_logp"] - x["logp"]) + (1 - q) * F.log((1.0 - q + 1e-8) / (1.0 - p + 1e-8))
    return (kl <= bound) | (p <= q if up else p >= q)


dppo_tv = _gated(_tv, "dppo_tv")
dppo_kl = _gated(_binary_kl, "dppo_kl")


def _sequence_kl(seqs: DataFrame) -> DataFrame:
    """seqs with the mean log ratio of each sequence as a field of its tokens."""
    mean = masked("tok", lambda x: x["logp"] - x["old_logp"]) / F.greatest(valid("tok"), F.lit(1.0))
    return seqs.withColumn("_k", mean).withColumn("tok", F.transform("tok", lambda x: x.withField("seq", F.col("_k")))).drop("_k")


@LOSSES.register()
def gspo(seqs: DataFrame, low: float = 0.2, high: float = 0.2, weight: str | None = None) -> DataFrame:
    """Sequence-level ratio; always the mean of sequence means."""
    r = lambda x: F.exp(clamp(x["seq"], None, 10.0))
    l1, l2 = (lambda x: -x["adv"] * r(x)), (lambda x: -x["adv"] * clamp(r(x), 1 - low, 1 + high))
    return loss_table(_sequence_kl(seqs), _weighted(lambda x: F.greatest(l1(x), l2(x)), weight), "seq-mean-token-mean", clipfrac=lambda x: _flag(l2(x) > l1(x)), ppo_kl=lambda x: x["old_logp"] - x["logp"])


@LOSSES.register()
def sapo(seqs: DataFrame, tau_pos: float = 1.0, tau_neg: float = 1.05, weight: str | None = None) -> DataFrame:
    """Sigmoid gate of the ratio; always the mean of sequence means."""
    tau = lambda x: F.when(x["adv"] > 0, tau_pos).otherwise(tau_neg)
    gate = lambda x: 4.0 / tau(x) / (1 + F.exp(-tau(x) * (_ratio(x) - 1.0)))
    return loss_table(seqs, _weighted(lambda x: -gate(x) * x["adv"], weight), "seq-mean-token-mean", ppo_kl=_kl)


@LOSSES.register("gpg")
def gpg_loss(seqs: DataFrame, mode: str = "token-mean", weight: str | None = None) -> DataFrame:
    return loss_table(seqs, _weighted(lambda x: -x["logp"] * x["adv"], weight), mode)


@LOSSES.register()
def cispo(seqs: DataFrame, low: float = 0.2, high: float = 0.2, mode: str = "token-mean", weight: str | None = None) -> DataFrame:
    """The clipped ratio as a constant weight of the log-likelihood."""
    clipped = lambda x: clamp(_ratio(x), 1 - low, 1 + high)
    return loss_table(seqs, _weighted(lambda x: -clipped(x) * x["adv"] * x["logp"], weight), mode, clipfrac=lambda x: _flag(_ratio(x) != clipped(x)), ppo_kl=_kl)


@LOSSES.register()
def reinforce(seqs: DataFrame, mode: str = "seq-mean-token-sum", weight: str | None = None) -> DataFrame:
    return loss_table(seqs, _weighted(lambda x: -x["adv"] * x["logp"], weight), mode, ppo_kl=lambda x: x["rollout_logp"] - x["logp"])


@LOSSES.register()
def geo_mean(seqs: DataFrame, low: float = 0.2, high: float = 0.2) -> DataFrame:
    """Geometric mean of clipped ratios; a plain mean over sequences, fully masked ones too."""
    k = lambda x: x["logp"] - x["old_logp"]
    cl = lambda x: clamp(k(x), -low, high)
    sgn = lambda x: F.signum(x["adv"])
    least = lambda x: sgn(x) * F.least(sgn(x) * k(x), sgn(x) * cl(x))
    m = valid("tok")
    loss = -(masked("tok", lambda x: x["adv"]) / (m + 1e-8)) * F.exp(masked("tok", least) / (m + 1e-8))
    off = lambda up: masked("tok", lambda x: _flag((k(x) != cl(x)) & (x["adv"] > 0 if up else x["adv"] < 0)))
    df = seqs.select(loss.alias("l"), m.alias("m"), off(True).alias("u"), off(False).alias("d"), masked("tok", lambda x: -k(x)).alias("k"))
    n = F.sum("m") + 1e-8
    return df.agg(F.avg("l").alias("loss"), (F.sum("u") / n).alias("clipfrac"), (F.sum("k") / n).alias("ppo_kl"), (F.sum("d") / n).alias("clipfrac_lower"))


def _covariance(seqs: DataFrame) -> tuple[DataFrame, int]:
    """(valid tokens in long form with their covariance term (adv - mean) * (logp - mean), how many there are); means within the arrays, in one pass."""
    part = lambda f: F.aggregate("tok", F.lit(0.0), lambda s, x: s + F.when(x["mask"] == 1, f(x)).otherwise(0.0))
    n, a, b = seqs.agg(F.sum(part(lambda x: F.lit(1.0))), F.sum(part(lambda x: x["adv"])), F.sum(part(lambda x: x["logp"]))).first()
    n = int(n or 0)
    long = seqs.select("traj_id", F.explode(F.filter("tok", lambda x: x["mask"] == 1)).alias("x")).select("traj_id", "x.*")
    return long.withColumn("cov", (F.col("adv") - F.lit((a or 0.0) / max(n, 1))) * (F.col("logp") - F.lit((b or 0.0) / max(n, 1)))), n


def first_rows(rows: DataFrame, value: str, ties: list[str], count: int) -> DataFrame:
    """The first `count` rows by value and ties, of which there may be very many: what an approximate quantile leaves is numbered in ranges."""
    n = rows.count()
    if n <= count:
        return rows
    share = min(1.0, 1.5 * count / n + 0.001)
    cut = rows.agg(F.percentile_approx(value, share, 10_000)).first()[0]
    part = rows.where(F.col(value) <= F.lit(cut))
    return with_row_index(part if part.count() >= count else rows, value, *ties).where(F.col(ROW) < count).drop(ROW)


def last_of_first(rows: DataFrame, order: list[str], count: int, n: int):
    """The row in place `count` of an order of n rows, as (values); the last one if there are fewer. Ties are settled by the further columns.

    An approximate quantile leaves little more than `count` rows, which are numbered in ranges.
    """
    share = min(1.0, 1.5 * count / max(n, 1) + 0.001)
    cut, held = rows.agg(F.percentile_approx(order[0], share, 10_000), F.count(F.lit(1))).first()
    if not held:
        return None
    part = rows.where(F.col(order[0]) <= F.lit(cut))
    at = min(count, held) - 1
    found = with_row_index(part, *order).where(F.col(ROW) == at).first() or with_row_index(rows, *order).where(F.col(ROW) == at).first()
    return [found[c] for c in order]


def _up_to(order: list[Column], values: list | None) -> Column:
    """Whether a row stands at or before these values in the order."""
    if values is None:
        return F.lit(False)
    out = F.lit(True)
    for c, v in reversed(list(zip(order, values, strict=True))):
        out = (c < F.lit(v)) | ((c == F.lit(v)) & out)
    return out


@LOSSES.register()
def kl_cov(seqs: DataFrame, ratio: float = 0.0002, coef: float = 1.0) -> DataFrame:
    """REINFORCE with ratio; the tokens of largest covariance also pay |kl|. The mean over valid tokens."""
    long, n = _covariance(seqs)
    value = (-F.round("cov", 12)).alias("_v")
    last = last_of_first(long.select(value, "traj_id", "t"), ["_v", "traj_id", "t"], max(1, math.floor(n * ratio)), n)
    top = _up_to([-F.round("cov", 12), F.col("traj_id"), F.col("t")], last)
    x = F.col("logp") - F.col("old_logp")
    loss = -F.col("adv") * F.exp(x) + F.when(top, coef * F.abs(x)).otherwise(0.0)
    return long.agg((F.sum(loss) / F.count(F.lit(1))).alias("loss"), F.avg(F.abs(x)).alias("ppo_kl"), F.count_if(top).alias("n_top"))


@LOSSES.register()
def clip_cov(seqs: DataFrame, ratio: float = 0.0002, low: float = 0.2, high: float = 0.2, cov_low: float = 1.0, cov_high: float = 5.0, seed: int = 0) -> DataFrame:
    """PPO without the tokens of a random choice among those with covariance between the bounds; the choice is by a seeded hash."""
    long, n = _covariance(seqs)
    x = F.exp(F.col("logp") - F.col("old_logp"))
    l1, l2 = -F.col("adv") * x, -F.col("adv") * clamp(x, 1 - low, 1 + high)
    may = (F.col("cov") > cov_low) & (F.col("cov") < cov_high) & ~(l2 > l1)
    place = F.xxhash64("traj_id", "t", F.lit(seed))
    open_ = long.where(may).select(place.alias("_v"), "traj_id", "t")
    last = last_of_first(open_, ["_v", "traj_id", "t"], max(1, math.floor(n * ratio)), open_.count())
    off = F.when(may & _up_to([place, F.col("traj_id"), F.col("t")], last), 0.0).otherwise(1.0)
    return long.agg(F.avg(F.greatest(l1, l2) * off).alias("loss"), F.avg(1 - off).alias("clipfrac"), F.avg(F.col("old_logp") - F.col("logp")).alias("ppo_kl"))


def value_loss(seqs: DataFrame, returns: Token, prediction: Token, clip: float = 0.5, mode: str = "token-mean") -> DataFrame:
    """Half the larger of the squared errors of the prediction and of the clipped prediction."""
    clipped = lambda x: F.least(F.greatest(prediction(x), x["value"] - clip), x["value"] + clip)
    e1 = lambda x: F.pow(prediction(x) - returns(x), 2)
    e2 = lambda x: F.pow(clipped(x) - returns(x), 2)
    return loss_table(seqs, lambda x: 0.5 * F.greatest(e1(x), e2(x)), mode, clipfrac=lambda x: _flag(e2(x) > e1(x)))


def sft_loss(seqs: DataFrame) -> DataFrame:
    """Negative log-likelihood of valid tokens, over their number."""
    return loss_table(seqs, lambda x: -x["logp"], "token-mean")


def kl_forward(logp: Column, ref: Column, kind: str) -> Column:
    """A sampled KL term; a trailing + changes only gradients, which there are none of here."""
    kind = kind.removesuffix("+")
    if kind in ("kl", "k1"):
        return logp - ref
    if kind == "abs":
        return F.abs(logp - ref)
    if kind in ("mse", "k2"):
        return 0.5 * (logp - ref) * (logp - ref)
    if kind in ("low_var_kl", "k3"):
        k = clamp(ref - logp, -BOUND, BOUND)
        return clamp(F.exp(k) - k - 1, -10.0, 10.0)
    raise ValueError(f"unknown KL term {kind!r}")


def reward_minus_kl(seqs: DataFrame, beta: float, kind: str = "k1") -> DataFrame:
    """tok.reward minus beta times the masked KL of old to reference log-likelihood."""
    return seqs.withColumn("tok", F.transform("tok", lambda x: x.withField("reward", x["reward"] - beta * kl_forward(x["old_logp"], x["rollout_logp"], kind) * x["mask"])))


def mean_sequence_kl(seqs: DataFrame, kind: str = "k1") -> DataFrame:
    """The mean over sequences of their masked mean KL, which an adaptive controller takes."""
    one = masked("tok", lambda x: kl_forward(x["old_logp"], x["rollout_logp"], kind)) / (valid("tok") + 1e-8)
    return seqs.agg(F.avg(one).alias("kl"))


class AdaptiveKL:
    """The coefficient of a KL penalty that follows a target."""

    def __init__(self, beta: float, target: float, horizon: float):
        self.beta, self.target, self.horizon = beta, target, horizon

    def update(self, kl: float, steps: int) -> float:
        self.beta *= 1 + max(-0.2, min(0.2, kl / self.target - 1)) * steps / self.horizon
        return self.beta


class FixedKL:
    def __init__(self, beta: float):
        self.beta = beta

    def update(self, kl: float, steps: int) -> float:
        return self.beta


# Recurrences -----------------------------------------------------------------------------------------------------------


#: Tokens of a piece of a scan: an array grows by appending within a piece only, so that a scan is linear in the tokens.
PIECE = 256


def reverse_scan(tok: Column, start: dict[str, float], step: Callable[[Column, Column], tuple[dict[str, Column], Column]]) -> Column:
    """The values of a scan from the last token to the first, in token order; step(state, token) -> (new state, value)."""
    back = F.reverse(tok)
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.size(tok), F.lit(1)), F.lit(PIECE)), lambda i: F.slice(back, i, F.lit(PIECE)))

    def token(s, x):
        new, value = step(s, x)
        return F.struct(*[c.alias(n) for n, c in new.items()], F.array_append(s["out"], value).alias("out"))

    def piece(s, p):
        begin = F.struct(*[s[n].alias(n) for n in start], F.array().cast("array<double>").alias("out"))
        whole = lambda x: F.struct(*[x[n].alias(n) for n in start], F.array_append(s["done"], x["out"]).alias("done"))
        return F.element_at(F.transform(F.array(F.aggregate(p, begin, token)), whole), 1)

    zero = F.struct(*[F.lit(v).alias(n) for n, v in start.items()], F.array().cast("array<array<double>>").alias("done"))
    return F.reverse(F.flatten(F.aggregate(pieces, zero, piece)["done"]))


def gae(seqs: DataFrame, gamma: float = 1.0, lam: float = 0.95) -> DataFrame:
    """adv_raw and ret arrays: generalised advantages; masked tokens hand the state through."""

    def step(s, x):
        delta = x["reward"] + gamma * s["v"] - x["value"]
        own = F.when(x["mask"] == 1, delta + gamma * lam * s["a"]).otherwise(s["a"])
        return {"v": F.when(x["mask"] == 1, x["value"]).otherwise(s["v"]), "a": own}, own

    df = seqs.withColumn("adv_raw", reverse_scan(F.col("tok"), {"v": 0.0, "a": 0.0}, step))
    return df.withColumn("ret", F.zip_with("adv_raw", "tok", lambda a, x: a + x["value"]))


def reinforce_plus_plus(seqs: DataFrame, gamma: float = 1.0) -> DataFrame:
    """ret array: discounted reward to go, which starts anew after a masked token."""

    def step(s, x):
        ret = x["reward"] + gamma * s["r"]
        return {"r": ret * x["mask"]}, ret

    return seqs.withColumn("ret", reverse_scan(F.col("tok"), {"r": 0.0}, step))


def whiten_array(seqs: DataFrame, values: str, out: str, shift: bool = True) -> DataFrame:
    """An array column standardised over all valid tokens, 0 at masked ones.

    One pass sums what each sequence says of itself: its valid tokens, their mean, and the squares about that mean.
    """
    pairs = F.zip_with(values, "tok", lambda v, x: F.struct(v.alias("v"), x["mask"].cast("double").alias("m")))
    fold = lambda f: F.aggregate("_p", F.lit(0.0), lambda s, y: s + f(y))
    own = seqs.select(pairs.alias("_p")).select("_p", fold(lambda y: y["m"]).alias("n"), fold(lambda y: y["v"] * y["m"]).alias("s")).withColumn("mean", F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(0.0))
    own = own.select("n", "s", "mean", fold(lambda y: (y["v"] - F.col("mean")) * (y["v"] - F.col("mean")) * y["m"]).alias("q"))
    sums = own.agg(F.sum("n").alias("_n"), F.sum("s").alias("_s"), F.sum("q").alias("_q"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("_b"))
    n = F.when(F.col("_n") > 1, F.col("_n")).otherwise(F.raise_error("whitening needs two valid tokens").cast("double"))
    mean = F.col("_s") / (n + 1e-8)
    # Squares about the mean of all: those about the sequences' means, and those of the sequences' means.
    square = F.col("_q") + F.col("_b") - 2 * mean * F.col("_s") + n * mean * mean
    scale = 1 / F.sqrt(F.greatest(square, F.lit(0.0)) / (n + 1e-8) * n / (n - 1) + 1e-8)
    df = seqs.join(F.broadcast(sums.select(mean.alias("_m"), scale.alias("_r"))))
    white = F.zip_with(values, "tok", lambda v, x: ((v - F.col("_m")) * F.col("_r") + (0 if shift else F.col("_m"))) * x["mask"])
    return df.withColumn(out, white).drop("_m", "_r")


# Off-policy correction --------------------------------------------------------------------------------------------------

RS_OPTIONS = [f"{level}_{k}" for level in ("token", "seq_sum", "seq_mean", "seq_max") for k in ("k1", "k2", "k3") if (level, k) != ("seq_max", "k1")]


def parse_bounds(spec: str | float, k1: bool) -> tuple[float | None, float]:
    """(lower, upper) of "lo_hi" or "hi"; k1 has 1/hi for a missing lower bound, others take no lower one."""
    parts = [float(x) for x in str(spec).split("_")]
    if any(x <= 0 for x in parts) or len(parts) > 2 or (len(parts) == 2 and not k1):
        raise ValueError(f"bad threshold {spec!r}")
    if len(parts) == 2:
        return parts[0], parts[1]
    return (1 / parts[0] if k1 else None), parts[0]


def parse_is_threshold(spec: str | float) -> tuple[float | None, float]:
    """(lower, upper) of an importance weight's bounds; a lower bound means a band instead of truncation."""
    parts = [float(x) for x in str(spec).split("_")]
    if len(parts) > 2 or any(x <= 0 for x in parts) or (len(parts) == 2 and parts[0] > parts[1]):
        raise ValueError(f"bad threshold {spec!r}")
    return (parts[0], parts[1]) if len(parts) == 2 else (None, parts[0])


def _log_ratio(x: Column) -> Column:
    return x["old_logp"] - x["rollout_logp"]


def _statistic(k: str) -> Token:
    r = lambda x: clamp(_log_ratio(x), -BOUND, BOUND)
    return {"k1": lambda x: -r(x), "k2": lambda x: 0.5 * r(x) * r(x), "k3": lambda x: F.exp(r(x)) - 1.0 - r(x)}[k]


def rejection_keep(option: str, threshold: str | float, tok: str = "tok") -> Token | Column:
    """Whether a token (a function of it) or its sequence (a column) is kept."""
    if option not in RS_OPTIONS:
        raise ValueError(f"unknown option {option!r}")
    level, _, k = option.rpartition("_")
    low, high = parse_bounds(threshold, k == "k1")
    inside = (lambda s: (s >= math.log(low)) & (s <= math.log(high))) if k == "k1" else (lambda s: s <= high)
    f = _statistic(k)
    if level == "token":
        return lambda x: inside(f(x))
    if level == "seq_sum":
        return inside(masked(tok, f))
    if level == "seq_mean":
        return inside(masked(tok, f) / (valid(tok) + 1e-8))
    most = F.array_max(F.transform(F.filter(tok, lambda x: x["mask"] == 1), f))
    return inside(F.coalesce(most, F.lit(0.0)))


def rejection_mask(seqs: DataFrame, options: dict[str, str | float]) -> DataFrame:
    """seqs with tok.mask set to 0 where any of the options rejects; the old mask stays as tok.mask_before."""
    keeps = [rejection_keep(o, t) for o, t in options.items()]
    rows = [k for k in keeps if isinstance(k, Column)]
    df = seqs.withColumn("_row", F.lit(True))
    for k in rows:
        df = df.withColumn("_row", F.col("_row") & k)

    def one(x):
        keep = F.col("_row")
        for k in keeps:
            if not isinstance(k, Column):
                keep = keep & k(x)
        return x.withField("mask_before", x["mask"]).withField("mask", F.when(keep, x["mask"]).otherwise(0))

    return df.withColumn("tok", F.transform("tok", one)).drop("_row")


def rejection_metrics(seqs: DataFrame, options: dict[str, str | float]) -> DataFrame:
    """One row: masked_fraction of valid tokens, seq_masked_fraction of all sequences."""
    df = rejection_mask(seqs, options).select(total("tok", lambda x: x["mask_before"]).alias("n"), total("tok", lambda x: x["mask"]).alias("k"))
    return df.agg((F.sum(F.col("n") - F.col("k")) / (F.sum("n") + 1e-8)).alias("masked_fraction"), F.avg(_flag(F.col("k") < F.col("n"))).alias("seq_masked_fraction"))


def importance_weights(seqs: DataFrame, level: str = "token", threshold: str | float = 2.0, normalize: bool = False) -> DataFrame:
    """seqs with tok.raw_weight and tok.weight: exp of the clamped log ratio, truncated, or 0 outside a band."""
    low, high = parse_is_threshold(threshold)
    if level not in ("token", "sequence"):
        raise ValueError(f"unknown level {level!r}")
    df = seqs.withColumn("_sum", masked("tok", _log_ratio))
    raw = lambda x: F.exp(clamp(_log_ratio(x) if level == "token" else F.col("_sum"), -BOUND, BOUND)) * x["mask"]
    cut = lambda w: F.least(w, F.lit(high)) if low is None else F.when((w >= low) & (w <= high), w).otherwise(0.0)
    df = df.withColumn("tok", F.transform("tok", lambda x: x.withField("raw_weight", raw(x)))).withColumn("tok", F.transform("tok", lambda x: x.withField("weight", cut(x["raw_weight"]))))
    if normalize:
        w = masked("tok", lambda x: x["weight"])
        if level == "token":
            mean = df.select(w.alias("w"), valid("tok").alias("m")).agg((F.sum("w") / (F.sum("m") + 1e-8)).alias("_f"))
        else:
            mean = df.select((w / (valid("tok") + 1e-8)).alias("w"), valid("tok").alias("m")).where("m > 0").agg(F.avg("w").alias("_f"))
        df = df.join(F.broadcast(mean)).withColumn("_f", F.when(F.col("_f") > 1e-8, F.col("_f")).otherwise(1.0)).withColumn("tok", F.transform("tok", lambda x: x.withField("weight", x["weight"] / F.col("_f")))).drop("_f")
    return df.drop("_sum")


def importance_metrics(seqs: DataFrame, threshold: float = 2.0) -> DataFrame:
    """One row over tok.weight and tok.raw_weight: mean, shares beyond the bounds, deviation, effective sample share."""
    low = 1.0 / threshold
    c = lambda x: clamp(x["weight"], 0.0, threshold)
    df = seqs.select(valid("tok").alias("m"), masked("tok", lambda x: x["weight"]).alias("w"), masked("tok", c).alias("c"), masked("tok", lambda x: c(x) * c(x)).alias("q"), masked("tok", lambda x: _flag(x["raw_weight"] > threshold)).alias("u"), masked("tok", lambda x: _flag(x["raw_weight"] < low)).alias("d"))
    n = F.sum("m") + 1e-8
    mean, square = F.sum("c") / n, F.sum("q") / n
    return df.agg((F.sum("w") / n).alias("is_mean"), (F.sum("u") / n).alias("fraction_high"), (F.sum("d") / n).alias("fraction_low"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("is_std"), (1.0 / (square / ((mean + 1e-8) * (mean + 1e-8)))).alias("effective_sample_size"), F.avg(F.col("w") / (F.col("m") + 1e-8)).alias("seq_mean"), F.max(F.col("w") / (F.col("m") + 1e-8)).alias("seq_max"))


def offpolicy_metrics(seqs: DataFrame) -> DataFrame:
    """One row: perplexities of training and rollout policy, KL terms, chi-square at token and sequence level."""
    m = valid("tok")
    mean = lambda f: masked("tok", f) / (m + 1e-8)
    r = lambda x: F.exp(clamp(_log_ratio(x), -BOUND, BOUND))
    df = seqs.select(
        m.alias("m"), mean(lambda x: x["old_logp"]).alias("t"), mean(lambda x: x["rollout_logp"]).alias("o"), masked("tok", lambda x: -_log_ratio(x)).alias("kl"),
        masked("tok", lambda x: F.exp(_log_ratio(x)) - _log_ratio(x) - 1).alias("k3"), masked("tok", lambda x: r(x) * r(x)).alias("c"), F.exp(2.0 * clamp(masked("tok", _log_ratio), -BOUND, BOUND)).alias("s"),
    )
    n = F.sum("m") + 1e-8
    d = F.col("o") - F.col("t")
    return df.agg(
        F.avg(F.exp(-F.col("t"))).alias("training_ppl"), F.avg(-F.col("t")).alias("training_log_ppl"), (F.sum("kl") / n).alias("kl"), (F.sum("k3") / n).alias("k3_kl"), F.avg(F.exp(-F.col("o"))).alias("rollout_ppl"), F.avg(-F.col("o")).alias("rollout_log_ppl"),
        F.avg(d).alias("log_ppl_diff"), F.avg(F.abs(d)).alias("log_ppl_abs_diff"), F.max(d).alias("log_ppl_diff_max"), F.min(d).alias("log_ppl_diff_min"), F.avg(F.exp(d)).alias("ppl_ratio"), (F.sum("c") / n - 1).alias("chi2_token"), (F.avg("s") - 1).alias("chi2_seq"),
    )


# Arrays -------------------------------------------------------------------------------------------------------------


def first_eos_mask(ids: Column, eos: list[int]) -> Column:
    """1 up to and including the first end id, 0 after it."""
    at = F.array_min(F.filter(F.transform(F.array(*[F.lit(e) for e in eos]), lambda e: F.array_position(ids, e)), lambda p: p > 0))
    return F.transform(ids, lambda x, i: F.when(at.isNull() | (i < at), 1).otherwise(0))


def pad(a: Column, n: int, value: Column, left: bool = False) -> Column:
    """a filled up to n elements."""
    fill = F.array_repeat(value, F.greatest(F.lit(n) - F.size(a), F.lit(0)))
    return F.concat(fill, a) if left else F.concat(a, fill)


def fit_length(a: Column, n: int, value: Column, left_pad: bool = True, truncation: str = "error") -> Column:
    """a padded or truncated to n elements; truncation: left, right, middle or error."""
    cut = {
        "left": lambda: F.slice(a, F.size(a) - n + 1, F.lit(n)),
        "right": lambda: F.slice(a, 1, n),
        "middle": lambda: F.concat(F.slice(a, 1, n // 2), F.slice(a, F.size(a) - (n - n // 2) + 1, F.lit(n - n // 2))),
        "error": lambda: F.raise_error(F.concat(F.lit("a sequence is longer than "), F.lit(str(n)))).cast("array<bigint>"),
    }[truncation]()
    return F.when(F.size(a) > n, cut).otherwise(pad(a, n, value, left_pad))


def drop_masked(a: Column, mask: Column) -> Column:
    """The elements of a whose mask is 1."""
    return F.transform(F.filter(F.arrays_zip(a.alias("v"), mask.alias("m")), lambda z: z["m"] == 1), lambda z: z["v"])


def last_token_scatter(n_valid: Column, score: Column, size: Column) -> Column:
    """An array of zeros with the score at the last valid place."""
    return F.transform(F.sequence(F.lit(1), size), lambda i: F.when(i == n_valid, score).otherwise(0.0))


def overlong_penalty(n: Column, limit: int, buffer: int, factor: float) -> Column:
    """0, or less the further n gets into the last `buffer` tokens before the limit and beyond."""
    return F.least(-(n - (limit - buffer)) / buffer * factor, F.lit(0.0))
