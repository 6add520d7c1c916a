"""Group-relative advantage estimators: DataFrame of trajectories (uid, score, ...) -> the same with `advantage`.

Group statistics are aggregated before they are joined back, so that a prompt with very many responses costs a partial
aggregation and a join that adaptive execution can split, not one window in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import ESTIMATORS

EPS = 1e-6


def with_group(df: DataFrame, key: str | list[str], *aggs: Column) -> DataFrame:
    """df with aggregates of each group as further columns."""
    return df.join(df.groupBy(key).agg(*aggs), key)


def group_mean_std(df: DataFrame, score: str = "score", uid: str = "uid") -> DataFrame:
    """group_mean, group_std (sample), group_n; a group of one has mean 0 and deviation 1."""
    df = with_group(df, uid, F.avg(score).alias("_m"), F.stddev_samp(score).alias("_s"), F.count(F.lit(1)).alias("group_n"))
    alone = F.col("group_n") == 1
    return df.withColumns({"group_mean": F.when(alone, 0.0).otherwise(F.col("_m")), "group_std": F.when(alone, 1.0).otherwise(F.col("_s"))}).drop("_m", "_s")


_STATS = ("group_mean", "group_std", "group_n")


@ESTIMATORS.register("grpo", "grpo_vectorized")
def grpo(df: DataFrame, score: str = "score", by_std: bool = True, epsilon: float = EPS) -> DataFrame:
    """(score - mean) / (std + epsilon); without by_std only centred."""
    centred = F.col(score) - F.col("group_mean")
    return group_mean_std(df, score).withColumn("advantage", centred / (F.col("group_std") + epsilon) if by_std else centred).drop(*_STATS)


@ESTIMATORS.register()
def rloo(df: DataFrame, score: str = "score", alone: str = "keep") -> DataFrame:
    """Leave-one-out; a single response keeps its score (alone="keep") or has 0 (alone="zero")."""
    n = F.col("_n")
    loo = n / (n - 1) * (F.col(score) - F.col("_m"))
    return with_group(df, "uid", F.avg(score).alias("_m"), F.count(F.lit(1)).alias("_n")).withColumn("advantage", F.when(n > 1, loo).otherwise(F.col(score) if alone == "keep" else F.lit(0.0))).drop("_m", "_n")


@ESTIMATORS.register()
def rloo_vectorized(df: DataFrame, score: str = "score") -> DataFrame:
    return rloo(df, score, alone="zero")


@ESTIMATORS.register()
def opo(df: DataFrame, score: str = "score", length: str = "len") -> DataFrame:
    """Minus the length-weighted mean of the group; a single response has baseline 0."""
    w = F.sum(F.col(score) * F.col(length)) / F.sum(length)
    return with_group(df, "uid", w.alias("_b"), F.count(F.lit(1)).alias("_n")).withColumn("advantage", F.col(score) - F.when(F.col("_n") > 1, F.col("_b")).otherwise(0.0)).drop("_b", "_n")


def with_totals(df: DataFrame, *aggs: Column) -> DataFrame:
    """df with aggregates over all rows as further columns; the one row of totals is all that is broadcast."""
    return df.join(F.broadcast(df.agg(*aggs)))


@ESTIMATORS.register()
def gpg(df: DataFrame, score: str = "score", f_norm: float = 1.0) -> DataFrame:
    """Centred, times rows over rows with a score that is not 0."""
    totals = with_totals(df, F.count(F.lit(1)).alias("_all"), F.greatest(F.count_if(F.col(score) != 0), F.lit(1)).alias("_some"))
    return group_mean_std(totals, score).withColumn("advantage", F.col("_all") / F.col("_some") * (F.col(score) - F.col("group_mean")) / f_norm).drop("_all", "_some", *_STATS)


@ESTIMATORS.register("grpo_passk", "passk")
def grpo_passk(df: DataFrame, score: str = "score", order: str = "traj_id", by_std: bool = True, epsilon: float = EPS, strict: bool = True) -> DataFrame:
    """Only the best response of a group has an advantage: its lead over the second, over the deviation.

    Ties go to the first by `order`. A group of one is an error, or with strict=False has advantage 0.
    """
    best = F.min(F.struct((-F.col(score)).alias("s"), F.col(order).alias("o"))).alias("_best")
    df = with_group(df, "uid", best, F.stddev_samp(score).alias("_s"), F.count(F.lit(1)).alias("_n"))
    second = df.where(F.col(order) != F.col("_best.o")).groupBy("uid").agg(F.max(score).alias("_second"))
    df = df.join(second, "uid", "left")
    if strict:
        df = df.withColumn("_n", F.when(F.col("_n") >= 2, F.col("_n")).otherwise(F.raise_error("a group has fewer than two responses").cast("long")))
    lead = F.col(score) - F.col("_second")
    return df.withColumn("advantage", F.when((F.col(order) == F.col("_best.o")) & (F.col("_n") >= 2), lead / (F.col("_s") + epsilon) if by_std else lead).otherwise(0.0)).drop("_best", "_s", "_n", "_second")


def whiten(df: DataFrame, value: str, weight: str, out: str) -> DataFrame:
    """value standardised over weight (how many valid tokens carry it), with the reference formulas for masked moments.

    mean = sum / (n + 1e-8); var = mean of squared deviations * n / (n - 1); times rsqrt(var + 1e-8). n below 2 is an error.
    """
    v, w = F.col(value), F.col(weight)
    df = with_totals(df, F.sum(v * w).alias("_v"), F.sum(w).alias("_w"))
    df = df.withColumn("_m", F.col("_v") / (F.col("_w") + 1e-8))
    df = with_totals(df, F.sum((v - F.col("_m")) * (v - F.col("_m")) * w).alias("_q"))
    n = F.when(F.col("_w") > 1, F.col("_w")).otherwise(F.raise_error("whitening needs two valid tokens").cast("double"))
    var = F.col("_q") / (n + 1e-8) * n / (n - 1)
    return df.withColumn(out, (v - F.col("_m")) / F.sqrt(var + 1e-8)).drop("_v", "_w", "_m", "_q")


@ESTIMATORS.register("reinforce_plus_plus_baseline")
def reinforce_pp_baseline(df: DataFrame, score: str = "score", length: str = "len") -> DataFrame:
    """Centred in the group, then whitened over all valid tokens."""
    return whiten(group_mean_std(df, score).withColumn("_c", F.col(score) - F.col("group_mean")), "_c", length, "advantage").drop("_c", *_STATS)


@ESTIMATORS.register()
def gdpo(df: DataFrame, scores: tuple[str, ...] = ("score", "score2"), weights: tuple[float, ...] | None = None, length: str = "len", epsilon: float = EPS) -> DataFrame:
    """Each reward normalised in its group, their weighted sum whitened over all valid tokens."""
    total = F.lit(0.0)
    for k, s in enumerate(scores):
        df = grpo(df, s, epsilon=epsilon).withColumnRenamed("advantage", f"_a{k}")
        total = total + (weights[k] if weights else 1.0) * F.col(f"_a{k}")
    return whiten(df.withColumn("_sum", total), "_sum", length, "advantage").drop("_sum", *[f"_a{k}" for k in range(len(scores))])


def session_final(df: DataFrame, estimator: str = "grpo", **options) -> DataFrame:
    """Advantage of the last trajectory of each (uid, session), given to all trajectories of the session."""
    last = df.groupBy("uid", "session").agg(F.max_by(F.struct(*[c for c in df.columns if c not in ("uid", "session")]), "traj_id").alias("_l")).select("uid", "session", "_l.*")
    done = ESTIMATORS.get(estimator)(last, **options).select("uid", "session", "advantage")
    return df.join(done, ["uid", "session"])


def optimal_token_baseline(tokens: DataFrame, compact: bool = False, zero_tail: bool = True, epsilon: float = 1e-8, weight: str | None = None) -> DataFrame:
    """Tokens (uid, traj_id, t, mask, reward, old_logp, sum_pi_sq) -> with `ret` and `advantage`.

    The baseline of a step is the mean return of the group's trajectories at that step, weighted by the cumulative
    variance proxy 1 - 2 pi + sum pi^2. Steps are token numbers, or with compact=True numbers among valid tokens. A single trajectory
    has baseline 0; so have the steps of a strictly longest one beyond the second longest (zero_tail).
    """
    c = F.col
    back = Window.partitionBy("traj_id").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("traj_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    w = 1 - 2 * F.exp(c("old_logp")) + c("sum_pi_sq")
    if weight:
        w = w * c(weight) * c(weight)
    df = tokens.withColumns({"ret": F.sum(c("reward") * c("mask")).over(back), "_w": F.sum(w * c("mask")).over(ahead), "_step": F.sum("mask").over(ahead) if compact else c("t")})
    valid = df.where("mask = 1")
    base = valid.groupBy("uid", "_step").agg((F.sum(c("ret") * c("_w")) / (F.sum("_w") + epsilon)).alias("_b"))
    sizes = df.groupBy("uid", "traj_id").agg(F.sum("mask").alias("_len"))
    if compact:
        sizes = sizes.where("_len > 0")
    top = sizes.groupBy("uid").agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("_len", "traj_id")).alias("_first"))
    second = sizes.join(top, "uid").where(c("traj_id") != c("_first.traj_id")).groupBy("uid").agg(F.max("_len").alias("_second"))
    df = df.join(base, ["uid", "_step"], "left").join(top, "uid", "left").join(second, "uid", "left")
    tail = (c("traj_id") == c("_first.traj_id")) & (c("_first._len") > c("_second")) & (c("_step") > c("_second")) if zero_tail else F.lit(False)
    baseline = F.when((c("_n") == 1) | c("_n").isNull() | F.coalesce(tail, F.lit(False)), 0.0).otherwise(F.coalesce(c("_b"), F.lit(0.0)))
    return df.withColumn("advantage", (c("ret") - baseline) * c("mask")).drop("_w", "_step", "_b", "_n", "_first", "_second")


def remax(tokens: DataFrame, baseline: Column) -> DataFrame:
    """Tokens with `ret` (reward to go over valid tokens) and `advantage` (minus the greedy baseline)."""
    back = Window.partitionBy("traj_id").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    df = tokens.withColumn("ret", F.sum(F.col("reward") * F.col("mask")).over(back))
    return df.withColumn("advantage", (F.col("ret") - baseline) * F.col("mask"))


def resample_by_weight(df: DataFrame, method: str = "pow", power: float = 2.0, seed: int = 0, score: str = "score", order: str = "traj_id") -> DataFrame:
    """As many rows as df has, drawn with replacement in proportion to a weight of the score; `draw` numbers them.

    Draws are uniform points, by a hash of seed and order, so that a task that is run again draws the same; each falls in
    the interval of a row in a running sum of the weights. The running sum is taken over buckets of the order first, one
    for a million rows at least, so that no task sees more than its bucket.
    """
    c = F.col
    df = with_totals(df, F.max(score).alias("_hi"), F.min(score).alias("_lo"), F.count(F.lit(1)).alias("_n"))
    weight = {
        "pow": F.pow(F.abs(c(score)), F.lit(power)),
        "max_min": F.when((c(score) == c("_hi")) | (c(score) == c("_lo")), 1.0).otherwise(0.0),
        "max_random": F.when(c(score) == c("_hi"), 0.4).otherwise(0.1),
    }
    if method not in weight:
        raise ValueError(f"unknown reweighting {method!r}")
    buckets = max(256, df.count() // 1_000_000)
    df = df.withColumns({"_w": weight[method] + 1e-8, "_k": F.pmod(F.xxhash64(order), F.lit(buckets))})
    # The running sums of the buckets, of which there are `buckets`, and within each.
    sums = df.groupBy("_k").agg(F.sum("_w").alias("_s"), F.first("_n").alias("_n"))
    run = Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumns({"_to": F.sum("_s").over(run), "_all": F.sum("_s").over(Window.partitionBy())}).withColumn("_from", c("_to") - c("_s"))
    inside = Window.partitionBy("_k").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_hi2", F.sum("_w").over(inside)).withColumn("_lo2", c("_hi2") - c("_w"))
    draws = df.select(c(order).alias("draw"), (F.shiftrightunsigned(F.xxhash64(order, F.lit(seed)), 11) / float(1 << 53)).alias("_u"))
    # The buckets' ends, a number each, as one array: a draw's bucket is the first whose end lies beyond it.
    table = sums.agg(F.max("_all").alias("_all"), F.array_sort(F.collect_list(F.struct("_to", "_from", "_k"))).alias("_b"))
    hit = draws.join(F.broadcast(table)).withColumn("_p", c("_u") * c("_all")).withColumn("_e", F.get("_b", F.least(F.size(F.filter("_b", lambda x: x["_to"] <= c("_p"))), F.size("_b") - 1)))
    hit = hit.select("draw", c("_e._k").alias("_k"), (c("_p") - c("_e._from")).alias("_x"))
    # Within a bucket a draw goes to the row with the largest start that does not exceed it: sorted together, carried forward.
    mixed = rows.select("_k", c("_lo2").alias("_x"), F.lit(None).cast("long").alias("draw"), F.struct(*[x for x in df.columns if not x.startswith("_")]).alias("row")).unionByName(hit.select("_k", "_x", "draw", F.lit(None).alias("row")), allowMissingColumns=True)
    carry = Window.partitionBy("_k").orderBy("_x", F.col("draw").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return mixed.withColumn("row", F.last("row", ignorenulls=True).over(carry)).where("draw is not null").select("draw", "row.*")
