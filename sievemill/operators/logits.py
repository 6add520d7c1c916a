"""Scalars of arrays of logits, and distillation losses over a teacher's top-k tokens.

A token is a row with the student's logits (array<double>, by token id from 0) and the teacher's top-k ids and
log-probabilities. Everything is a higher-order function within the row; only sums enter an aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import Registry
from . import tokens as T

DISTILLATION = Registry("distillation loss")
#: Fixed value: the least log-probability of a reverse KL's distributions where none is given.
LEAST_LOG_PROB = -20.0


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def log_sum_exp(z: Column) -> Column:
    return let(F.array_max(z), lambda m: m + F.log(total(F.transform(z, lambda x: F.exp(x - m)))))


def log_softmax(z: Column) -> Column:
    return let(log_sum_exp(z), lambda l: F.transform(z, lambda x: x - l))


def pick(a: Column, index: Column) -> Column:
    """The element at an index from 0; null beyond the end."""
    return F.get(a, index)


def label_log_prob(z: Column, label: Column) -> Column:
    return pick(z, label) - log_sum_exp(z)


def entropy(z: Column) -> Column:
    """Log-sum-exp less the mean of the logits under their softmax."""
    return let(log_sum_exp(z), lambda l: l - total(F.transform(z, lambda x: F.exp(x - l) * x)))


def sum_pi_squared(z: Column) -> Column:
    return let(log_sum_exp(z), lambda l: total(F.transform(z, lambda x: F.exp(2 * (x - l)))))


def top_ids(z: Column, k: int) -> Column:
    """Ids of the k largest, largest first; of equal ones the smaller id."""
    order = F.array_sort(F.transform(z, lambda x, i: F.struct((-x).alias("v"), i.cast("long").alias("i"))))
    return F.transform(F.slice(order, 1, k), lambda s: s["i"])


def kl_divergence(log_q: Column, log_p: Column) -> Column:
    """Sum of p (log p - log q)."""
    return total(F.zip_with(log_p, log_q, lambda p, q: F.exp(p) * (p - q)))


def _overlap(terms: Column, ids: Column, own: Column) -> tuple[Column, Column]:
    """(how many ids both have, the mean of the negated terms at those)."""
    common = F.zip_with(ids, terms, lambda i, t: F.struct(F.array_contains(own, i).alias("in"), t.alias("t")))
    count = F.size(F.filter(common, lambda s: s["in"]))
    return count, -total(F.transform(F.filter(common, lambda s: s["in"]), lambda s: s["t"])) / F.greatest(count, F.lit(1))


def _topk(df: DataFrame, student: str, ids: str, log_probs: str, k: int) -> DataFrame:
    """df with the student's log-probabilities at the teacher's ids, its own top ids, and both masses."""
    own = df.withColumn("_s", log_softmax(F.col(student)))
    own = own.withColumn("_own", top_ids(F.col("_s"), k)).withColumn("_q", F.transform(ids, lambda i: F.get(F.col("_s"), i.cast("int"))))
    mass = lambda c: total(F.transform(c, F.exp))
    return own.withColumn("student_mass", mass(F.col("_q"))).withColumn("teacher_mass", mass(F.col(log_probs)))


def _done(df: DataFrame, loss: Column, terms: Column, ids: str) -> DataFrame:
    count, gain = _overlap(terms, F.col(ids), F.col("_own"))
    return df.withColumns({"loss": loss, "overlap_count": count, "overlap_token_advantage": gain})


@DISTILLATION.register("forward_kl_topk")
def forward_kl_topk(df: DataFrame, k: int, student: str = "logits", ids: str = "teacher_ids", log_probs: str = "teacher_logp", least: float | None = None) -> DataFrame:
    """df with loss, masses and overlap: KL of teacher to student over the teacher's top-k ids."""
    df = _topk(df, student, ids, log_probs, k)
    cut = (lambda c: F.transform(c, lambda x: F.greatest(x, F.lit(least)))) if least is not None else (lambda c: c)
    df = df.withColumn("_q", cut(F.col("_q"))).withColumn("_p", cut(F.col(log_probs)))
    terms = F.zip_with("_p", "_q", lambda p, q: F.exp(p) * (p - q))
    return _done(df, kl_divergence(F.col("_q"), F.col("_p")), terms, ids).drop("_s", "_own", "_q", "_p")


@DISTILLATION.register("reverse_kl_topk")
def reverse_kl_topk(df: DataFrame, k: int, student: str = "logits", ids: str = "teacher_ids", log_probs: str = "teacher_logp", least: float | None = None) -> DataFrame:
    """df with loss, masses and overlap: KL of student to teacher over the teacher's top-k ids and one place for all others."""
    df = _topk(df, student, ids, log_probs, k)
    floor = F.exp(F.lit(LEAST_LOG_PROB if least is None else least))

    def spread(probs: Column, mass: Column) -> Column:
        whole = F.concat(F.transform(probs, lambda x: F.greatest(x, floor)), F.array(F.greatest(1.0 - mass, floor)))
        return let(whole, lambda w: F.transform(w, lambda x: x / total(w)))

    df = df.withColumn("_a", spread(F.transform("_q", F.exp), F.col("student_mass"))).withColumn("_b", spread(F.transform(log_probs, F.exp), F.col("teacher_mass")))
    df = df.withColumn("_t", F.zip_with("_a", "_b", lambda a, b: a * (F.log(a) - F.log(b))))
    return _done(df, total(F.col("_t")), F.slice("_t", 1, k), ids).drop("_s", "_own", "_q", "_a", "_b", "_t")


def distillation_metrics(df: DataFrame, k: int, mask: str = "mask") -> DataFrame:
    """One row over the valid tokens of a top-k loss: means and bounds of the masses, overlap, bounds of the loss."""
    some = F.col("overlap_count") > 0
    stats = [f(c).alias(f"{c}{tail}") for c in ("student_mass", "teacher_mass") for f, tail in ((F.avg, ""), (F.min, "_min"), (F.max, "_max"))]
    return df.where(F.col(mask) == 1).agg(
        *stats, (F.avg("overlap_count") / k).alias("overlap_ratio"), F.coalesce(F.avg(F.when(some, F.col("overlap_token_advantage"))), F.lit(0.0)).alias("overlap_token_advantage"), F.min("loss").alias("loss_min"), F.max("loss").alias("loss_max")
    )


def estimator_loss(df: DataFrame, kind: str = "k3", student: str = "logp", teacher: str = "teacher_logp") -> DataFrame:
    """df with loss: a sampled KL term between the student's and the teacher's log-probability of the token."""
    return df.withColumn("loss", T.kl_forward(F.col(student), F.col(teacher), kind))


def distillation_loss(df: DataFrame, clamp: float | None = None, floor: bool = False, mask: str = "mask") -> DataFrame:
    """One row: the mean of loss over the valid tokens, after a floor of 0 (top-k losses) and a clamp to both sides."""
    x = F.greatest(F.col("loss"), F.lit(0.0)) if floor else F.col("loss")
    x = T.clamp(x, None if clamp is None else -clamp, clamp)
    return df.where(F.col(mask) == 1).agg(F.avg(x).alias("loss"), F.avg(F.abs("loss")).alias("abs_loss"))


def teacher_of(key: Column, teachers: list[str]) -> Column:
    """The teacher that a sample's key names; with one teacher that one, whatever the key; an unknown or missing key fails the query."""
    if len(teachers) == 1:
        return F.lit(teachers[0])
    known = F.concat(F.lit(f"no teacher (of {', '.join(sorted(teachers))}) for key "), F.coalesce(key, F.lit("null")))
    return F.when(key.isin(teachers), key).otherwise(F.raise_error(known).cast("string"))
