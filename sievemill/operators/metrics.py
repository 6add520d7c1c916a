"""Training and validation metrics: each reads its input once and aggregates map-side before it shuffles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from . import tokens as T

#: Drawn values that a task holds at once.
CELLS = 1 << 18


def spread(c: Column, name: str) -> list[Column]:
    return [F.avg(c).alias(f"{name}_mean"), F.max(c).alias(f"{name}_max"), F.min(c).alias(f"{name}_min")]


def unmasked(tok: str) -> Column:
    return F.filter(tok, lambda x: x["mask"] > 0)


def data_metrics(seqs: DataFrame, max_length: int) -> DataFrame:
    """One row over a batch of sequences: spreads of scores, advantages and values, explained variance, lengths, clip and abort ratios.

    Token spreads are over unmasked tokens; returns are advantage + value. Sequences are reduced to their sums within the
    row, so tokens are never shuffled.
    """
    per = seqs.select(T.total("tok", lambda x: x["reward"]).alias("score"), T.total("tok", lambda x: x["mask"]).alias("n"), unmasked("tok").alias("tok"))
    low = lambda f: F.array_min(F.transform("tok", f))
    high = lambda f: F.array_max(F.transform("tok", f))
    adv, val, gap = (lambda x: x["adv"]), (lambda x: x["value"]), (lambda x: x["adv"] + x["value"])
    add = lambda f: F.sum(T.total("tok", f))
    size = F.sum("n")
    var = lambda f: (add(lambda x: f(x) * f(x)) - add(f) * add(f) / size) / (size - 1)
    return per.agg(
        *spread(F.col("score"), "score"),
        (add(adv) / size).alias("adv_mean"), F.max(high(adv)).alias("adv_max"), F.min(low(adv)).alias("adv_min"),
        (add(val) / size).alias("value_mean"), F.max(high(val)).alias("value_max"), F.min(low(val)).alias("value_min"),
        (1 - var(adv) / (var(gap) + 1e-5)).alias("explained_variance"),
        *spread(F.col("n"), "length"),
        F.avg((F.col("n") >= max_length).cast("int")).alias("clip_ratio"), F.avg((F.col("n") == 0).cast("int")).alias("abort_ratio"),
    )


def finite(text: Column) -> Column:
    """A number, or null for text, NaN and infinities."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def reward_extra_metrics(df: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """The mean of each name's finite numbers; names without any have no row."""
    return df.select(name, finite(F.col(value)).alias("_x")).where("_x IS NOT NULL").groupBy(name).agg(F.avg("_x").alias("mean"))


def throughput(seqs: DataFrame, seconds: float, devices: int) -> DataFrame:
    n = F.sum(F.size("tok"))
    return seqs.agg(n.alias("tokens"), F.lit(float(seconds)).alias("seconds"), (n / (seconds * devices)).alias("tokens_per_device_second"))


def timings(seqs: DataFrame, seconds: dict[str, float]) -> DataFrame:
    """A row a phase: seconds, and milliseconds a token; `gen` counts unmasked tokens only, other phases all."""
    totals = seqs.agg(F.sum(F.size("tok")).alias("_all"), F.sum(T.total("tok", lambda x: x["mask"])).alias("_own"))
    phases = F.explode(F.array(*[F.struct(F.lit(k).alias("phase"), F.lit(float(v)).alias("seconds")) for k, v in sorted(seconds.items())]))
    out = totals.select("*", phases.alias("p")).select("_all", "_own", "p.*")
    return out.select("phase", "seconds", (F.col("seconds") * 1000 / F.when(F.col("phase") == "gen", F.col("_own")).otherwise(F.col("_all"))).alias("ms_per_token"))


def debug_probabilities(seqs: DataFrame) -> DataFrame:
    """Difference of rollout and trainer probabilities over unmasked tokens: maximum, mean, sample deviation, correlation; nulls if there are none."""
    p = seqs.select(F.explode(unmasked("tok")).alias("x")).select(F.exp("x.old_logp").alias("p"), F.exp("x.rollout_logp").alias("q"))
    gap = F.abs(F.col("p") - F.col("q"))
    return p.agg((F.count("*") > 0).cast("int").alias("valid"), F.max(gap).alias("diff_max"), F.avg(gap).alias("diff_mean"), F.stddev_samp(gap).alias("diff_std"), F.corr("p", "q").alias("pearson"))


def variance_proxies(seqs: DataFrame, gradient_norm: float) -> DataFrame:
    """Signal, power and noise of a gradient from advantages A and W = 1 - 2p + sum of p squared, summed over a row's unmasked tokens."""
    m = T.total("tok", lambda x: x["mask"])
    a = T.total("tok", lambda x: x["adv"] * x["mask"]) / (m + 1e-8)
    w = T.total("tok", lambda x: (1 - 2 * F.exp(x["logp"]) + x["sum_pi_sq"]) * x["mask"])
    per = seqs.select(a.alias("a"), w.alias("w"))
    power = F.avg(F.col("a") * F.col("a") * F.greatest("w", F.lit(0.0)))
    signal = F.lit(float(gradient_norm) ** 2)
    noise = F.when(F.count("*") > 1, F.greatest(F.lit(0.0), (power - signal) / (F.count("*") - 1))).otherwise(0.0)
    return per.agg(signal.alias("signal"), power.alias("power"), noise.alias("noise"), F.avg(F.col("a") * F.col("a")).alias("a_squared"), F.avg("w").alias("w"))


def slow_ratio(df: DataFrame, seconds: str, k: float) -> DataFrame:
    """Of timings, the share above the (1 - k) quantile, with minimum and maximum."""
    q = df.agg(F.percentile(seconds, F.lit(1 - k)).alias("_q"), F.min(seconds).alias("min"), F.max(seconds).alias("max"))
    return df.join(F.broadcast(q)).groupBy("min", "max").agg(F.avg((F.col(seconds) > F.col("_q")).cast("int")).alias("ratio"))


def mean_ratio(top: Column, bottom: Column) -> Column:
    """Mean of row ratios; one with a denominator of 0 counts as 0."""
    return F.avg(F.when(bottom > 0, top / bottom).otherwise(0.0))


def reduce_by_name(df: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """A name holding "max" takes its maximum, else one holding "min" its minimum, any other its mean."""
    out = F.when(F.col(name).contains("max"), F.max(value)).when(F.col(name).contains("min"), F.min(value)).otherwise(F.avg(value))
    return df.groupBy(name).agg(out.alias("value"))


def powers(n: int) -> list[int]:
    """1, 2, 4, ... below n, then n."""
    return [1 << i for i in range(max(n - 1, 0).bit_length())] + ([n] if n else [])


def pass_at_k(df: DataFrame, ks: list[int], group: str | list[str], by: str | list[str] | None = None, full: int | None = None, **hits: Column) -> DataFrame:
    """For each k, the share of groups with a hit among their first k rows (numbered by `n` from 1).

    by: columns, constant within a group, to report apart. full: only groups of exactly so many rows count. The first hit
    of a group decides for all k, so groups are aggregated once whatever the number of ks.
    """
    by = [by] if isinstance(by, str) else by or []
    group = [group] if isinstance(group, str) else group
    first = df.groupBy(*dict.fromkeys([*by, *group])).agg(F.count("*").alias("_n"), *[F.min(F.when(c, F.col("n"))).alias(k) for k, c in hits.items()])
    if full is not None:
        first = first.where(F.col("_n") == full)
    rows = first.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    return rows.groupBy(*by, "k").agg(F.count("*").alias("groups"), *[F.avg(F.coalesce((F.col(h) <= F.col("k")).cast("int"), F.lit(0))).alias(h) for h in hits])


def majority(df: DataFrame, group: list[str], vote: str, value: str, order: str = "n") -> DataFrame:
    """The first value of each group's commonest vote; of equally common votes the one seen first."""
    votes = df.groupBy(*group, vote).agg(F.count("*").alias("votes"), F.min(F.struct(order, value)).alias("_first"))
    best = votes.groupBy(*group).agg(F.max(F.struct(F.col("votes"), (-F.col(f"_first.{order}")).alias("o"), F.col(f"_first.{value}").alias("v"), F.col(vote).alias("p"))).alias("b"))
    return best.select(*group, F.col("b.p").alias(vote), F.col("b.v").alias(value), "b.votes")


@cache
def drawn_positions(n: int, subset: int, draws: int, seed: int) -> np.ndarray:
    """draws x subset positions among n responses, the same for every group of n."""
    return np.random.RandomState(seed).choice(n, size=(draws, subset), replace=True)


def resampled(values: np.ndarray, null: np.ndarray, votes: np.ndarray | None, subset: int, draws: int, seed: int) -> list[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, mean, deviation, whether a draw has no value) of the draws of groups of one size, a row each; null values are passed over.

    votes: the position at which a row's vote is first seen. NaN is more than any number.
    """
    groups, n = values.shape
    at = drawn_positions(n, subset, draws, seed)
    got = values[:, at]
    if null.any():
        gone = null[:, at]
        none = gone.all(-1)
        kinds = {"best": (np.where(gone, -np.inf, got).max(-1), none), "worst": (np.fmin.reduce(np.where(gone, np.nan, got), axis=-1), none)}
    else:
        gone = none = np.zeros((groups, 1, 1), bool)
        kinds = {"best": (got.max(-1), none), "worst": (np.fmin.reduce(got, axis=-1), none)}
    if votes is not None:
        said = votes[:, at].reshape(-1, subset)
        rows = np.arange(len(said))
        counts = np.bincount((rows[:, None] * n + said).ravel(), minlength=len(said) * n).reshape(-1, n)
        first = np.take_along_axis(counts, said, 1).argmax(1)
        taken = lambda x: x.reshape(-1, subset)[rows, first].reshape(groups, draws)
        kinds["maj"] = taken(got), taken(gone) if null.any() else none
    return [(k, x.mean(1), x.std(1), void.reshape(groups, -1).any(1)) for k, (x, void) in kinds.items()]


def validation_metrics(df: DataFrame, key: list[str], value: str = "value", vote: str | None = None, draws: int = 1000, seed: int = 42, order: str = "n") -> DataFrame:
    """source, metric, value: means over prompts of mean@N, std@N and resampled best@n, worst@n and maj@n, mean and deviation.

    key: the source, then the prompt. Deviations are over the population. Drawn positions depend only on the size of a group, so a task
    draws them once for each size and takes many groups at once; the draws multiply no rows and stay in the task. A group's
    responses are one row: responses of one prompt, never a corpus.
    """
    ship(df.sparkSession)
    names = [order, value] + ([vote] if vote else [])
    groups = df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("rows")).withColumn("n_resp", F.size("rows"))
    groups = groups.withColumn("values", F.transform("rows", lambda x: x[value].cast("double")))
    if vote:  # a vote as the position at which it is first seen
        cast = F.transform("rows", lambda x: F.coalesce(x[vote].cast("string"), F.lit("\0")))
        groups = groups.withColumn("votes", F.transform(cast, lambda x: F.array_position(cast, x) - 1))
    v = F.col("values")
    source = df.schema[key[0]].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(1).to_numpy()
            for n in np.unique(size):
                block = max(1, CELLS // (draws * int(n)))
                rows = np.flatnonzero(size == n)
                for some in (rows[i : i + block] for i in range(0, len(rows), block)):
                    part = batch.take(pa.array(some))
                    flat = part.column(2).flatten()
                    values, null = flat.to_numpy(zero_copy_only=False).reshape(-1, n), flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, n)
                    votes = part.column(3).flatten().to_numpy().reshape(-1, n) if vote else None
                    for subset in powers(int(n))[1:]:
                        for kind, mean, std, void in resampled(values, null, votes, subset, draws, seed):
                            for tail, x in (("mean", mean), ("std", std)):
                                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f"{kind}@{subset}/{tail}"] * len(x), pa.string()), pa.array(x, mask=void)], names=[key[0], "metric", "value"])

    avg = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)

    def std(a: Column) -> Column:
        """One pass, about the first value, so that close values do not cancel."""
        sums = F.aggregate(a, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda t, x: F.struct((t["s"] + x - F.get(a, 0)).alias("s"), (t["q"] + (x - F.get(a, 0)) * (x - F.get(a, 0))).alias("q")), lambda t: t["q"] / F.size(a) - t["s"] * t["s"] / F.size(a) / F.size(a))
        return F.sqrt(F.greatest(sums, F.lit(0.0)))

    entry = lambda label, x: F.struct(label.alias("metric"), x.alias("value"))
    at = lambda kind, n: F.concat(F.lit(f"{kind}@"), n.cast("string"))
    plain = groups.select(key[0], F.explode(F.array(entry(at("mean", F.col("n_resp")), avg(v)), entry(at("std", F.col("n_resp")), F.when(F.col("n_resp") > 1, std(v))))).alias("m")).select(key[0], "m.*")
    # A number of its own, since adaptive execution would put the few bytes of much work into one task.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    able = groups.where("n_resp > 1").repartition(tasks, F.xxhash64(*key)).select(key[0], "n_resp", "values", *(["votes"] if vote else []))
    boot = able.mapInArrow(run, f"{key[0]} {source}, metric string, value double")
    return plain.unionByName(boot).where("value IS NOT NULL").groupBy(key[0], "metric").agg(F.avg("value").alias("value"))


def core_or_aux(df: DataFrame, core: str) -> DataFrame:
    """A section for each metric of validation_metrics: val-core for mean, best and maj of the core variable at its largest n, else val-aux."""
    n = F.regexp_extract("metric", "@([0-9]+)", 1).cast("int")
    top = F.max(n).over(Window.partitionBy("source", "variable"))
    is_core = (F.col("variable") == core) & (n == top) & F.col("metric").rlike("^(mean|maj|best)@")
    return df.withColumn("section", F.when(is_core, "val-core").otherwise("val-aux"))
