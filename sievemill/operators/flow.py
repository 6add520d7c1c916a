"""The flow of a training run as tables: epochs fed to a budget, windows between weight updates, replay, dumps and corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batch import ROW, with_row_index
from .reports import aggregate_metrics


def feed(rows: DataFrame, total: int) -> DataFrame:
    """The rows (numbered by row_idx) over and over, up to `total`: with epoch, from 0, and place among all."""
    n = rows.count()
    if not n:
        return rows.withColumns({"epoch": F.lit(0), "place": F.col(ROW)})
    each = F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-total // n) - 1))))
    return rows.withColumn("epoch", each).withColumn("place", F.col("epoch") * n + F.col(ROW)).where(F.col("place") < total)


def sync_windows(metrics: DataFrame, every: int) -> DataFrame:
    """version, name, value: metric rows (step, name, value) of the steps between two weight updates as one, by the rule of each name."""
    return aggregate_metrics(metrics.withColumn("version", F.floor(F.col("step") / every)), ["version"])


def replay(rows: DataFrame, keys: list[str], removed: Column, *order: str) -> DataFrame:
    """The last row of each key, without the keys whose last row removes them; combined before the shuffle."""
    last = rows.withColumn("_gone", removed).groupBy(*keys).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("_r"))
    return last.select("_r.*").where(~F.coalesce("_gone", F.lit(False))).drop("_gone")


def rows_of_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among keys; each once."""
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def numbered_corpus(docs: DataFrame, title: str, *ties: str) -> DataFrame:
    """docs with id, from 1, in the order of their folded titles."""
    folded = docs.withColumn("_t", F.lower(F.coalesce(F.col(title), F.lit(""))))
    return with_row_index(folded, "_t", *ties).withColumn("id", F.col(ROW) + 1).drop("_t", ROW)


def collated(rows: DataFrame, batch: str, order: str, stacked: list[str], ragged: list[str]) -> DataFrame:
    """A row for each batch: stacked columns as arrays; array columns as their values one after the other, and offsets.

    A batch ends in one value, so it has to be bounded, as a step's batch is.
    """
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*stacked, *ragged).alias("r"))))
    out = rows.groupBy(batch).agg(F.transform(held, lambda x: x["r"]).alias("_r"))
    ends = lambda c: F.aggregate("_r", F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + F.size(x[c])))
    columns = {c: F.col("_r")[c] for c in stacked}
    columns |= {f"{c}_values": F.flatten(F.col("_r")[c]) for c in ragged} | {f"{c}_offsets": ends(c) for c in ragged}
    return out.withColumns(columns).drop("_r")


def sample_log(rows: DataFrame, step: int, sample: str) -> DataFrame:
    """step, sample, field, text: each field of a row as a row, as a table sink takes it."""
    fields = [c for c in rows.columns if c != sample]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("text")) for c in fields]))
    return rows.select(F.lit(step).alias("step"), F.col(sample).alias("sample"), pairs.alias("p")).select("step", "sample", "p.*")


def after_update(in_flight: int, queued: int, started: float, idle_since: float | None, now: float) -> dict[str, float]:
    """What an update of the weights sets: stale samples, and how long and how idle the version was."""
    took = max(now - started, 1e-6)
    active = idle_since - started if idle_since is not None and idle_since > started else took
    return {"stale_samples": in_flight + queued, "version_time": took, "active_time": active, "idle_ratio": 1 - active / took}
