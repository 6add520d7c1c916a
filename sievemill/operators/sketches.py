"""Sketches of quantiles and of distinct values, kept as a table and merged: a group is never held whole.

A row of sketches(by..., n, quantiles, distinct) stands for any number of values, and rows of several steps or files merge to the
same as if all values had been sketched at once, within the error. With K = 4096 the rank of a quantile is off by less than
RANK_ERROR of all values in 99 of 100 cases (Karnin, Lang and Liberty), and with 2**LOG_K registers a distinct count has a
standard error of DISTINCT_ERROR after merging. Up to K values a group's quantiles are exact. Nulls are not counted; a group of nulls has n 0 and null quantiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K, RANK_ERROR = 4096, 0.0013
LOG_K, DISTINCT_ERROR = 14, 0.0082


def sketches(rows: DataFrame, by: list[str], value: Column, item: Column | None = None) -> DataFrame:
    """(by..., n, quantiles, distinct): a row for each group; item (else value) is what is counted as distinct."""
    held = rows.select(*by, value.cast("double").alias("_v"), (value if item is None else item).cast("string").alias("_i"))
    return held.groupBy(*by).agg(F.count("_v").alias("n"), F.kll_sketch_agg_double("_v", F.lit(K)).alias("quantiles"), F.hll_sketch_agg("_i", F.lit(LOG_K)).alias("distinct"))


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of coarser groups from those of finer ones."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("quantiles", F.lit(K)).alias("quantiles"), F.hll_union_agg("distinct").alias("distinct"))


def quantile(share: float) -> Column:
    """The value below which this share of a row's values lies; null for a row of none."""
    return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("quantiles", F.lit(float(share))))


def share_up_to(value: Column) -> Column:
    """The share of a row's values that are at most this one; null for a row of none."""
    return F.when(F.col("n") > 0, F.kll_sketch_get_rank_double("quantiles", value))


def distinct() -> Column:
    return F.hll_sketch_estimate("distinct")


def sketch_percentiles(parts: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """(by..., n, a column for each share): reports.percentiles() in bounded memory, from stored sketches."""
    return merged(parts, by).select(*by, "n", *[quantile(q).alias(n) for n, q in shares.items()])
