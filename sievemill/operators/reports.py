"""Reports over metric rows, sampled answers and dumps: rule-driven aggregation, sampled accuracies, sizes and schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import tokens as T
from .batch import ROW, with_row_index

# Metrics that have a rule of their own, and the words of a name (in this order) that give one.
OWN_RULES = {
    "perf/time_per_step": "sum",
    "timing_s/agent_loop/tool_calls/min": "min",
    "timing_s/agent_loop/tool_calls/mean": "avg",
    "timing_s/agent_loop/tool_calls/max": "max",
    "fully_async/count/total_generated_samples": "last",
    "fully_async/count/stale_samples_processed": "last",
    "fully_async/count/stale_trajectory_processed": "last",
    "fully_async/count/current_param_version": "last",
    "fully_async/count/dropped_stale_samples": "last",
    "training/global_step": "last",
}
WORDS = {"sum": ("timing_s/",), "avg": ("mean", "avg", "average"), "max": ("max", "maximum"), "min": ("min", "minimum"), "total": ("sum", "total")}


def rule_of(name: Column) -> Column:
    """sum, avg, max, min or last, by the metric's name."""
    out = F
    for rule in sorted(set(OWN_RULES.values())):
        out = out.when(name.isin([n for n, r in OWN_RULES.items() if r == rule]), rule)
    low = F.lower(name)
    for rule, words in WORDS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = out.when(hit, "sum" if rule == "total" else rule)
    return out.otherwise("avg")


def aggregate_metrics(rows: DataFrame, by: list[str], name: str = "name", value: str = "value", order: str = "step") -> DataFrame:
    """by, name, value: metric rows of many steps as one, by the rule of each name."""
    rule = rule_of(F.col(name))
    total = F.when(rule == "sum", F.sum(value)).when(rule == "max", F.max(value)).when(rule == "min", F.min(value)).when(rule == "last", F.max_by(value, order)).otherwise(F.avg(value))
    return rows.where(F.col(value).isNotNull()).groupBy(*by, name).agg(total.alias("value"))


def derived_metrics(metrics: DataFrame, devices: int) -> DataFrame:
    """One wide row of aggregated metrics with those that follow from others computed anew, as far as these are there."""
    has, c = set(metrics.columns), lambda n: F.col(f"`{n}`")
    made = {}
    if "global_seqlen/minmax_diff" in has:
        made["global_seqlen/minmax_diff"] = c("global_seqlen/max") - c("global_seqlen/min")
    if {"perf/throughput", "perf/total_num_tokens", "perf/time_per_step"} <= has:
        made["perf/throughput"] = c("perf/total_num_tokens") / (c("perf/time_per_step") * devices)
    if {"timing_s/gen", "timing_s/step"} <= has:
        made["fully_async/trainer/idle_ratio"] = c("timing_s/gen") / c("timing_s/step")
    return metrics.withColumns(made)


def table_statistics(df: DataFrame, value: str) -> DataFrame:
    """One row: mean, max, min and sample deviation of a column over all partitions."""
    return df.agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"), F.stddev_samp(value).alias("std"))


def masked_mean(df: DataFrame, value: str, mask: str) -> DataFrame:
    return df.agg((F.sum(F.col(value) * F.col(mask)) / F.sum(mask)).alias("mean"))


def over_ranks(rows: DataFrame, rank: str, name: str, value: str, how: str, place: str) -> DataFrame:
    """A value for each name: sums and means are averaged over the ranks at each place first, bounds are taken over all."""
    if how in ("max", "min"):
        return rows.groupBy(name).agg((F.max if how == "max" else F.min)(value).alias("value"))
    if how not in ("sum", "mean"):
        raise ValueError(f"unknown aggregation {how!r}")
    first = rows.groupBy(name, place).agg(F.avg(value).alias("_v"))
    return first.groupBy(name).agg((F.sum if how == "sum" else F.avg)("_v").alias("value"))


def performance(rows: DataFrame, timings: list[str], also: list[str], order: str) -> DataFrame:
    """One row: min, max and mean of timings (and of `also`), and those of the slowest row by the sum of its timings; of equal ones the first."""
    total = sum((F.col(t) for t in timings), F.lit(0.0))
    stats = [f(c).alias(f"{c}_{n}") for c in (*timings, *also) for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    slow = F.max_by(F.struct(*timings, *also), F.struct(total, -F.col(order)))
    return rows.agg(*stats, slow.alias("_s")).select("*", *[F.col(f"_s.{c}").alias(f"slowest_{c}") for c in (*timings, *also)]).drop("_s")


def dense_codes(df: DataFrame, label: str, out: str = "code") -> DataFrame:
    """df with a number from 0 for each label, in the order of the labels; labels differ that differ as values. Nulls have none."""
    labels = with_row_index(df.where(F.col(label).isNotNull()).select(label).distinct(), label).withColumnRenamed(ROW, out)
    return df.join(labels, label, "left")


def sampled_accuracy(rows: DataFrame, group: str, order: str, hit: Column, strategy: Column, by: str | None = None, f1: Column | None = None, at_least: float = 0.5) -> DataFrame:
    """A row for each value of `by` (and one for all, where it is null): accuracies of groups of samples; groups of unequal sizes fail."""
    own = rows.select(F.col(group).alias("_g"), *([F.col(by).alias("_by")] if by else [F.lit(None).cast("string").alias("_by")]), F.col(order).alias("_o"), hit.alias("_h"), strategy.alias("_s"), (f1 >= at_least if f1 is not None else hit).alias("_f"))
    any_ = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("int"))
    groups = own.groupBy("_g").agg(
        F.min_by("_by", "_o").alias("_by"), F.count(F.lit(1)).alias("n"), F.min_by(F.coalesce(F.col("_h"), F.lit(False)).cast("int"), "_o").alias("first"), any_(F.col("_h")).alias("any"), any_(F.col("_f")).alias("any_f"),
        any_(F.col("_s")).alias("any_s"), any_(F.col("_h") & F.col("_s")).alias("both"), F.count_if("_h").alias("hits"), F.count_if("_s").alias("strategies"),
    )
    size = F.when(F.min("n") == F.max("n"), F.max("n")).otherwise(F.raise_error("groups of samples of different sizes").cast("long"))
    out = [
        F.count(F.lit(1)).alias("groups"), size.alias("samples"), F.avg("first").alias("exact_at_1"), F.avg("any").alias("pass_exact"), F.avg("any_f").alias("pass_f1"),
        (F.sum("hits") / F.sum("n")).alias("trajectory_exact"), (F.sum("strategies") / F.sum("n")).alias("trajectory_strategy"), F.avg("any_s").alias("pass_strategy"), F.avg("both").alias("pass_both"),
    ]
    return (groups.rollup("_by") if by else groups.groupBy("_by")).agg(*out).withColumnRenamed("_by", by or "by")


def first_k_rate(rows: DataFrame, groups: list[str], order: str, k: int, hit: Column) -> DataFrame:
    """One row: the share of hits among the first k rows of each group."""
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(order))
    return rows.withColumn("_n", place).where(F.col("_n") <= k).agg(F.avg(F.coalesce(hit, F.lit(False)).cast("int")).alias("rate"))


def numbered_groups(rows: DataFrame, group: str, order: str) -> DataFrame:
    """rows with the number of their group, in the order of the groups' first rows, and their place in it, both from 0."""
    firsts = with_row_index(rows.groupBy(group).agg(F.min(order).alias("_first")).select("_first", group), "_first", group).withColumnRenamed(ROW, "group_no").drop("_first")
    return rows.join(firsts, group).withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1)


def report(rows: DataFrame, by: str, **rates: Column) -> DataFrame:
    """n and the mean of each rate, for each value of `by` and for all (where it is null)."""
    return rows.rollup(by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c.cast("double")).alias(n) for n, c in rates.items()])


def percentiles(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles of each group; a group's distinct values meet in one task, so it has to be of bounded size."""
    return rows.groupBy(by).agg(*[F.percentile(value, F.lit(q)).alias(n) for n, q in shares.items()])


def token_difference(a: Column, b: Column, mask: Column) -> Column:
    """How many valid places hold different ids; 0 for empty arrays, null if the sizes differ."""
    both = F.arrays_zip(a.alias("a"), b.alias("b"), mask.alias("m"))
    differ = F.size(F.filter(both, lambda z: (z["a"] != z["b"]) & (z["m"] == 1)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).when((F.size(a) == F.size(b)) & (F.size(a) == F.size(mask)), differ)


def dense_flops(lengths: DataFrame, length: str, seconds: float, hidden: int, layers: int, heads: int, kv_heads: int, inner: int, vocab: int, head_dim: int | None = None) -> DataFrame:
    """One row: teraflops a second of training a dense decoder on sequences of these lengths."""
    d = head_dim or hidden // heads
    weights = (3 * hidden * inner + hidden * (2 * heads + 2 * kv_heads) * d) * layers + 2 * vocab * hidden
    n, square = F.sum(F.col(length).cast("double")), F.sum(F.col(length).cast("double") * F.col(length))
    return lengths.agg(((6.0 * weights * n + 6.0 * d * heads * layers * square) / seconds / 1e12).alias("teraflops"))


def schema_report(df: DataFrame) -> DataFrame:
    """(column, type) of every column, nested types written out."""
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields], "column string, type string")


def size_report(df: DataFrame) -> DataFrame:
    """(column, bytes): what each column holds, as text; arrays and structs as JSON."""
    width = lambda f: F.octet_length(F.to_json(F.col(f"`{f.name}`")) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f"`{f.name}`").cast("string"))
    sums = df.agg(*[F.coalesce(F.sum(width(f)), F.lit(0)).alias(f.name) for f in df.schema.fields])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("long").alias("bytes")) for c in df.columns])).alias("e")).select("e.*")


def consistent(df: DataFrame, arrays: list[str]) -> DataFrame:
    """df, unless the named arrays of a row differ in size or a row_idx is missing or comes twice: then the query fails."""
    sizes = F.array(*[F.size(c) for c in arrays])
    same = F.array_min(sizes) == F.array_max(sizes)
    n = df.agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(ROW).alias("_d"), F.max(ROW).alias("_m"))
    whole = (F.col("_n") == F.col("_d")) & (F.col("_m") + 1 == F.col("_n"))
    checked = F.when(same & whole, True).otherwise(F.raise_error("rows or arrays of a batch don't fit").cast("boolean"))
    return df.join(F.broadcast(n)).where(checked).select(*[f"`{c}`" for c in df.columns])


def columns_of(rows: DataFrame, values: str, names: list[str]) -> DataFrame:
    """A map column as a column for each name; a row whose keys are others fails the query."""
    want = F.array(*[F.lit(n) for n in sorted(names)])
    checked = F.when(F.array_sort(F.map_keys(values)) == want, True).otherwise(F.raise_error("rows with different keys").cast("boolean"))
    others = [f"`{c}`" for c in rows.columns if c != values]
    return rows.where(checked).select(*others, *[F.col(values)[n].alias(n) for n in names])


def rows_of(df: DataFrame, names: list[str], out: str = "values") -> DataFrame:
    """Columns as one map column: the reverse of columns_of()."""
    pairs = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(f"`{n}`") for n in names]))
    return df.select(*[f"`{c}`" for c in df.columns if c not in names], pairs.alias(out))


def prefixed(name: Column, prefix: str) -> Column:
    """The name with the prefix, once."""
    return F.when(F.startswith(name, F.lit(prefix)), name).otherwise(F.concat(F.lit(prefix), name))


def seeded_sample(rows: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """n rows chosen by a hash of seed and key, in the order of that hash."""
    picked = rows.withColumn("_v", F.xxhash64(F.lit(seed), *key))
    return T.first_rows(picked, "_v", list(key), n).drop("_v")


def side_by_side(tables: dict[str, DataFrame], key: str, fields: list[str]) -> DataFrame:
    """Rows of several tables with the same key as one, a struct of the fields for each table; a row that one lacks fails the query."""
    out = None
    for name, df in tables.items():
        one = df.select(key, F.struct(*fields).alias(name))
        out = one if out is None else out.join(one, key, "full_outer")
    whole = F.lit(True)
    for name in tables:
        whole = whole & F.col(name).isNotNull()
    return out.where(F.when(whole, True).otherwise(F.raise_error("a table lacks a row of another").cast("boolean")))


def changed(before: DataFrame, after: DataFrame, key: str, keep: Column) -> DataFrame:
    """The keys of rows that both tables hold and for which `keep`, a condition on `before` and `after` (structs), is true."""
    b, a = (df.select(key, F.struct(*[c for c in df.columns if c != key]).alias(n)) for n, df in (("before", before), ("after", after)))
    return b.join(a, key).where(keep).select(key)
