"""Batch algebra: positional row operators on DataFrames that carry their order in a column row_idx, numbered from 0.

A DataFrame has no row order of its own, so each operator reads and writes row_idx. Only with_row_index shuffles the
whole table; the rest are projections, explodes and equi-joins on row_idx.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import work_dir

ROW = "row_idx"


def with_row_index(df: DataFrame, *order: str) -> DataFrame:
    """Number the rows from 0 by a total order (nulls first) without a single-task sort.

    The rows are sorted in ranges of the whole order, as many as the shuffle makes, and written; a row's place in its range
    is what its generated id says, and it moves up by the rows of the ranges before, of which there is a number each.
    """
    place = F.monotonically_increasing_id()
    within = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_id": place})
    path = work_dir(df.sparkSession, "row-index")
    within.write.parquet(path)
    rows = df.sparkSession.read.schema(within.schema).parquet(path).withColumns({"_part": F.shiftright("_id", 33), "_place": F.col("_id").bitwiseAND((1 << 33) - 1)})
    sizes = rows.groupBy("_part").count()
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    return rows.join(F.broadcast(before), "_part").withColumn(ROW, F.col("_before") + F.col("_place")).drop("_id", "_part", "_place", "_before")


def pop(df: DataFrame, *names: str) -> tuple[DataFrame, DataFrame]:
    """(the named columns, the others), both with row_idx."""
    return df.select(ROW, *names), df.drop(*names)


def rename(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError(f"{len(old)} names cannot become {len(new)}")
    return df.withColumnsRenamed(dict(zip(old, new)))


def union_columns(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns of both, row by row. A column of both must hold equal values (nulls and NaNs equal themselves), else the query fails;
    so it does if a row is missing on either side."""
    shared = [c for c in left.columns if c in right.columns and c != ROW]
    l, r = left.alias("l"), right.alias("r")
    both = l.join(r, F.col(f"l.{ROW}") == F.col(f"r.{ROW}"), "full_outer")
    same = F.col(f"l.{ROW}").isNotNull() & F.col(f"r.{ROW}").isNotNull()
    for c in shared:
        same = same & F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`"))
    checked = F.when(same, F.col(f"l.{ROW}")).otherwise(F.raise_error(F.lit(f"batches differ in rows or in one of {shared}")).cast("long"))
    return both.select(checked.alias(ROW), *[F.col(f"l.`{c}`") for c in left.columns if c != ROW], *[F.col(f"r.`{c}`") for c in right.columns if c not in left.columns])


def concat(*parts: DataFrame) -> DataFrame:
    """Rows of all parts, one part after another, renumbered; one count for each part but the last."""
    done, start = [], 0
    for i, part in enumerate(parts):
        done.append(part.withColumn(ROW, F.col(ROW) + F.lit(start)))
        start += part.count() if i + 1 < len(parts) else 0
    return reduce(DataFrame.unionByName, done)


def gather(df: DataFrame, picks: DataFrame) -> DataFrame:
    """Rows by number: picks(pos, row_idx), in pos order; a row may be picked again. A negative number counts from the end."""
    n = F.lit(df.count())
    at = picks.select("pos", F.when(F.col(ROW) < 0, F.col(ROW) + n).otherwise(F.col(ROW)).alias(ROW))
    return df.join(at, ROW).drop(ROW).withColumnRenamed("pos", ROW)


def slice_rows(df: DataFrame, start: int = 0, end: int | None = None, step: int = 1) -> DataFrame:
    """Every step-th row of [start, end), renumbered; negative bounds count from the end."""
    if step < 1:
        raise ValueError("step must be positive")
    if start < 0 or (end is not None and end < 0):
        n = df.count()
        start, end = (max(0, x + n) if x is not None and x < 0 else x for x in (start, end))
    keep = (F.col(ROW) >= start) & (F.pmod(F.col(ROW) - start, F.lit(step)) == 0)
    if end is not None:
        keep = keep & (F.col(ROW) < end)
    return df.where(keep).withColumn(ROW, F.expr(f"({ROW} - {start}) div {step}"))


def repeat(df: DataFrame, times: int, interleave: bool = True) -> DataFrame:
    """Each row `times` times: side by side (aabb) or the whole batch again (abab)."""
    out = df.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))) if times > 0 else df.limit(0).withColumn("_i", F.lit(0))
    place = F.col(ROW) * times + F.col("_i") if interleave else F.col(ROW) + F.col("_i") * F.lit(df.count())
    return out.withColumn(ROW, place).drop("_i")


def repeat_each(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as its column says, rows of 0 or null go; copy numbers the copies from 0. row_idx stays the source's."""
    return df.where(F.col(times) > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col(times) - 1).cast("int"))))


def unfold_chunks(df: DataFrame, n: int, *names: str) -> DataFrame:
    """Arrays of the named columns cut into n equal rows; other columns repeat. Lengths must divide by n."""
    out = df.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    for c in names:
        size = F.size(c)
        width = F.when(size % n == 0, F.expr(f"size(`{c}`) div {n}")).otherwise(F.raise_error(F.lit(f"{c} does not divide by {n}")).cast("int")).cast("int")
        out = out.withColumn(c, F.slice(c, F.col("_i") * width + 1, width))
    return out.withColumn(ROW, F.col(ROW) * n + F.col("_i")).drop("_i")


def fold(df: DataFrame, size: int) -> DataFrame:
    """Every `size` rows in a row's array `rows`, in order."""
    names = [ROW, *[c for c in df.columns if c != ROW]]
    return df.groupBy(F.expr(f"{ROW} div {size}").alias("batch")).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("rows")).withColumnRenamed("batch", ROW)


def unfold(df: DataFrame, size: int) -> DataFrame:
    return df.select(F.explode("rows").alias("r")).select("r.*")


def chunk(df: DataFrame, k: int) -> DataFrame:
    """Column chunk: k equal runs of rows; their number must divide by k."""
    n = df.count()
    if n % k:
        raise ValueError(f"{n} rows do not divide into {k} chunks")
    return split(df, max(n // k, 1), "chunk")


def split(df: DataFrame, size: int, name: str = "part") -> DataFrame:
    """A column with the number of the row's run of `size` rows; the last run may be short."""
    return df.withColumn(name, F.expr(f"{ROW} div {size}"))


def split_equal(df: DataFrame, k: int) -> DataFrame:
    """k runs of floor(n / k) rows, the rest dropped."""
    size = df.count() // k
    return split(df.where(F.col(ROW) < k * size), max(size, 1))


def loader_batches(df: DataFrame, size: int, drop_last: bool) -> DataFrame:
    """Batches of `size` rows; a short last one goes (training) or stays (validation)."""
    n = df.count()
    return split(df.where(F.col(ROW) < n // size * size) if drop_last else df, size, "batch")


def minibatches(df: DataFrame, size: int, epochs: int = 1, seed: int | None = None) -> DataFrame:
    """epoch, batch and row_idx within the epoch; with a seed each epoch has an order of its own. Rows must divide by size."""
    n = df.count()
    if n % size:
        raise ValueError(f"{n} rows do not divide into batches of {size}")
    out = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    if seed is not None:
        out = out.withColumn("_key", F.xxhash64(F.lit(seed), "epoch", ROW))
        parts = [with_row_index(out.where(F.col("epoch") == e).withColumnRenamed(ROW, "_row"), "_key", "_row").drop("_key", "_row") for e in range(epochs)]
        out = reduce(DataFrame.unionByName, parts)
    return split(out, size, "batch")


def pad_to_divisor(df: DataFrame, divisor: int) -> DataFrame:
    """Leading rows again, in a cycle, until the number of rows divides; is_pad marks them."""
    n = df.count()
    missing = -n % divisor if n else 0
    base = df.withColumn("is_pad", F.lit(False))
    if not missing:
        return base
    again = df.where(F.col(ROW) < missing).withColumn(ROW, F.explode(F.sequence(F.col(ROW) + n, F.lit(n + missing - 1).cast("long"), F.lit(n).cast("long"))))
    return base.unionByName(again.withColumn("is_pad", F.lit(True)))


def unpad(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_pad")).drop("is_pad")


def pad_with_row(df: DataFrame, times: int, last: bool = False) -> DataFrame:
    """The first or last row `times` more times at the end."""
    n = df.count()
    if times < 1 or not n:
        return df
    return df.unionByName(df.where(F.col(ROW) == (n - 1 if last else 0)).withColumn(ROW, F.explode(F.sequence(F.lit(n).cast("long"), F.lit(n + times - 1).cast("long")))))


def upsample(df: DataFrame, multiple: int, **values: Column) -> DataFrame:
    """Made-up rows at the end until the number of rows divides: the given values, else null; is_padding marks them."""
    n = df.count()
    missing = -n % multiple
    base = df.withColumn("is_padding", F.lit(False))
    made = df.sparkSession.range(n, n + missing).select(F.col("id").alias(ROW), *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema if f.name != ROW], F.lit(True).alias("is_padding"))
    return base.unionByName(made)


def merge_meta(left: dict, right: dict) -> dict:
    """Both settings in one; a name with two values fails."""
    for k in left.keys() & right.keys():
        if left[k] != right[k]:
            raise ValueError(f"{k!r} is both {left[k]!r} and {right[k]!r}")
    return left | right


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Whether both hold the same rows, repeats counted."""
    cols = sorted(left.columns)
    return cols == sorted(right.columns) and left.select(*cols).exceptAll(right.select(*cols)).isEmpty() and right.select(*cols).exceptAll(left.select(*cols)).isEmpty()


def transition(left: DataFrame, right: DataFrame, field: str) -> DataFrame:
    """The four counts of a flag before and after, by row number; cells without rows are 0."""
    both = left.select(ROW, F.col(field).alias("before")).join(right.select(ROW, F.col(field).alias("after")), ROW)
    cell = lambda b, a: F.count_if((F.col("before") == b) & (F.col("after") == a)).alias(f"n_{int(b)}{int(a)}")
    return both.agg(*[cell(b, a) for b in (False, True) for a in (False, True)])
