"""Joins by time: the last row before, and all rows within an interval, by equality on (key, span of time).

Rows meet by key and span, so a hot key is spread over its spans, and no join compares all rows of a key. What an as-of
join needs from earlier spans is the last right row of each, carried forward over a table of a row per (key, span).
Rows with a null key or time match nothing. Times are timestamps, spans and bounds seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _span(time: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(time) / F.lit(seconds * 1_000_000)).cast("long")


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, tie: str, span: int) -> DataFrame:
    """Every left row with `match`: a struct of the right row of its key that is last by (time, tie) and not after it, else null."""
    held = F.struct(F.col(time).alias("_t"), F.col(tie).alias("_tie"), F.struct(*[f"`{c}`" for c in right.columns]).alias("row"))
    right = right.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("_key"), _span(F.col(time), span).alias("_span"), held.alias("_held"))
    ends = right.groupBy("_key", "_span").agg(F.max("_held").alias("_end"))
    left = left.select(F.col(key).alias("_key"), _span(F.col(time), span).alias("_span"), F.col(time).alias("_time"), F.struct(*[f"`{c}`" for c in left.columns]).alias("_left"))
    # The spans of left rows as well as those of right ones, so that each finds what came before it.
    spans = ends.unionByName(left.select("_key", "_span", F.lit(None).cast(ends.schema["_end"].dataType).alias("_end"))).groupBy("_key", "_span").agg(F.max("_end").alias("_end"))
    carried = spans.select("_key", "_span", F.last("_end", ignorenulls=True).over(Window.partitionBy("_key").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    none = lambda df, name: F.lit(None).cast(df.schema[name].dataType).alias(name)
    both = left.select("_key", "_span", "_time", F.lit(1).alias("_side"), "_left", none(right, "_held")).unionByName(right.select("_key", "_span", F.col("_held._t").alias("_time"), F.lit(0).alias("_side"), none(left, "_left"), "_held"))
    near = F.last("_held", ignorenulls=True).over(Window.partitionBy("_key", "_span").orderBy("_time", "_side", F.col("_held._tie")))
    out = both.withColumn("_near", near).where("_side = 1").join(carried, ["_key", "_span"], "left")
    match = F.when(F.col("_key").isNotNull() & F.col("_time").isNotNull(), F.coalesce("_near", "_before")["row"])
    return out.select("_left.*", match.alias("match"))


def within(left: DataFrame, right: DataFrame, key: str, time: str, before: int, after: int, span: int) -> DataFrame:
    """(left, right): structs of rows with equal key, the right one from `before` seconds before to `after` after the left one."""
    if before + after < 0:
        raise ValueError("the interval is empty")
    shift = lambda n: F.timestamp_micros(F.unix_micros(time) + n * 1_000_000)
    spans = F.sequence(_span(shift(-before), span), _span(shift(after), span))
    here = left.where(F.col(time).isNotNull()).select(F.col(key).alias("_key"), shift(-before).alias("_from"), shift(after).alias("_to"), F.struct(*[f"`{c}`" for c in left.columns]).alias("left"), F.explode(spans).alias("_span"))
    there = right.where(F.col(time).isNotNull()).select(F.col(key).alias("_key"), F.col(time).alias("_time"), F.struct(*[f"`{c}`" for c in right.columns]).alias("right"), _span(F.col(time), span).alias("_span"))
    return here.join(there, ["_key", "_span"]).where("_time BETWEEN _from AND _to").select("left", "right")
