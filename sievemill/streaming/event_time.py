"""Event time: windows that close, sessions, and joins of two streams within an interval.

A watermark says how late a row may come: rows later than that are dropped where state has closed, and a window or a session
is given out once the watermark has passed its end, never again. State is bounded by the watermark, not by the stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def closed_windows(stream: DataFrame, time: str, late: str, size: str, step: str | None, by: list[str], **aggregates: Column) -> DataFrame:
    """(start, end, by..., aggregates) of each window of `size`, one every `step`, that the watermark has passed."""
    window = F.window(time, size, step) if step else F.window(time, size)
    out = stream.withWatermark(time, late).groupBy(window.alias("w"), *by).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, *aggregates)


def closed_sessions(stream: DataFrame, time: str, late: str, gap: str, by: list[str], **aggregates: Column) -> DataFrame:
    """(start, end, by..., aggregates) of each run of rows less than `gap` apart; it ends a gap after its last row."""
    out = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, *aggregates)


def within(left: DataFrame, right: DataFrame, key: str, time: str, late: str, before: str, after: str = "0 seconds") -> DataFrame:
    """Pairs of rows of two streams with equal key, the right one from `before` before to `after` after the left one.

    Columns of the right stream get the prefix right_. A row is kept only until none of the other stream can meet it.
    """
    left = left.withWatermark(time, late)
    right = right.select(*[F.col(c).alias(f"right_{c}") for c in right.columns]).withWatermark(f"right_{time}", late)
    near = F.expr(f"right_{time} >= {time} - INTERVAL {before} AND right_{time} <= {time} + INTERVAL {after}")
    return left.join(right, (F.col(key) == F.col(f"right_{key}")) & near)
