"""Responses of whole sequences: masks, slices and padding of arrays that hold a prompt and its response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens as T


def response_mask(mask: Column, size: Column) -> Column:
    """The last `size` places of a mask."""
    return F.slice(mask, F.greatest(F.size(mask) - size + 1, F.lit(1)), size)


def response_outputs(values: Column, size: Column) -> Column:
    """The outputs that predict the last `size` tokens: one place earlier than those."""
    return F.slice(values, F.size(values) - size, size)


def padded_responses(values: Column, size: Column, most: int, fill: float = 0.0) -> Column:
    """response_outputs() filled up to `most` places."""
    return T.pad(response_outputs(values, size), most, F.lit(fill))


def trimmed(values: Column, size: Column) -> Column:
    """The first `size` places of a padded array."""
    return F.slice(values, 1, size)


def attention_mask(ids: Column, most: int) -> Column:
    """1 at the places of ids and 0 after them, `most` in all."""
    return F.transform(F.sequence(F.lit(1), F.lit(most)), lambda i: F.when(i <= F.size(ids), 1).otherwise(0))


def plain_lists(df: DataFrame) -> DataFrame:
    """df with nested values as JSON text, which any reader takes."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
    return df.withColumns({c: F.to_json(F.col(f"`{c}`")) for c in nested})


def shared_prefixes(df: DataFrame, group: str, prompt: str, response: str, order: str) -> DataFrame:
    """A row for each group: its prompt once (that of the first row), its responses in order, and how many there are.

    Rows of a group end in one value, so a group has to be bounded, as the samples of one prompt are.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(response).alias("r"), F.col(prompt).alias("p"))))
    return df.groupBy(group).agg(rows.alias("_rows")).select(group, F.col("_rows")[0]["p"].alias(prompt), F.transform("_rows", lambda x: x["r"]).alias(response), F.size("_rows").alias("size"))
