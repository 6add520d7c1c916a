"""Registration of queries, and the rounding that both sides of a comparison share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
DIGITS = 9
#: Added before rounding. Scores have few decimals, so their means often lie exactly halfway between two roundings, where
#: the last bit of a sum decides; moved by this much, which is far below the last digit kept, they do not.
SHIFT = 2.7182818e-11


def query(name: str, sql: str | None = None):
    """Register f(spark, sf_dir) under a name, with SQL unless only its rows can be checked."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered already")
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    """df with doubles rounded (after SHIFT) and without negative zeros; sums in another order then give equal values."""
    return df.select(*[(F.round(F.col(f"`{c}`") + SHIFT, DIGITS) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


def r(sql: str, name: str) -> str:
    """A rounded SQL column, as rounded() makes it."""
    return f"round(CAST({sql} AS DOUBLE) + {SHIFT}, {DIGITS}) + 0.0 AS {name}"
