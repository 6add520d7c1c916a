"""Leakage in long questions."""

import time

from pyspark.sql import functions as F

from sievemill.operators import selection


def test_places_are_sought_only_where_the_answer_stands(spark):
    text = F.concat(F.repeat(F.lit("some words of a long text "), 3000), F.when(F.col("id") % 100 == 0, F.lit("new york city")).when(F.col("id") % 100 == 1, F.lit("rome or new york city")).otherwise(F.lit("new yorker")))
    df = spark.range(0, 800, 1, 8).select("id", selection.leakage_reason(text, F.lit("New York"), F.lit("bridge")).alias("reason"))
    start = time.time()
    got = {(r["m"], r["reason"]): r["count"] for r in df.groupBy((F.col("id") % 100).alias("m"), "reason").count().collect()}
    assert time.time() - start < 28
    assert got == {(m, "answer_in_question" if m == 0 else None): 8 for m in range(100)}
