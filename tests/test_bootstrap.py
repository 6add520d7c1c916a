"""Resampled metrics of many groups."""

import time

from pyspark.sql import functions as F

from sievemill.operators import metrics


def test_many_groups_in_time_and_nulls(spark):
    df = spark.range(0, 13 * 4000, 1, 8).select(F.lit("s").alias("source"), F.expr("id div 13").alias("uid"), (F.col("id") % 13).alias("n"), F.expr("id * 7919 % 101 / 7.0").alias("value"), (F.col("id") * 31 % 5).alias("pred"))
    start = time.time()
    got = {r["metric"]: r["value"] for r in metrics.validation_metrics(df, ["source", "uid"], vote="pred").collect()}
    assert time.time() - start < 40 and len(got) == 2 + 4 * 6
    assert got["worst@13/mean"] < got["maj@13/mean"] < got["best@13/mean"]
    rows = [("a", 1, 1, 2.0, "x"), ("a", 1, 2, None, "y"), ("b", 1, 1, None, "x"), ("b", 1, 2, None, "x")]
    few = metrics.validation_metrics(spark.createDataFrame(rows, "source string, uid int, n int, value double, pred string"), ["source", "uid"], vote="pred", draws=1).collect()
    drawn = metrics.drawn_positions(2, 2, 1, 42)[0]
    assert {(r["source"], r["metric"]): r["value"] for r in few if "best@" in r["metric"]} == ({} if 0 not in drawn else {("a", "best@2/mean"): 2.0, ("a", "best@2/std"): 0.0})
