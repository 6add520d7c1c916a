"""Every query with SQL against DuckDB on the smallest tables, the others against plain versions."""

import numpy as np
import pytest
from compare import differences, duck
from pyspark.sql import functions as F

from sievemill import queries as own
from sievemill.operators import batch, metrics, selection

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(own.ORACLE_SQL))
def test_sql(spark, name):
    _, left, right = differences(own.QUERIES[name](spark, SF), duck(SF), own.ORACLE_SQL[name])
    assert (left[:3], right[:3]) == ([], [])


def test_bootstrap_equals_numpy(spark):
    values, votes = [0.3, 0.1, 0.9, 0.4, 0.7], ["a", None, "b", "a", "b"]
    df = spark.createDataFrame([("s", 1, i, v, p) for i, (v, p) in enumerate(zip(values, votes))], "source string, uid int, n int, value double, pred string")
    got = {r.metric: r.value for r in metrics.validation_metrics(df, ["source", "uid"], vote="pred", draws=50).collect()}
    for n in (2, 4, 5):
        drawn = np.random.RandomState(42).choice(5, size=(50, n), replace=True)
        best = [max(values[i] for i in ix) for ix in drawn]
        maj = []
        for ix in drawn:
            p = [votes[i] for i in ix]
            top = max(dict.fromkeys(p), key=p.count)
            maj.append(values[ix[p.index(top)]])
        assert np.allclose([got[f"best@{n}/mean"], got[f"best@{n}/std"], got[f"maj@{n}/mean"], got[f"maj@{n}/std"]], [np.mean(best), np.std(best), np.mean(maj), np.std(maj)])
    assert np.isclose(got["std@5"], np.std(values))


def test_balance(spark):
    costs = [int(c) for c in np.random.RandomState(0).randint(1, 1000, 200)]
    part = selection.differencing(costs, 7)
    sums = [sum(c for c, p in zip(costs, part) if p == j) for j in range(7)]
    assert sum(sums) == sum(costs) and max(sums) - min(sums) <= 10
    assert selection.differencing([], 3) == [] and selection.greedy([5, 1, 1], 2) == [0, 1, 1]


def test_leakage(spark):
    rows = [("Is Paris the capital?", "Paris", "bridge", "answer_in_question"), ("Paris or Rome?", "Rome", "bridge", None), ("Paris here", "Paris", "comparison", None), ("yes it is", "yes", "bridge", None), (None, "x", None, None), ("a b", "", "bridge", None)]
    df = spark.createDataFrame(rows, "q string, a string, kind string, want string")
    assert df.where(~selection.leakage_reason(F.col("q"), F.col("a"), F.col("kind")).eqNullSafe(F.col("want"))).collect() == []


def test_row_index_with_ties_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(None, 1), (2, 2), (2, 1), (1, 5)], "k int, v int")
    assert [tuple(r) for r in batch.with_row_index(df, "k", "v").orderBy("row_idx").select("k", "v", "row_idx").collect()] == [(None, 1, 0), (1, 5, 1), (2, 1, 2), (2, 2, 3)]
    assert batch.with_row_index(df.limit(0), "k", "v").count() == 0


def test_union_columns_fails_on_conflict(spark):
    a = spark.createDataFrame([(0, 1), (1, 2)], "row_idx long, x int")
    with pytest.raises(Exception, match="differ"):
        batch.union_columns(a, a.withColumn("x", F.col("x") + 1)).collect()
