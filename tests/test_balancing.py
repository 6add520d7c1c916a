"""Balancing plans and scans on single cases."""

import random
import time

import pytest
from pyspark.sql import functions as F

from sievemill.operators import balancing as A
from sievemill.operators import batch as B
from sievemill.operators import correction as C
from sievemill.operators import logits as L
from sievemill.operators import tokens as T


def test_differencing():
    rng = random.Random(1)
    for n, k, equal in ((12, 3, True), (17, 4, False), (1, 1, True), (64, 8, True)):
        costs = [rng.randrange(1, 1000) for _ in range(n)]
        parts = A.balanced(costs, k, equal)
        assert sorted(i for p in parts for i in p) == list(range(n))
        assert not equal or {len(p) for p in parts} == {n // k}
        sums = [sum(costs[i] for i in p) for p in parts]
        assert max(sums) - min(sums) <= max(costs)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in A.differencing([8, 7, 6, 5, 4], 2)) == [14, 16]
    with pytest.raises(ValueError):
        A.balanced([1, 2, 3], 2, True)
    with pytest.raises(ValueError):
        A.balanced([1], 2)


def test_micro_batches():
    rng = random.Random(2)
    lengths = [rng.randrange(1, 300) for _ in range(48)]
    for kwargs in ({}, {"divisor": 4}, {"least": 20}, {"group": 4}, {"order": False}):
        parts = A.micro_batches(lengths, 1000, **kwargs)
        assert sorted(i for p in parts for i in p) == list(range(48)) and len(parts) % kwargs.get("divisor", 1) == 0
        assert len(parts) >= max(kwargs.get("least", 1), -(-sum(lengths) // 1000))
        if kwargs.get("group"):
            assert all(sorted(p) == [i for u in sorted({x // 4 for x in p}) for i in range(4 * u, 4 * u + 4)] for p in parts)
    sums = [sum(A.cost_of(lengths[i]) for i in p) for p in A.micro_batches(lengths, 1000)]
    peak = sums.index(max(sums))
    assert sums[:peak] == sorted(sums[:peak]) and sums[peak:] == sorted(sums[peak:], reverse=True)
    for bad in ({"budget": 100}, {"budget": 1000, "group": 5}, {"budget": 1000, "least": 60}):
        with pytest.raises(ValueError):
            A.micro_batches(lengths, **bad)


def test_whole_groups_and_ranks():
    groups = [g for g in "abcdef" for _ in range(3)]
    lengths = [10 * (k + 1) for k in range(18)]
    parts = A.whole_groups(lengths, groups, 2)
    assert sorted(i for p in parts for i in p) == list(range(18)) and all(len({groups[i] for i in p}) == 3 for p in parts)
    parts = A.ranks(lengths, 3)
    for p in parts:
        costs = [lengths[i] for i in p]
        peak = costs.index(max(costs))
        assert len(p) == 6 and costs[: peak + 1] == sorted(costs[: peak + 1]) and costs[peak:] == sorted(costs[peak:], reverse=True)


def test_row_index_of_any_order(spark):
    rows = [(None, "b"), (None, "a"), (3, None), (3, "x")] + [(k % 7, f"t{k}") for k in range(500)]
    got = [(r["k"], r["t"]) for r in B.with_row_index(spark.createDataFrame(rows, "k long, t string"), "k", "t").orderBy("row_idx").collect()]
    none = lambda x: (x is not None, x)
    assert got == sorted(rows, key=lambda x: (none(x[0]), none(x[1])))
    assert [r["row_idx"] for r in B.with_row_index(spark.createDataFrame(rows, "k long, t string"), "t", "k").orderBy("row_idx").collect()] == list(range(504))


def test_first_rows(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(50), k) for k in range(3000)]
    for count in (0, 1, 17, 2999, 5000):
        got = T.first_rows(spark.createDataFrame(rows, "v long, k long"), "v", ["k"], count).collect()
        assert sorted((r["v"], r["k"]) for r in got) == sorted(rows)[:count]


def test_scan_is_linear(spark):
    n = 40_000
    tok = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct((i % 3 > 0).cast("int").alias("mask"), F.lit(0.5).alias("reward"), (i / n).alias("value")))
    df = spark.range(1).select(tok.alias("tok")).persist()
    df.count()
    T.gae(df.limit(0)).select(F.element_at("adv_raw", 1)).collect()
    start = time.time()
    got = T.gae(df, 0.99, 0.95).select("adv_raw").first()[0]
    assert time.time() - start < 8
    value = adv = 0.0
    for i in range(n, 0, -1):
        if i % 3:
            adv = 0.5 + 0.99 * value - i / n + 0.99 * 0.95 * adv
            value = i / n
        if i % 1999 == 0:
            assert abs(got[i - 1] - adv) < 1e-9
    empty = spark.createDataFrame([([],)], "tok array<struct<mask:int,reward:double,value:double>>")
    assert T.gae(empty).first()["ret"] == []


def test_corrections_and_routes(spark):
    with pytest.raises(ValueError):
        C.preset("no such")
    with pytest.raises(ValueError):
        C.correct(spark.range(1), C.Correction(None, reject="token_k1"))
    df = spark.createDataFrame([("a",), (None,)], "k string")
    assert [r[0] for r in df.select(L.teacher_of(F.col("k"), ["z"])).collect()] == ["z", "z"]
    with pytest.raises(Exception, match="no teacher"):
        df.select(L.teacher_of(F.col("k"), ["a", "b"])).collect()
