"""Plans of batches that are larger than one task plans."""

import random
import time

import pytest
from pyspark.sql import functions as F

from sievemill.operators import balancing as A
from sievemill.operators import selection as S


@pytest.fixture
def pieces(monkeypatch):
    monkeypatch.setattr(A, "WHOLE", 200)
    monkeypatch.setattr(A, "PIECE", 64)


def _rows(n, batches=2, seed=7):
    rng = random.Random(seed)
    return [(b, 10**9 * (b + 1) + i, rng.randrange(1, 350)) for b in range(batches) for i in range(n + b * 12)]


def _parts(planned):
    out = {}
    for r in planned.collect():
        out.setdefault((r["batch"], r["part"]), []).append(r["id"])
    return out


def test_many_parts_take_no_pass_over_all_of_them():
    rng = random.Random(1)
    costs = [A.cost_of(rng.randrange(1, 350)) for _ in range(60_000)]
    start = time.time()
    parts = A.differencing(costs, 6000)
    assert time.time() - start < 10 and sorted(i for p in parts for i in p) == list(range(60_000))


@pytest.mark.parametrize("k,equal", [(4, False), (4, True), (300, False), (120, True)])
def test_spread_in_pieces(spark, pieces, k, equal):
    rows = _rows(1200)
    rows = [r for r in rows if not equal or r[1] % 10**9 < 1200]
    cost = {(b, i): n for b, i, n in rows}
    parts = _parts(A.spread(spark.createDataFrame(rows, "batch int, id long, len int"), "batch", "id", F.col("len").cast("long"), k, equal))
    assert sorted((b, i) for (b, _), ids in parts.items() for i in ids) == sorted(cost)
    for b in (0, 1):
        mine = [parts[b, j] for j in range(k)]
        sums = [sum(cost[b, i] for i in ids) for ids in mine]
        assert max(sums) - min(sums) <= (350 if k > 4 else 10) and (not equal or {len(x) for x in mine} == {1200 // k})


def test_plans_equal_those_of_one_task(spark):
    rows = _rows(96)
    df = spark.createDataFrame(rows, "batch int, id long, len int").repartition(5)
    micro = {(r["batch"], r["part"], r["place"]): r["id"] for r in A.micro_batch_plan(df, "batch", "id", "len", 1000, divisor=2).collect()}
    ranked = {(r["batch"], r["part"], r["place"]): r["id"] for r in A.rank_plan(df, "batch", "id", "len", 4).collect()}
    for b in (0, 1):
        ids, lens = zip(*((i, n) for x, i, n in rows if x == b))
        for got, want in ((micro, A.micro_batches(list(lens), 1000, divisor=2)), (ranked, A.ranks(list(lens), 4))):
            assert {(p, at): i for (x, p, at), i in got.items() if x == b} == {(p, at): ids[i] for p, part in enumerate(want) for at, i in enumerate(part)}


def test_micro_batches_fail_as_those_of_one_task(spark):
    df = spark.createDataFrame([(0, 1, 5), (0, 2, 50)], "batch int, id long, len int")
    for budget, least, match in ((20, 1, "over the budget"), (60, 3, "units")):
        with pytest.raises(Exception, match=match):
            A.micro_batch_plan(df, "batch", "id", "len", budget, least).collect()


def test_micro_batches_in_pieces(spark, pieces):
    df = spark.createDataFrame(_rows(1200, 1), "batch int, id long, len int")
    got = A.micro_batch_plan(df, "batch", "id", "len", 1000, divisor=2).join(df.drop("batch"), "id")
    costs = [r["c"] for r in got.groupBy("part").agg(F.sum(A.cost_column(F.col("len"))).alias("c")).orderBy("part").collect()]
    peak = costs.index(max(costs))
    assert costs[:peak] == sorted(costs[:peak]) and costs[peak:] == sorted(costs[peak:], reverse=True)
    assert got.count() == 1200 and got.select("part", "place").distinct().count() == 1200


def test_groups_stay_whole_whatever_their_keys(spark, pieces):
    rng = random.Random(3)
    rows = [(0, g, 10**11 + 1000 * g + i, rng.randrange(1, 350)) for g in range(700) for i in range(g % 3 + 1)]
    df = spark.createDataFrame(rows, "batch int, uid long, id long, len int")
    got = {r["uid"]: r["part"] for r in A.group_plan(df, "batch", "uid", "len", 3).collect()}
    assert sorted(got) == list(range(699)) and [list(got.values()).count(j) for j in range(3)] == [233] * 3
    sums = [sum(A.cost_of(n) for _, g, _, n in rows if got.get(g) == j) for j in range(3)]
    assert max(sums) - min(sums) <= 3 * A.cost_of(350)


def test_balance_of_many_rows(spark, pieces, monkeypatch):
    monkeypatch.setattr(S, "RUN", 100)
    monkeypatch.setattr(S, "PACKED", 30)
    rows = [(i, n) for _, i, n in _rows(1500, 1)]
    df = spark.createDataFrame(rows, "id long, len int").repartition(7)
    got = {r["id"]: r["part"] for r in S.greedy_balance(df, "id", "len", 8).collect()}
    assert [got[i] for i, _ in rows] == S.greedy([n for _, n in rows], 8)
    got = {r["id"]: r["part"] for r in S.balance(df, "id", "len", 8).collect()}
    sums = [sum(n for i, n in rows if got[i] == j) for j in range(8)]
    assert len(got) == 1500 and max(sums) - min(sums) <= 10
