"""Stateful streams over several micro-batches, with a stop between them, against plain replays."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from sievemill.streaming import runner, state

SCHEMA = "key int, item long, status string"


def feed(spark, folder, batches, path, make):
    """Run make(stream) over the batches, half of them before a stop; the rows of all."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        if i in (len(batches) // 2, len(batches) - 1):
            out = runner.run_to_table(make(runner.stream_table(spark, folder, 1)), path)
    return out


def batches(n=4, size=60):
    rng, item, out = random.Random(3), 0, []
    for _ in range(n):
        rows = []
        for _ in range(size):
            item += 1
            rows.append((rng.choice([1, 1, 1, 2, 3, None]), item, rng.choice(["put", "put", "take"])))
        out.append(rows)
    return out


def test_count_windows(spark, tmp_path):
    data, want, held = batches(), set(), defaultdict(list)
    got = feed(spark, str(tmp_path / "in"), data, str(tmp_path / "out"), lambda s: state.count_windows(s, F.col("key"), F.col("item"), F.col("item"), 7))
    for key, item, _ in (r for b in data for r in b):
        held[key].append(item)
    for key, items in held.items():
        want |= {(key, i // 7, i % 7, x) for i, x in enumerate(items[: len(items) // 7 * 7])}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_bounded_queue(spark, tmp_path):
    data, want, queues = batches(), [], defaultdict(list)
    got = feed(spark, str(tmp_path / "in"), data, str(tmp_path / "out"), lambda s: state.bounded_queue(s, F.col("key"), F.col("item"), F.col("item"), F.col("status") == "take", 3))
    for key, item, status in (r for b in data for r in b):
        q = queues[key]
        if status == "take":
            want += [(key, "consumed", q.pop(0))] if q else []
        else:
            q.append(item)
            want += [(key, "dropped", q.pop(0))] if len(q) > 3 else []
            want.append((key, "put", item))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert {r.key: r.size for r in state.queue_statistics(got).collect()} == {k: len(q) for k, q in queues.items()}


def test_step_barrier_waits(spark, tmp_path):
    first = [(1, 10, "running"), (1, 11, "success"), (2, 20, "success"), (2, 21, "failed"), (3, None, "running")]
    second = [(1, 10, "success"), (2, 22, "success")]
    got = feed(spark, str(tmp_path / "in"), [first, second], str(tmp_path / "out"), lambda s: state.step_barrier(s, F.col("key"), F.col("item"), F.col("item"), F.col("status")))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 10), (1, 11), (2, 20), (2, 22)]


def test_stale_counts_of_stream_and_of_nothing(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([(1, 1, "a"), (1, 5, "a"), (2, None, "b")], SCHEMA).write.parquet(folder)
    make = lambda s: state.stale_counts(s, F.col("key"), F.col("item"), 3)
    assert sorted(tuple(r) for r in runner.run_to_state(make(runner.stream_table(spark, folder)), str(tmp_path / "a")).collect()) == [(1, 2, 1), (2, 1, 0)]
    assert state.required_samples(32, 0.5, 4) == 192 and state.admits(1, 2, 0, 1) and not state.admits(2, 2, 0, 1)
