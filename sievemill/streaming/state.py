"""Stateful operators on streams: windows of a row count, a bounded queue, a barrier on steps, staleness by version.

Each takes a streaming DataFrame and keeps one small state per key; keys are spread by hash over the state partitions.
Rows of a key that come in one micro-batch are put in the order given; the source's maxFilesPerTrigger bounds a
micro-batch, and thereby what one key can bring at once. Null items are ignored, a null key is a key of its own.
State and offsets are under the checkpoint location, so a lost executor or a restart goes on from the last batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def _stateful(stream: DataFrame, key: Column, item: Column, order: Column, more: Column, out: str, state: str, step) -> DataFrame:
    """step(held state or None, rows sorted by (order, item) as lists) -> (new state or None, output columns)."""

    def run(k, frames, held):
        import pandas as pd

        got = pd.concat(list(frames), ignore_index=True).sort_values(["_order", "_item"], kind="stable")
        now, columns = step(tuple(held.get) if held.exists else None, got["_item"].tolist(), got["_more"].tolist())
        if now is None:
            if held.exists:
                held.remove()
        else:
            held.update(now)
        n = len(next(iter(columns.values())))
        yield pd.DataFrame({"key": pd.Series([k[0]] * n, dtype="object" if k[0] is None else None)} | columns)

    rows = stream.select(key.alias("_key"), item.cast("long").alias("_item"), order.alias("_order"), more.cast("string").alias("_more")).where("_item IS NOT NULL")
    kind = rows.schema["_key"].dataType.simpleString()
    return rows.groupBy("_key").applyInPandasWithState(run, f"key {kind}, {out}", state, "append", GroupStateTimeout.NoTimeout)


def count_windows(stream: DataFrame, key: Column, item: Column, order: Column, n: int) -> DataFrame:
    """(key, window, place, item): the items of a key in windows of exactly n; fewer than n wait for more."""

    def step(held, items, _):
        waiting, done = (list(held[0]), held[1]) if held else ([], 0)
        items = waiting + items
        full = len(items) // n * n
        at = range(full)
        return (items[full:], done + full // n), {"window": [done + i // n for i in at], "place": [i % n for i in at], "item": items[:full]}

    return _stateful(stream, key, item, order, F.lit(None), "window long, place long, item long", "waiting array<long>, done long", step)


def bounded_queue(stream: DataFrame, key: Column, item: Column, order: Column, take: Column, capacity: int, clear: Column | None = None) -> DataFrame:
    """(key, event, item) of a first-in-first-out queue per key that drops its oldest item when a full one is added to.

    A row with `take` removes the oldest item, others add theirs. Events: put, dropped, consumed; a take on an empty
    queue gives none. See queue_statistics for counts and the size.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")

    def step(held, items, takes):
        queue, events = list(held[0]) if held else [], []
        for i, t in zip(items, takes):
            if t == "clear":
                events += [("cleared", q) for q in queue]
                queue.clear()
                continue
            if t == "take":
                if queue:
                    events.append(("consumed", queue.pop(0)))
                continue
            if len(queue) == capacity:
                events.append(("dropped", queue.pop(0)))
            queue.append(i)
            events.append(("put", i))
        return (queue,), {"event": [e for e, _ in events], "item": [i for _, i in events]}

    more = F.when(F.coalesce(clear if clear is not None else F.lit(False), F.lit(False)), "clear").when(F.coalesce(take, F.lit(False)), "take").otherwise("put")
    return _stateful(stream, key, item, order, more, "event string, item long", "queue array<long>", step)


def queue_statistics(events: DataFrame) -> DataFrame:
    """(key, produced, consumed, dropped, size) from the events of bounded_queue."""
    n = lambda e: F.count_if(F.col("event") == e)
    sums = events.groupBy("key").agg(n("put").alias("produced"), n("consumed").alias("consumed"), n("dropped").alias("dropped"), n("cleared").alias("_cleared"))
    return sums.withColumn("size", F.expr("produced - consumed - dropped - _cleared")).drop("_cleared")


def step_barrier(stream: DataFrame, step: Column, item: Column, order: Column, status: Column) -> DataFrame:
    """(key, item): the successes of a step, once, as soon as no item of it is running.

    The last status of an item counts: running, success, or another one (failed). A step whose rows have been given
    out begins anew if more of it arrive.
    """

    def fold(held, items, statuses):
        last = dict(zip(held[0], held[1])) if held else {}
        last.update(zip(items, statuses))
        if "running" in last.values():
            return (list(last), [s or "" for s in last.values()]), {"item": []}
        return None, {"item": sorted(i for i, s in last.items() if s == "success")}

    return _stateful(stream, step, item, order, status, "item long", "items array<long>, statuses array<string>", fold)


def stale_counts(rows: DataFrame, by: Column, version: Column, current: int) -> DataFrame:
    """(key, n, stale): rows, and those made under a version before the current one. For streams and tables."""
    return rows.groupBy(by.alias("key")).agg(F.count("*").alias("n"), F.count_if(version < current).alias("stale"))


def admits(queued: int, capacity: int, stale: int, most_stale: int) -> bool:
    """Whether generation may go on: the queue has room, and staleness is below its bound."""
    return queued < capacity and stale < most_stale


def required_samples(batch: int, staleness: float, sync_steps: int) -> int:
    """Samples that may be made between two syncs: a batch per step, and the share that may be stale."""
    return int(batch * (staleness + 1) * sync_steps)
