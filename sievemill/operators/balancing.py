"""Plans that balance batches: parts of like cost, micro-batches within a token budget, groups that stay whole.

Plans are heuristics. A batch of up to WHOLE rows is planned in the task that its rows meet in; a larger one in pieces of about
PIECE rows, each in a task of its own, whose parts are then merged as the method merges any two solutions. Nothing comes to
the driver but the greatest size of a batch and the number of batches.
"""

from __future__ import annotations

import heapq
from bisect import insort_left, insort_right
from collections.abc import Callable
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship, stored
from .batch import ROW, with_row_index

#: Rows of a batch that one task plans at most, and rows of a piece of a larger one.
WHOLE, PIECE = 200_000, 50_000


def ceil_div(a: Column, b) -> Column:
    return F.ceil(a / b).cast("long")


def round_up(a: Column, b) -> Column:
    return ceil_div(a, b) * b


def cost_of(n: int) -> int:
    """Cost of a sequence of n tokens: linear layers and attention."""
    return n * 24576 + n * n


class _Part:
    """Items of a part as a tree, so that joining two costs nothing."""

    __slots__ = ("sum", "size", "items")

    def __init__(self, total: int = 0, size: int = 0, items: tuple = ()):
        self.sum, self.size, self.items = total, size, items

    def joined(self, other: _Part) -> _Part:
        return _Part(self.sum + other.sum, self.size + other.size, (self.items, other.items))

    def flat(self) -> list[int]:
        out, stack = [], [self.items]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack.extend(x)
            else:
                out.append(x)
        return sorted(out)


def _by(p: _Part) -> tuple[int, int]:
    return -p.sum, -p.size


def _met(a: list[_Part], b: list[_Part], k: int) -> list[_Part]:
    """Two solutions as one, heaviest part first: the i-th heaviest part of one meets the i-th lightest of the other, which is mostly an empty one.

    A short solution is put into a long one part by part, so that a part costs a search and not a pass over the long one.
    """
    alone = max(0, k - len(a))
    if 8 * len(b) <= len(a):
        first = max(0, k - len(b))
        moved = [a[i].joined(b[k - 1 - i]) for i in range(first, len(a))] + b[:alone]
        del a[first:]
        for p in moved:
            insort_right(a, p, key=_by)
        return a
    met = [p.joined(b[k - 1 - i]) if k - 1 - i < len(b) else p for i, p in enumerate(a)]
    if 8 * len(a) <= len(b):
        del b[alone:]
        for p in reversed(met):
            insort_left(b, p, key=_by)
        return b
    return sorted(met + b[:alone], key=_by)


def merged(solutions: list[list[_Part]], k: int) -> list[_Part]:
    """One solution of all, largest spread first. A solution lists its parts that hold something, heaviest first; the others weigh nothing."""
    spread = lambda parts: parts[0].sum - (parts[-1].sum if len(parts) == k else 0)
    heap = [(-spread(parts), at, parts) for at, parts in enumerate(solutions)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, at, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = _met(a, b, k)
        heapq.heappush(heap, (-spread(both), at, both))
    return heap[0][2] if heap else []


def differencing(costs: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """k parts of indices by largest differencing: the two solutions of the widest spread are merged, heaviest part with lightest.

    With equal_size all parts have as many items; the number of costs has to be a multiple of k.
    """
    if equal_size and len(costs) % k:
        raise ValueError(f"{len(costs)} items don't make {k} parts of one size")
    order = sorted(range(len(costs)), key=lambda i: (costs[i], i))
    step = k if equal_size else 1
    parts = merged([sorted((_Part(costs[i], 1, (i,)) for i in order[at : at + step]), key=_by) for at in range(0, len(order), step)], k)
    return [p.flat() for p in parts] + [[] for _ in range(k - len(parts))]


def balanced(costs: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """differencing(), with the guarantee that no part is empty."""
    if len(costs) < k:
        raise ValueError(f"{len(costs)} items cannot fill {k} parts")
    parts = differencing(costs, k, equal_size)
    if not all(parts):
        raise ValueError("a part is empty")
    return parts


def both_ends(parts: list[list[int]], costs: list[int]) -> list[list[int]]:
    """parts with the cheapest at both ends and the dearest in the middle."""
    by = sorted(parts, key=lambda p: (sum(costs[i] for i in p), p[0] if p else 0), reverse=True)
    return by[::2][::-1] + by[1::2]


def whole_groups(lengths: list[int], groups: list, k: int) -> list[list[int]]:
    """k parts with as many groups each, by the cost of the groups; rows of a group follow each other and stay together."""
    members: list[list[int]] = []
    for i, g in enumerate(groups):
        if i and g == groups[i - 1]:
            members[-1].append(i)
        else:
            members.append([i])
    parts = balanced([sum(cost_of(lengths[i]) for i in m) for m in members], k, True)
    return [sorted(chain.from_iterable(members[j] for j in p)) for p in parts]


def micro_batches(lengths: list[int], budget: int, least: int = 1, divisor: int = 1, group: int = 1, order: bool = True) -> list[list[int]]:
    """Micro-batches of about `budget` tokens: as many as all tokens need, at least `least`, a multiple of `divisor`; `group` rows stay together."""
    if lengths and max(lengths) > budget:
        raise ValueError(f"a sequence of {max(lengths)} tokens is over the budget of {budget}")
    if len(lengths) % group:
        raise ValueError(f"{len(lengths)} rows are no multiple of {group}")
    units = len(lengths) // group
    count = max(least, min(units, -(-sum(lengths) // budget)))
    count = -(-count // divisor) * divisor
    if count > units:
        raise ValueError(f"{count} micro-batches of {units} units")
    costs = [sum(map(cost_of, lengths[u * group : (u + 1) * group])) for u in range(units)]
    parts = balanced(costs, count)
    parts = both_ends(parts, costs) if order else parts
    return [[u * group + j for u in p for j in range(group)] for p in parts]


def ranks(lengths: list[int], k: int) -> list[list[int]]:
    """k parts of one size for the ranks of a data-parallel step, each with its cheap rows at both ends."""
    costs = list(map(cost_of, lengths))
    out = []
    for p in balanced(costs, k, True):
        p = sorted(p, key=lambda i: (costs[i], i))
        out.append(p[::2] + p[1::2][::-1])
    return out


def with_sizes(rows: DataFrame, batch: str, sizes: DataFrame, batches: int) -> DataFrame:
    """rows with what is known of their batch; few batches are sent to the rows, which then stay where they are."""
    return rows.join(F.broadcast(sizes) if batches < 1 << 20 else sizes, batch)


def numbered(df: DataFrame, batch: str, *order: str) -> DataFrame:
    """Column row_idx: the rows of each batch from 0, by a total order, however many a batch has."""
    rows = with_row_index(df, batch, *order)
    starts = rows.groupBy(batch).agg(F.min(ROW).alias("_start"))
    return with_sizes(rows, batch, starts, starts.count()).withColumn(ROW, F.col(ROW) - F.col("_start")).drop("_start")


def trimmed(df: DataFrame, batch: str, key: str, k: int) -> DataFrame:
    """df without the last rows of each batch, by key, so that the rows of every batch divide by k."""
    last = df.select(batch, key, F.row_number().over(Window.partitionBy(batch).orderBy(F.col(key).desc())).alias("_last")).where(F.col("_last") < k)
    over = last.join(df.groupBy(batch).agg((F.count(F.lit(1)) % k).alias("_over")), batch).where(F.col("_last") <= F.col("_over"))
    return df.join(over.select(batch, key), [batch, key], "left_anti")


def spread(df: DataFrame, batch: str, key: str, cost: Column, parts: int | Column, equal_size: bool = False, full: bool = True) -> DataFrame:
    """(batch, key, part) of every row: the rows of each batch in parts of like cost, by differencing.

    parts: how many, for all batches or as an aggregate over a batch. full: a part must not be empty. Rows of like cost are told
    apart by key, which is unique in a batch.

    A batch of more than WHOLE rows is dealt to pieces by the rank of its costs. If many parts of few rows are wanted, a piece
    gets its share of the parts: rows go to as many places as there are parts, forth and back from the dearest to the
    cheapest, so places are of like cost, and a piece takes every so-manieth place. If few parts of many rows are wanted, a
    piece takes every so-manieth run of as many rows as there are parts and is cut into all of them; the pieces' solutions are
    merged by their sums alone.
    """
    ship(df.sparkSession)
    kind = lambda c: df.schema[c].dataType.simpleString()
    rows = stored(df.withColumn("_cost", cost), "spread")
    count = F.lit(parts).cast("long") if isinstance(parts, int) else parts.cast("long")
    sizes = rows.groupBy(batch).agg(F.count(F.lit(1)).alias("_n"), F.max(count).alias("_k") if isinstance(parts, int) else count.alias("_k"))
    most, batches = sizes.agg(F.max("_n"), F.count(F.lit(1))).first()
    large = (most or 0) > WHOLE
    if large:
        rows = numbered(rows.select(batch, key, "_cost"), batch, "_cost", key)
    rows = with_sizes(rows, batch, sizes, batches)
    if large:
        n, k = F.col("_n"), F.col("_k")
        whole, dealt = n <= WHOLE, n <= k * (PIECE // 8)
        down = n - 1 - F.col(ROW)
        turn, at = F.expr(f"(_n - 1 - {ROW}) div _k"), down % k
        place = F.when(turn % 2 == 0, at).otherwise(k - 1 - at)
        pieces = F.least(F.ceil(n / PIECE), k)
        run = F.expr(f"{ROW} div _k") % F.ceil(n / PIECE)
        rows = rows.withColumns({"_piece": F.when(whole, 0).when(dealt, place % pieces).otherwise(run), "_step": F.when(~whole & dealt, pieces).otherwise(1), "_merge": ~whole & ~dealt})
        rows = rows.withColumn("_own", F.when(F.col("_step") > 1, F.expr("(_k - _piece + _step - 1) div _step")).otherwise(k))
    else:
        rows = rows.withColumns({"_piece": F.lit(0), "_step": F.lit(1), "_merge": F.lit(False), "_own": F.col("_k")})
    rows = rows.select(batch, key, "_cost", *[F.col(c).cast("long") for c in ("_piece", "_step", "_own")], "_merge")

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(key, kind="stable")
        own, step, piece = int(frame["_own"].iloc[0]), int(frame["_step"].iloc[0]), int(frame["_piece"].iloc[0])
        costs = frame["_cost"].tolist()
        # Pieces that are merged may lack a part each.
        cut = (balanced if full and not frame["_merge"].iloc[0] else differencing)(costs, own, equal_size)
        part = [0] * len(costs)
        for j, items in enumerate(cut):
            for i in items:
                part[i] = piece + j * step if step > 1 else j
        return frame[[batch, key, "_cost", "_piece", "_merge"]].assign(part=part)

    out = rows.groupBy(batch, "_piece").applyInPandas(one, f"{batch} {kind(batch)}, {key} {kind(key)}, _cost long, _piece long, _merge boolean, part int")
    if not large:
        return out.select(batch, key, "part")
    out = stored(out, "pieces")
    sums = out.where("_merge").groupBy(batch, "_piece", "part").agg(F.sum("_cost").alias("_sum"), F.count(F.lit(1)).alias("_rows")).join(sizes, batch)

    def together(frame: pd.DataFrame) -> pd.DataFrame:
        k, pieces = int(frame["_k"].iloc[0]), {}
        for p, j, s, n in zip(frame["_piece"].tolist(), frame["part"].tolist(), frame["_sum"].tolist(), frame["_rows"].tolist()):
            pieces.setdefault(p, []).append(_Part(s, n, ((p << 32) + j,)))
        parts = merged([sorted(pieces[p], key=lambda x: (*_by(x), x.items)) for p in sorted(pieces)], k)
        if full and len(parts) < k:
            raise ValueError("a part is empty")
        found = [(x >> 32, x & 0xFFFFFFFF, j) for j, p in enumerate(parts) for x in p.flat()]
        names = pd.DataFrame(found, columns=["_piece", "part", "_to"])
        return names.assign(**{batch: [frame[batch].iloc[0]] * len(names)})

    to = sums.groupBy(batch).applyInPandas(together, f"{batch} {kind(batch)}, _piece long, part int, _to int")
    return out.join(to, [batch, "_piece", "part"], "left").select(batch, key, F.coalesce("_to", "part").alias("part"))


def cost_column(n: Column) -> Column:
    """cost_of() of a column."""
    n = n.cast("long")
    return n * 24576 + n * n


def micro_batch_plan(df: DataFrame, batch: str, key: str, length: str, budget: int, least: int = 1, divisor: int = 1) -> DataFrame:
    """(batch, key, part, place) by the rules of micro_batches() for single rows, for batches of any size."""
    n, tokens = F.count(F.lit(1)), F.sum(length)
    wanted = F.greatest(F.lit(least), F.least(n, F.ceil(tokens / budget)))
    wanted = F.expr(f"{divisor}L") * F.ceil(wanted / divisor)
    fail = lambda *text: F.raise_error(F.concat(*[F.lit(t) if isinstance(t, str) else t.cast("string") for t in text])).cast("long")
    count = F.when(F.max(length) > budget, fail("a sequence of ", F.max(length), f" tokens is over the budget of {budget}")).when(wanted > n, fail(wanted, " micro-batches of ", n, " units")).otherwise(wanted)
    rows = stored(df.select(batch, key, length), "micro-batches")
    planned = stored(spread(rows, batch, key, cost_column(F.col(length)), count).join(rows, [batch, key]), "micro-batch-parts")
    # The cheapest at both ends and the dearest in the middle, as both_ends() has them.
    parts = planned.groupBy(batch, "part").agg(F.sum(cost_column(F.col(length))).alias("_sum"), F.min(key).alias("_first"))
    parts = parts.withColumns({"_j": F.row_number().over(Window.partitionBy(batch).orderBy(F.desc("_sum"), F.desc("_first"))) - 1, "_m": F.ceil(F.count(F.lit(1)).over(Window.partitionBy(batch)) / 2)})
    to = parts.select(batch, "part", F.when(F.col("_j") % 2 == 0, F.col("_m") - 1 - F.expr("_j div 2")).otherwise(F.col("_m") + F.expr("_j div 2")).cast("int").alias("_to"))
    out = planned.join(to, [batch, "part"]).select(batch, key, F.col("_to").alias("part"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy(batch, "part").orderBy(key)) - 1)


def rank_plan(df: DataFrame, batch: str, key: str, length: str, k: int) -> DataFrame:
    """(batch, key, part, place) by the rules of ranks(), for batches of any size; the rows of a batch must divide by k.

    The place numbers a part in one task, streaming; where it is not asked for, Spark leaves it out.
    """
    cost = cost_column(F.col(length))
    out = spread(df.select(batch, key, length), batch, key, cost, k, True).join(df.select(batch, key, cost.alias("_cost")), [batch, key])
    part = Window.partitionBy(batch, "part")
    at, size = F.row_number().over(part.orderBy("_cost", key)) - 1, F.count(F.lit(1)).over(part)
    return out.withColumns({"_at": at, "_size": size}).select(batch, key, "part", F.when(F.col("_at") % 2 == 0, F.expr("_at div 2")).otherwise(F.col("_size") - 1 - F.expr("_at div 2")).cast("int").alias("place"))


def group_plan(df: DataFrame, batch: str, group: str, length: str, k: int) -> DataFrame:
    """(batch, group, part): k parts with as many groups each, by the cost of the groups; what whole_groups() does, for batches of any size.

    Groups are summed before they are planned, so all rows of one go where it goes. The last groups that don't divide by k have no part.
    """
    groups = df.groupBy(batch, group).agg(F.sum(cost_column(F.col(length))).alias("_of"))
    return spread(trimmed(groups, batch, group, k), batch, group, F.col("_of"), k, True)


def inverse(order: Column) -> Column:
    """The inverse of a permutation of 0 to n - 1, as an array."""
    pairs = F.array_sort(F.transform(order, lambda x, i: F.struct(x.cast("long").alias("x"), i.cast("long").alias("i"))))
    return F.transform(pairs, lambda p: p["i"])


def unbalance(planned: DataFrame, batch: str, cost: str, k: int, at: str = ROW) -> DataFrame:
    """A row for each batch: least and most tokens of k parts, as the rows come (column `at`, from 0) and as planned (column part), and their mean."""
    sizes = planned.groupBy(batch).agg(F.count(F.lit(1)).alias("_n"), F.sum(cost).alias("_all"))
    joined = planned.join(sizes, batch)
    chunk = F.floor(F.col(at) / F.floor(F.col("_n") / k))
    before = joined.groupBy(batch, chunk.alias("_c")).agg(F.sum(cost).alias("s")).groupBy(batch).agg(F.min("s").alias("min"), F.max("s").alias("max"))
    after = joined.groupBy(batch, "part").agg(F.sum(cost).alias("s")).groupBy(batch).agg(F.min("s").alias("balanced_min"), F.max("s").alias("balanced_max"))
    return before.join(after, batch).join(sizes, batch).select(batch, "min", "max", (F.col("max") - F.col("min")).alias("minmax_diff"), "balanced_min", "balanced_max", (F.col("_all") / k).alias("mean"))


# Workers ---------------------------------------------------------------------------------------------------------------


def to_all(df: DataFrame, workers: int) -> DataFrame:
    """Every row for every worker; column worker. df is what all of them need, so it has to be small."""
    return df.withColumn("worker", F.explode(F.sequence(F.lit(0), F.lit(workers - 1))))


def to_ranks(df: DataFrame, rows: int, ranks_: int) -> DataFrame:
    """Rows (numbered by row_idx, `rows` in all) dealt to ranks in runs of one size; the last rows that fill them up are copies of the first."""
    size = -(-rows // ranks_)
    fill = size * ranks_ - rows
    more = df.where(F.col(ROW) < fill).withColumn(ROW, F.col(ROW) + rows) if fill <= rows else None
    if more is None:
        raise ValueError(f"{rows} rows cannot be filled up to {size * ranks_}")
    return df.unionByName(more).withColumn("rank", F.floor(F.col(ROW) / size).cast("int"))


def to_mesh(ranked: DataFrame, rank_of: list[int]) -> DataFrame:
    """Rows of a rank for each worker of that rank; rank_of: the rank of every worker."""
    workers = F.array(*[F.struct(F.lit(r).alias("rank"), F.lit(w).alias("worker")) for w, r in enumerate(rank_of)])
    mine = F.filter(workers, lambda x: x["rank"] == F.col("rank"))
    return ranked.withColumn("worker", F.explode(F.transform(mine, lambda x: x["worker"])))


def from_mesh(results: DataFrame, keep: list[bool], rows: int | None = None) -> DataFrame:
    """The results of those workers that keep names, one of each rank, without filled-up rows."""
    out = results.where(F.col("worker").isin([w for w, k in enumerate(keep) if k])).drop("worker")
    return out if rows is None else out.where(F.col(ROW) < rows)
