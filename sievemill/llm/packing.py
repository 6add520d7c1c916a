"""Best-fit packing of tokenised documents into sequences by a grouping genetic algorithm.

Only lengths matter to the packing, and there are fewer lengths than a sequence has tokens; so an individual is a
packing of the whole corpus as patterns (the lengths in one sequence) with multiplicities, whose size does not grow with
the corpus. Crossover injects whole well-filled sequences of one parent, removes what the other parent holds of the same
documents, and best-fits the displaced ones; mutation dissolves some sequences, the emptiest first. Islands evolve in
executor tasks and pass their elites on in a ring after each epoch. The search ends when a packing has as few sequences as
the lower bound, after PATIENCE epochs without a better one, or after EPOCHS epochs.
The winning plan turns the rank of a document among those of its length into a sequence and a place; ranks come from
counts by (partition, length), so no document is shuffled and no length, however frequent, is gathered in one task.

Defined results: null and empty texts are the end id alone; repeated rows are packed each; rows without doc_id are packed
like others; a very long text is cut into pieces, and encoded as a run of its own; an empty table has no pieces; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .encoder import PIECE, encoder

#: Islands, individuals on each, epochs at most (with a migration after each) and without a better packing, children in an epoch.
ISLANDS, POPULATION, EPOCHS, PATIENCE, CHILDREN = 8, 6, 12, 3, 60
#: Up to so many partitions of the token table, their rank offsets (8 KB each) are broadcast; beyond, joined by a shuffle.
BROADCAST_PARTS = 2048


def tokenize(docs: DataFrame, vocab: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, ids (little-endian 32-bit, with the end id), n, rest (length of the first piece), and places within the task's part: part, rank among rows of that rest, full (whole pieces before)."""
    common.prepare(docs.sparkSession)

    def run(batches):
        part, code = TaskContext.get().partitionId(), encoder(vocab, "spaced")
        seen, full = np.zeros(capacity + 1, np.int64), 0
        for batch in batches:
            data, offsets = common.utf8(batch.column(1))
            for a, b in common.pieces(offsets, PIECE):
                ids, o = code.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n = np.diff(o) + 1
                ids = np.insert(ids, o[1:], end_id).astype("<u4")
                rest = (n - 1) % capacity + 1
                by = np.argsort(rest, kind="stable")
                head = np.searchsorted(rest[by], rest[by])
                rank = np.empty(len(n), np.int64)
                rank[by] = np.arange(len(n)) - head + seen[rest[by]]
                seen += np.bincount(rest, minlength=capacity + 1)
                whole = (n - 1) // capacity + (rest == capacity)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), common.binary_array(ids.view(np.uint8), np.append(0, np.cumsum(n)) * 4), pa.array(n), pa.array(rest), pa.array(np.full(len(n), part)), pa.array(rank), pa.array(full + np.cumsum(whole) - whole)], names=["doc_id", "ids", "n", "rest", "part", "rank", "full"])
                full += int(whole.sum())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary, n long, rest long, part long, rank long, full long")


def best_fit(items: dict[int, int], bins: Counter, capacity: int, order=None) -> Counter:
    """bins (pattern -> how many) with the items (length -> how many) added, longest first, each where it leaves least room."""
    room: dict[int, list] = {}
    mask = 0
    out: Counter = Counter()
    for pattern, m in bins.items():
        left = capacity - sum(pattern)
        room.setdefault(left, []).append((pattern, m))
        mask |= 1 << left

    def put(pattern, m):
        nonlocal mask
        left = capacity - sum(pattern)
        room.setdefault(left, []).append((pattern, m))
        mask |= 1 << left

    for r in order or sorted(items, reverse=True):
        c = items[r]
        while c:
            above = mask >> r
            if above:
                left = (above & -above).bit_length() - 1 + r
                pattern, m = room[left].pop()
                if not room[left]:
                    mask &= ~(1 << left)
            else:
                left, pattern, m = capacity, (), 1 << 62
            q = left // r
            k = min(m, c // q)
            if k:
                put(tuple(sorted(pattern + (r,) * q, reverse=True)), k)
                c -= k * q
                m -= k
            elif m:
                put(tuple(sorted(pattern + (r,) * c, reverse=True)), 1)
                c, m = 0, m - 1
            if m and pattern:
                put(pattern, m)
    for entries in room.values():
        for pattern, m in entries:
            out[pattern] += m
    return out


def fitness(bins: Counter, capacity: int) -> tuple[int, float]:
    """Fewer sequences first, then the fuller ones."""
    n = sum(bins.values())
    return -n, sum(m * (sum(p) / capacity) ** 2 for p, m in bins.items()) / max(1, n)


def lower_bound(need: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs.

    For each limit up to half the capacity, documents over capacity - limit are alone, and share no sequence with one of
    `limit` ids or more; those over half are in a sequence each, and what smaller ones of at least `limit` ids don't fit into
    the rest of these needs more. Without a limit: all ids.
    """
    best = -(-sum(r * c for r, c in need.items()) // capacity)
    for limit in {0, *(r for r in need if 2 * r <= capacity)}:
        alone = sum(c for r, c in need.items() if r > capacity - limit)
        half = {r: c for r, c in need.items() if 2 * r > capacity and r <= capacity - limit}
        room = sum((capacity - r) * c for r, c in half.items())
        small = sum(r * c for r, c in need.items() if limit <= r and 2 * r <= capacity)
        best = max(best, alone + sum(half.values()) + max(0, -(-(small - room) // capacity)))
    return best


def _remains(need: dict[int, int], kept: Counter) -> dict[int, int]:
    """The documents that kept leaves."""
    left = Counter(need)
    for pattern, m in kept.items():
        for r in pattern:
            left[r] -= m
    return {r: c for r, c in left.items() if c}


def crossover(a: Counter, b: Counter, need: dict[int, int], capacity: int, rng: random.Random) -> Counter:
    """A child: well-filled sequences of b, those of a that hold other documents, and the displaced documents best-fitted."""
    left, child = dict(need), Counter()

    def take(pattern, m):
        kinds = set(pattern)
        for r in kinds:
            m = min(m, left[r] // pattern.count(r))
            if not m:
                return
        child[pattern] += m
        for r in kinds:
            left[r] -= m * pattern.count(r)

    share = rng.uniform(0.2, 0.8)
    for pattern, m in b.items():
        if sum(pattern) >= 0.995 * capacity and rng.random() < share:
            take(pattern, m)
    # Of a, fuller sequences are kept first.
    for pattern, m in sorted(a.items(), key=lambda x: (-sum(x[0]), x[0])):
        take(pattern, m)
    return best_fit({r: c for r, c in left.items() if c}, child, capacity)


def mutate(bins: Counter, need: dict[int, int], capacity: int, rng: random.Random) -> Counter:
    """Sequences of some patterns are dissolved, emptier ones likelier, and their documents best-fitted in another order."""
    rate = rng.uniform(0.02, 0.3)
    kept = Counter()
    for pattern, m in bins.items():
        gone = rng.random() < rate + 20 * (1 - sum(pattern) / capacity)
        if not gone:
            kept[pattern] = m
        elif m > 1 and rng.random() < 0.5:
            kept[pattern] = m - rng.randrange(1, m)
    left = _remains(need, kept)
    order = sorted(left, key=lambda r: -r * rng.uniform(0.9, 1.0))
    return best_fit(left, kept, capacity, order)


def evolve(population: list[Counter], need: dict[int, int], capacity: int, seed: int) -> list[Counter]:
    """One island's epoch, best first."""
    rng = random.Random(seed)
    while len(population) < POPULATION:
        order = sorted(need, key=lambda r: -r * rng.uniform(0.97, 1.0))
        population.append(best_fit(need, Counter(), capacity, order if population else None))
    least = lower_bound(need, capacity)
    # Each individual is measured once.
    held = [(fitness(x, capacity), x) for x in population]
    order = lambda m: m[0]
    for _ in range(CHILDREN):
        if min(-f[0] for f, _ in held) == least:
            break
        a, b = (max(rng.sample(held, 2), key=order)[1] for _ in range(2))
        child = crossover(a, b, need, capacity, rng)
        if rng.random() < 0.5:
            child = mutate(child, need, capacity, rng)
        held.append((fitness(child, capacity), child))
        held.sort(key=order, reverse=True)
        del held[POPULATION:]
    return [x for _, x in sorted(held, key=order, reverse=True)]


def plan(spark: SparkSession, need: dict[int, int], capacity: int) -> Counter:
    """The best packing that the islands find, as patterns with multiplicities."""
    if not need:
        return Counter()

    def epoch(key, frame):
        members = [pickle.loads(g) for g in frame.sort_values("no")["genome"] if g]
        island, turn = int(key[0]), int(frame["turn"].max())
        best = evolve(members, need, capacity, 1000 * turn + island)
        return pd.DataFrame({"island": island, "no": range(len(best)), "turn": turn + 1, "genome": [pickle.dumps(x) for x in best], "size": [-fitness(x, capacity)[0] for x in best], "fill": [fitness(x, capacity)[1] for x in best]})

    schema = "island long, no long, turn long, genome binary, size long, fill double"
    state = spark.range(ISLANDS).select(F.col("id").alias("island"), F.lit(0).cast("long").alias("no"), F.lit(0).cast("long").alias("turn"), F.lit(None).cast("binary").alias("genome"), F.lit(0).cast("long").alias("size"), F.lit(0.0).alias("fill"))
    least, best, since = lower_bound(need, capacity), None, 0
    for _ in range(EPOCHS):
        state = common.written(state.repartition(ISLANDS, "island").groupBy("island").applyInPandas(epoch, schema), "islands")
        size = state.agg(F.min("size")).first()[0]
        best, since = (size, 0) if best is None or size < best else (best, since + 1)
        if best == least or since == PATIENCE:
            break
        # Elites move on to the next island, in the place after its own.
        elites = state.where("no = 0").withColumns({"island": (F.col("island") + 1) % ISLANDS, "no": F.lit(POPULATION).cast("long")})
        state = state.unionByName(elites)
    return pickle.loads(state.orderBy("size", F.desc("fill"), "island", "no").first()["genome"])


def segments(bins: Counter) -> tuple[np.ndarray, ...]:
    """The plan by length: (length, first rank, first sequence, documents a sequence, offset of the first of them)."""
    base, rank, rows = 0, Counter(), []
    for pattern, m in sorted(bins.items(), reverse=True):
        at = 0
        for r, k in sorted(Counter(pattern).items(), reverse=True):
            rows.append((r, rank[r], base, k, at))
            rank[r] += m * k
            at += r * k
        base += m
    rows.sort()
    return tuple(np.array(rows, np.int64).reshape(-1, 5).T)


def pack(docs: DataFrame, vocab: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Pieces of all docs(doc_id, text) in sequences of at most `capacity` ids: doc_id, piece, start, length, ids, sequence_id, offset.

    ids are little-endian unsigned 32-bit. A document of more than `capacity` ids is cut into pieces of that size, of
    which the first may be shorter. Full pieces have sequences of their own, with negative numbers.
    """
    spark = docs.sparkSession
    table = common.written(tokenize(docs, vocab, end_id, capacity), "tokens")
    counts = table.where(F.col("rest") < capacity).groupBy("part", "rest").agg(F.count("*").alias("c"))
    ranked = counts.withColumn("before", F.sum("c").over(Window.partitionBy("rest").orderBy("part")) - F.col("c"))
    ranked = common.written(ranked, "ranks")
    need = {r["rest"]: r["c"] for r in ranked.groupBy("rest").agg(F.sum("c").alias("c")).collect()}  # below `capacity` rows
    length, first, base, each, place = segments(plan(spark, need, capacity))
    keys = length * (1 << 40) + first
    offsets = ranked.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("rest", "before"))).alias("before"))
    if ranked.select("part").distinct().count() <= BROADCAST_PARTS:
        offsets = F.broadcast(offsets)
    rows = table.join(offsets, "part", "left").select("doc_id", "ids", "n", "rest", "part", "full", (F.col("rank") + F.coalesce(F.col("before")[F.col("rest")], F.lit(0))).alias("rank"))

    def place_all(batches):
        for batch in batches:
            n, rest, part, full, rank = (batch.column(k).to_numpy() for k in range(2, 7))
            data, o = common.utf8(batch.column(1))
            sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            short = np.flatnonzero(rest < capacity)
            k = np.searchsorted(keys, rest[short] * (1 << 40) + rank[short], "right") - 1
            step = rank[short] - first[k] if len(short) else k
            if len(short):
                sequence[short] = base[k] + step // each[k]
                offset[short] = place[k] + step % each[k] * length[k]
            cut = (n - 1) // capacity + 1
            doc = np.repeat(np.arange(len(n)), cut)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(cut) - cut, cut)
            start = np.where(piece > 0, rest[doc] + (piece - 1) * capacity, 0)
            size = np.where(piece > 0, capacity, rest[doc])
            own = -1 - (part[doc] * (1 << 40) + full[doc] + piece - (rest[doc] < capacity))
            alone = size == capacity
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), common.binary_array(data, np.append(o[doc] + start * 4, o[-1])), pa.array(np.where(alone, own, sequence[doc])), pa.array(np.where(alone, 0, offset[doc]))], names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])

    return rows.mapInArrow(place_all, "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long")


def pieces_digest(packed: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of the ids."""
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
