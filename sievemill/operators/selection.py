"""Quality gates, quotas, sample building and balanced partitions."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship, stored
from . import balancing
from .batch import ROW, with_row_index
from .folding import folded_words
from .scoring import phrase_at


#: Rows of a run that greedy_balance() deals in one task, and costs that it packs into a value.
RUN, PACKED = 20_000, 1000


def quotas(total: int, share: float) -> tuple[int, int]:
    """Rows of the first and of the second class: a rounded share (halves to even), at least one row each."""
    first = min(max(round(total * share), 1), total - 1)
    return first, total - first


def take_per_class(df: DataFrame, cls: str, order: str, quota: dict[str, int]) -> DataFrame:
    """The first rows of each class by order, as many as its quota; other classes go. Fails if a class is short."""
    wanted = F.create_map(*[F.lit(x) for kv in quota.items() for x in kv])
    place = F.row_number().over(Window.partitionBy(cls).orderBy(order))
    out = df.where(F.col(cls).isin(list(quota))).withColumn("place", place).where(F.col("place") <= max(quota.values())).where(F.col("place") <= wanted[F.col(cls)])
    got = {r[cls]: r["count"] for r in out.groupBy(cls).count().collect()}
    short = {c: (got.get(c, 0), n) for c, n in quota.items() if got.get(c, 0) < n}
    if short:
        raise ValueError(f"too few rows (found, wanted): {short}")
    return out


def first_failing(*checks: tuple[str, Column]) -> Column:
    """The name of the first check that does not hold (null counts as not), else "accepted"."""
    return F.coalesce(*[F.when(~F.coalesce(c, F.lit(False)), name) for name, c in checks], F.lit("accepted"))


# What people and things of a country are called, by country.
DEMONYMS = {
    "argentina": ("argentine", "argentinian",),
    "australia": ("australian",),
    "austria": ("austrian",),
    "bangladesh": ("bangladeshi",),
    "belgium": ("belgian",),
    "brazil": ("brazilian",),
    "canada": ("canadian",),
    "chile": ("chilean",),
    "china": ("chinese",),
    "colombia": ("colombian",),
    "denmark": ("danish",),
    "egypt": ("egyptian",),
    "england": ("english", "british",),
    "ethiopia": ("ethiopian",),
    "finland": ("finnish",),
    "france": ("french",),
    "germany": ("german",),
    "greece": ("greek",),
    "india": ("indian",),
    "indonesia": ("indonesian",),
    "iran": ("iranian",),
    "iraq": ("iraqi",),
    "ireland": ("irish",),
    "israel": ("israeli",),
    "italy": ("italian",),
    "japan": ("japanese",),
    "kenya": ("kenyan",),
    "malaysia": ("malaysian",),
    "mexico": ("mexican",),
    "netherlands": ("dutch",),
    "new zealand": ("new zealander",),
    "nigeria": ("nigerian",),
    "north korea": ("north korean",),
    "norway": ("norwegian",),
    "pakistan": ("pakistani",),
    "peru": ("peruvian",),
    "philippines": ("filipino", "philippine",),
    "poland": ("polish",),
    "portugal": ("portuguese",),
    "russia": ("russian",),
    "saudi arabia": ("saudi", "saudi arabian",),
    "scotland": ("scottish", "british",),
    "singapore": ("singaporean",),
    "south africa": ("south african",),
    "south korea": ("south korean", "korean",),
    "spain": ("spanish",),
    "sri lanka": ("sri lankan",),
    "sweden": ("swedish",),
    "switzerland": ("swiss",),
    "thailand": ("thai",),
    "turkey": ("turkish",),
    "ukraine": ("ukrainian",),
    "united kingdom": ("british", "english", "scottish", "welsh",),
    "united states": ("american", "u s",),
    "united states of america": ("american", "u s",),
    "uruguay": ("uruguayan",),
    "venezuela": ("venezuelan",),
    "vietnam": ("vietnamese",),
    "wales": ("welsh", "british",),
}


def leakage_reason(question: Column, answer: Column, kind: Column, phrases: Column | None = None) -> Column:
    """"answer_in_question" if the words of the answer stand in the question, "country_demonym_in_question" if one of its phrases does, else null.

    phrases: other names of the answer, an array of folded texts (from a join, where they are many); if not given, DEMONYMS of the
    answer. Comparisons, yes, no and an answer with "or" or "and" within four words of it are exempt. Words are folded ones.
    """
    names = F.create_map(*[x for country, d in DEMONYMS.items() for x in (F.lit(country), F.array(*map(F.lit, d)))])

    def reason(row: Column) -> Column:
        q, a = row["q"], row["a"]
        near = lambda i: F.slice(q, F.greatest(i - 4, F.lit(0)) + 1, F.least(i, F.lit(4)) + F.size(a) + 4)

        def judged(t: Column) -> Column:
            # Words hold no blanks, so the joined words tell whether the answer stands there; its places are sought in the few rows where it does.
            choice = F.exists(phrase_at(q, a), lambda i: F.array_contains(near(i), "or") | F.array_contains(near(i), "and"))
            exempt = row["compares"] | (F.size(a) == 0) | a.isin(F.array(F.lit("yes")), F.array(F.lit("no")))
            called = F.exists(names[t["name"]] if phrases is None else row["p"], lambda p: F.contains(t["line"], F.concat(F.lit(" "), p, F.lit(" "))))
            stands = F.contains(t["line"], F.concat(F.lit(" "), t["name"], F.lit(" ")))
            return F.when(exempt, None).when(stands, F.when(~choice, "answer_in_question")).when(called, "country_demonym_in_question")

        line = F.concat(F.lit(" "), F.array_join(q, " "), F.lit(" "))
        return F.transform(F.array(F.struct(line.alias("line"), F.array_join(a, " ").alias("name"))), judged)[0]

    compares = F.lower(F.trim(F.coalesce(kind, F.lit("")))) == "comparison"
    row = F.struct(folded_words(question).alias("q"), folded_words(answer).alias("a"), compares.alias("compares"), F.lit(None).cast("array<string>").alias("p") if phrases is None else phrases.alias("p"))
    # In an array of one, so that the words are found once and not again at each of their places.
    return F.transform(F.array(row), reason)[0]


def unpivot_pairs(df: DataFrame, prompt: str, *responses: str) -> DataFrame:
    """A row (prompt, response) for each response column."""
    return df.select(F.col(prompt).alias("prompt"), F.explode(F.array(*responses)).alias("response"))


def rename_roles(role: Column, names: dict[str, str]) -> Column:
    """Roles under their new names; an unknown one fails."""
    out = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[role]
    return F.coalesce(out, F.raise_error(F.concat(F.lit("unknown role "), F.coalesce(role, F.lit("null")))).cast("string"))


def workload(n: Column) -> Column:
    """Cost of a sequence of n tokens: linear layers and attention."""
    return n * 24576 + n * n


def differencing(costs: list[int], k: int) -> list[int]:
    """The part, 0 to k - 1, of each cost, by largest differencing."""
    part = [0] * len(costs)
    for j, items in enumerate(balancing.differencing(costs, k)):
        for i in items:
            part[i] = j
    return part


def greedy(costs: list[int], k: int) -> list[int]:
    """Each cost, in order, to the lightest part."""
    heap, out = [(0, j) for j in range(k)], []
    for c in costs:
        s, j = heap[0]
        heapq.heapreplace(heap, (s + c, j))
        out.append(j)
    return out


def balance(df: DataFrame, key: str, cost: str, k: int) -> DataFrame:
    """Column part: all rows in k parts by largest differencing, in pieces if they are many (balancing.spread)."""
    planned = balancing.spread(df.select(key, cost, F.lit(0).alias("_all")), "_all", key, F.col(cost).cast("long"), k, full=False)
    return df.join(planned.select(key, "part"), key)


def greedy_from(costs: list[int], loads: list[int]) -> list[int]:
    """greedy() on parts that hold something already; loads are brought up to date."""
    heap, out = [(s, j) for j, s in enumerate(loads)], []
    heapq.heapify(heap)
    for c in costs:
        s, j = heap[0]
        heapq.heapreplace(heap, (s + c, j))
        out.append(j)
    for s, j in heap:
        loads[j] = s
    return out


def greedy_balance(df: DataFrame, key: str, cost: str, k: int) -> DataFrame:
    """Column part: rows in order of key, each to the part that is lightest then; exactly what greedy() does with all of them.

    Each choice depends on all before it, so the costs alone, packed, pass through one task as a stream that
    keeps k loads and tells them at the start of each run of RUN rows; from there the runs are dealt side by side.
    """
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    rows = with_row_index(df.select(key, F.col(cost).cast("long").alias("_cost")), key).withColumn("_run", F.expr(f"{ROW} div {RUN}"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        costs, run = frame.sort_values(ROW)["_cost"].to_numpy("int64"), int(frame["_run"].iloc[0])
        return pd.DataFrame([(run, at, costs[at : at + PACKED].tobytes()) for at in range(0, len(costs), PACKED)], columns=["_run", "_at", "costs"])

    def starts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loads = [0] * k
        for frame in frames:
            out = []
            for run, at, costs in zip(frame["_run"], frame["_at"], frame["costs"]):
                if not at:
                    out.append((run, list(loads)))
                greedy_from(np.frombuffer(costs, "int64").tolist(), loads)
            yield pd.DataFrame(out, columns=["_run", "loads"])

    def deal(frame: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(ROW)
        return pd.DataFrame({key: frame[key], "part": greedy_from(frame["_cost"].tolist(), [int(x) for x in start["loads"].iloc[0]])})

    packed = rows.groupBy("_run").applyInPandas(pack, "_run long, _at long, costs binary")
    loads = stored(packed.repartition(1).sortWithinPartitions("_run", "_at").mapInPandas(starts, "_run long, loads array<long>"), "loads")
    planned = rows.groupBy("_run").cogroup(loads.groupBy("_run")).applyInPandas(deal, f"{key} {kind}, part int")
    return df.join(planned, key)
