"""A judge's decisions: reading, checking and caching them, and filling quotas with what they accept.

The judge is any function of a row; rows that the cache holds never reach it. Candidates come in a seeded order, and
quotas are filled in that order, so a run that is repeated with its cache gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

# The fields of a decision.
FLAGS = ("direct_answerable", "single_document_sufficient", "needs_both_documents")
COUNTS = ("minimum_evidence_documents", "ideal_search_calls")
REASON_CHARS = 1000


def candidates(rows: DataFrame, seed: int, key: str, where: Column | None = None) -> DataFrame:
    """rows that pass, with `turn`: their place in a seeded order is that of its values."""
    rows = rows if where is None else rows.where(where)
    return rows.withColumn("turn", F.xxhash64(F.lit(seed), key))


def decision(text: Column, patterns: list[str]) -> Column:
    """A decision's JSON as a struct, or null if a field is missing, of another type or out of its range (0 to 3; a boolean is no number)."""
    v = F.try_parse_json(text)
    raw = lambda n: F.to_json(F.try_variant_get(v, f"$.{n}", "variant"))
    flags = {n: F.when(raw(n) == "true", True).when(raw(n) == "false", False) for n in FLAGS}
    counts = {n: F.when(raw(n).rlike("^[0-3]$"), raw(n).cast("int")) for n in COUNTS}
    is_text = lambda n: F.startswith(raw(n), F.lit('"'))
    pattern, reason = (F.when(is_text(n), F.try_variant_get(v, f"$.{n}", "string")) for n in ("search_pattern", "reason"))
    pattern, reason = F.when(pattern.isin(patterns), pattern), F.regexp_replace(reason, r"(?U)\A\s+|\s+\z", "")
    fields = {**flags, **counts, "search_pattern": pattern, "reason": F.when(reason != "", F.left(reason, F.lit(REASON_CHARS)))}
    whole = F.lit(True)
    for c in fields.values():
        whole = whole & c.isNotNull()
    return F.when(whole, F.struct(*[c.alias(n) for n, c in fields.items()]))


def unjudged(rows: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that the cache lacks."""
    return rows.join(cache.select(*keys).distinct(), keys, "left_anti")


def judged(rows: DataFrame, keys: list[str], judge: Callable[[dict], str], tries: int = 3) -> DataFrame:
    """(keys, answer, error) of the judge's answer to each row; one that fails `tries` times has a null answer and says why."""
    ship(rows.sparkSession)
    schema = rows.select(*keys, *[F.lit(None).cast("string").alias(c) for c in ("answer", "error")]).schema

    def run(frames):
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                answer = error = None
                for _ in range(tries):
                    try:
                        answer, error = str(judge(row)), None
                        break
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                out.append((answer, error))
            yield frame[keys].assign(answer=[a for a, _ in out], error=[e for _, e in out])

    return rows.mapInPandas(run, schema)


def with_cache(rows: DataFrame, cache: DataFrame, keys: list[str], judge: Callable[[dict], str], tries: int = 3) -> DataFrame:
    """rows with answer and error: from the cache (keys, answer), else from the judge."""
    fresh = judged(unjudged(rows, cache, keys), keys, judge, tries)
    known = cache.select(*keys, "answer").withColumn("error", F.lit(None).cast("string"))
    return rows.join(known.unionByName(fresh), keys, "left")


def fill_quotas(accepted: DataFrame, kind: str, quotas: dict[str, int], seed: int, key: str, turn: str = "turn") -> DataFrame:
    """The first accepted rows of each kind, as many as its quota, shuffled by a seeded hash (column place); too few fail the query."""
    number = F.row_number().over(Window.partitionBy(kind).orderBy(turn, key))
    want = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    kept = accepted.where(F.col(kind).isin(list(quotas))).withColumn("_n", number)
    # The greatest quota as a literal lets Spark cut each kind to so many rows in every task before it shuffles.
    kept = kept.where((F.col("_n") <= max(quotas.values())) & (F.col("_n") <= want[F.col(kind)])).drop("_n")
    n = kept.agg(F.count(F.lit(1)).alias("_have"))
    total = sum(quotas.values())
    ok = F.when(F.col("_have") == total, True).otherwise(F.raise_error(F.concat(F.lit(f"{total} rows are asked for, there are "), F.col("_have").cast("string"))).cast("boolean"))
    return kept.join(F.broadcast(n)).where(ok).drop("_have").withColumn("place", F.xxhash64(F.lit(f"{seed}:output"), key))


def check_routes(rows: DataFrame, route: str, expected: Column, allowed: list[str], all_of_them: bool = False) -> DataFrame:
    """route, n of the routes, unless a row has another than expected or an unknown one, or one is missing: then the query fails."""
    fail = lambda c, *what: F.when(c, True).otherwise(F.raise_error(F.concat(*what)).cast("boolean"))
    text = F.coalesce(F.col(route), F.lit("null"))
    fit = fail(F.col(route).eqNullSafe(expected) & F.col(route).isin(allowed), F.lit("a row routes to "), text)
    counts = rows.where(fit).groupBy(route).agg(F.count(F.lit(1)).alias("n"))
    if not all_of_them:
        return counts
    seen = counts.agg(F.count(F.lit(1)).alias("_k"))
    return counts.join(F.broadcast(seen)).where(fail(F.col("_k") == len(allowed), F.lit("a route is missing"))).drop("_k")
