"""Order MinHash document fingerprints, which notice that pieces of a text have changed places.

All runs of K code points of a text are numbered by occurrence, so that the second "the" is another element than the first.
Each of SIZE sketches orders the elements by a hash of its own, selects the TUPLE smallest, puts these back into the
order in which they stand in the text, and hashes the tuple of their runs to 16 bits, four hexadecimal digits. The share of
sketches in which two fingerprints agree estimates how alike the texts are: it falls with every edit, and, other than for
a set of runs, when blocks are moved.

successors pairs every row with the next one in an order by ranges: rows are sorted within ranges, each is paired with its
successor in one pass, and only the last of a range is joined with the first of the next.

Defined results: null texts count as empty; an empty text's fingerprint is all zeros, and like itself; a text shorter than K is one
run, and one with fewer than TUPLE runs gives shorter tuples; rows with equal doc_id follow each other by a hash of
their text, repeated rows in any order, which are equal; null doc_ids come last; a single row follows itself; an
empty table gives no rows; extra columns are ignored, whatever their names. A text is fingerprinted whole, which takes
about sixty bytes for each of its code points.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Code points of a run, sketches of a fingerprint, elements of a sketch.
K, SIZE, TUPLE = 8, 64, 2
#: Numbers that are worked on at once; a text with more runs takes one sketch at a time.
CELLS = 1 << 17
_ODD = common.mix(np.arange(1, 1 + SIZE, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_JOIN, _TURN, _MOST = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(2**64 - 1)


def run_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """A 64-bit hash of every run of k code points, or of all of them if there are fewer; runs of half the length are joined."""
    k = min(k, len(points))
    if k <= 1:
        return common.mix(points.astype(np.uint64) + _TURN)
    half = k // 2
    left = run_hashes(points, half)
    right = left[half:] if k == 2 * half else run_hashes(points[half:], k - half)
    return common.mix(left[: len(right)] * _JOIN + right)


def numbered(h: np.ndarray) -> np.ndarray:
    """Hashes of (run, which occurrence of it this is)."""
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    new = np.ones(len(h), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    starts = np.flatnonzero(new)
    nth = np.empty(len(h), np.uint64)
    nth[order] = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))
    return common.mix(h + nth * _TURN)


_held = [np.empty(0, np.uint64)]


def _room(size: int) -> np.ndarray:
    """Memory that is used again for the next text, of which a large one takes its own."""
    if size > CELLS:
        return np.empty(size, np.uint64)
    if len(_held[0]) < CELLS:
        _held[0] = np.empty(CELLS, np.uint64)
    return _held[0]


def sketch(text: str) -> np.ndarray:
    """The SIZE 16-bit hashes of a text's fingerprint."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    if not len(points):
        return np.zeros(SIZE, np.uint16)
    h = run_hashes(points)
    element, n = numbered(h), len(h)
    take, step = min(TUPLE, n), max(1, CELLS // n)
    out, room = np.empty(SIZE, np.uint64), _room(min(step, SIZE) * n)
    for a in range(0, SIZE, step):
        odd = _ODD[a : a + step, None]
        keys = np.multiply(element[None], odd, out=room[: len(odd) * n].reshape(len(odd), n))
        rows = np.arange(len(keys))
        places = np.empty((len(keys), take), np.int64)
        for j in range(take):
            places[:, j] = keys.argmin(1)
            keys[rows, places[:, j]] = _MOST
        places.sort(1)
        t = np.zeros(len(keys), np.uint64)
        for j in range(take):
            t = common.mix(t * _JOIN + h[places[:, j]])
        out[a : a + step] = t
    return (out >> np.uint64(48)).astype(np.uint16)


def fingerprints_of(texts: list[str]) -> np.ndarray:
    """A row of SIZE hashes for each text."""
    return np.array([sketch(t) for t in texts], np.uint16).reshape(len(texts), SIZE)


def as_strings(sketches: np.ndarray) -> list[str]:
    raw = sketches.astype(">u2").tobytes().hex()
    return [raw[4 * SIZE * k : 4 * SIZE * (k + 1)] for k in range(len(sketches))]


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as doc_id, fingerprint."""
    common.prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = fingerprints_of([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(as_strings(found), pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def likeness(a: Column, b: Column) -> Column:
    """The share of sketches in which two fingerprints agree."""
    at = F.sequence(F.lit(1), F.lit(4 * SIZE - 3), F.lit(4))
    return F.size(F.filter(at, lambda i: F.substr(a, i, F.lit(4)) == F.substr(b, i, F.lit(4)))) / F.lit(float(SIZE))


def edited(text: str, following: str) -> str:
    """text, its last half replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())


def _rows(ids: list, texts: list, own: np.ndarray, next_texts: list, following: np.ndarray) -> list[pa.Array]:
    new = [edited(a, b) for a, b in zip(texts, next_texts, strict=True)]
    other = fingerprints_of(new)
    share = lambda x: (own == x).mean(1) if len(own) else []
    columns = (ids, [len(t) for t in texts], [sha256(t.encode()).hexdigest() for t in new], as_strings(own), as_strings(other), share(other), share(following))
    return [pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)]


def edit_trial(docs: DataFrame) -> DataFrame:
    """How much of a fingerprint stays when half of the text is replaced by the next document's (SCHEMA), next by descending doc_id, after the last the first.

    near_edited and near_next: likeness of a text's fingerprint to that of the edited text and of the next document.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    names = [x.split()[0] for x in SCHEMA.split(", ")] + ["part", "text", "first", "last"]

    def run(batches):
        part, held, first = TaskContext.get().partitionId(), None, True

        def out(ids, texts, own, next_texts, following, last=False):
            nonlocal first
            n = len(ids)
            if last:  # its pair is not here
                rows = [pa.array(c, k) for c, k in zip((ids, [len(texts[0])], [None], as_strings(own), [None], [None], [None]), _KINDS, strict=True)]
            else:
                rows = _rows(ids, texts, own, next_texts, following)
            ends = [texts[k] if last or (first and k == 0) else None for k in range(n)]
            rows += [pa.array([part] * n, pa.int64()), pa.array(ends, pa.string()), pa.array([first and k == 0 for k in range(n)], pa.bool_()), pa.array([last] * n, pa.bool_())]
            first = False
            return pa.RecordBatch.from_arrays(rows, names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            own = fingerprints_of(texts)
            if held is not None:
                ids, texts, own = [held[0], *ids], [held[1], *texts], np.concatenate([held[2], own])
            if len(ids) > 1:
                yield out(ids[:-1], texts[:-1], own[:-1], texts[1:], own[1:])
            held = (ids[-1], texts[-1], own[-1:])
        if held is not None:
            yield out([held[0]], [held[1]], held[2], None, None, True)

    order = [F.col("doc_id").desc_nulls_last(), F.col("h")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    made = common.written(ordered.mapInArrow(run, f"{SCHEMA}, part long, text string, first boolean, last boolean"), "edit-trial")
    whole = made.where("NOT last").select(*names[:7])

    def close(batches):
        for batch in batches:
            ids, prints, texts, next_prints, next_texts = (c.to_pylist() for c in batch.columns)
            digits = lambda x: np.frombuffer(bytes.fromhex("".join(x)), ">u2").reshape(len(x), SIZE).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(_rows(ids, texts, digits(prints), next_texts, digits(next_prints)), names=names[:7])

    # One row for each range: the next range that holds rows, after the last the first.
    heads = made.where("first").select("part", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    window = Window.orderBy("part")
    link = made.where("first").select("part").select("part", F.coalesce(F.lead("part").over(window), F.min("part").over(window)).alias("next_part"))
    tails = made.where("last").join(link, "part").join(heads.withColumnRenamed("part", "next_part"), "next_part")
    return whole.unionByName(tails.select("doc_id", "fingerprint", "text", "next_fingerprint", "next_text").mapInArrow(close, SCHEMA))
