"""Quality classifier: random Fourier features of document statistics, ridge by summed normal equations, isotonic calibration.

The statistics of every whole text are computed once and written. Labelled rows are fitted from that table: the
random features approximate a Gaussian kernel, each partition sums its share of the normal equations, and the sums
are added. A fifth of the labelled rows is kept from the ridge fit and calibrates its scores by isotonic regression.

Bound: at most SAMPLE labelled rows are fitted (those with the least hash of their id), all rows are scored.
Defined results: null texts count as empty; a very long text is measured whole, its arrays are some forty times its size; a
null doc_id is scored and never fitted; repeated labels of a document count once, by the least; repeated rows are each
fitted and scored; without labels of both kinds among the fitted rows every score is the share of good ones, or 0.5 if there
are none, and keep_good() rejects nothing; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE, FEATURES, RIDGE, SEED = 60_000, 256, 1e-3, 7
#: A strictly rising part of the score, which orders what isotonic regression leaves equal.
SLOPE = 1e-3

NAMES = ["log_chars", "log_words", "word_bytes", "upper", "digit", "mark", "odd_mark", "high", "log_line_words", "distinct", "repeat_next", "pair_repeat", "line_repeat", "top_word", "bare_mark_words", "stop_words", "mark_words", "upper_words"]

_UPPER, _LOWER_CASE, _DIGIT, _MARK, _ODD = (np.zeros(256, bool) for _ in range(5))
_UPPER[0x41:0x5B] = _LOWER_CASE[0x61:0x7B] = _DIGIT[0x30:0x3A] = True
for _c in range(0x21, 0x7F):
    _MARK[_c] = not chr(_c).isalnum()
    _ODD[_c] = chr(_c) in "#$%&*+/<=>@\\^_`{|}~!"
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32


def _per(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    sums = np.append(0.0, np.cumsum(values, dtype=np.float64))
    return sums[edges[1:]] - sums[edges[:-1]]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of NAMES for each UTF-8 text."""
    n_docs = len(offsets) - 1
    low = _FOLD[data]
    size = np.diff(offsets).astype(float)
    starts, ends = common.runs(~_SPACE[data], offsets)
    edge = np.searchsorted(starts, offsets)
    words = np.diff(edge).astype(float)
    doc = np.repeat(np.arange(n_docs), np.diff(edge))
    count = lambda mask: _per(mask, offsets)
    upper, letters = count(_UPPER[data]), count(_UPPER[data] | _LOWER_CASE[data] | (data >= 0x80))
    h = common.slice_hashes(low, starts, ends)
    last = _MARK[data[ends - 1]] if len(ends) else np.zeros(0, bool)
    marks = np.append(0, np.cumsum(_MARK[data], dtype=np.int64))
    uppers = np.append(0, np.cumsum(_UPPER[data], dtype=np.int64))
    in_word = marks[ends] - marks[starts]
    n_w, n_c = np.maximum(words, 1), np.maximum(size, 1)

    def repeats(keys, owner, n):
        """(distinct keys, count of the commonest) of each owner."""
        by = np.lexsort((keys, owner))
        k, o = keys[by], owner[by]
        new = np.ones(len(by), bool)
        new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
        head = np.flatnonzero(new)
        most = np.zeros(n, np.int64)
        np.maximum.at(most, o[head], np.diff(np.append(head, len(by))))
        return np.bincount(o[head], minlength=n).astype(float), most.astype(float)

    distinct, top = repeats(h, doc, n_docs)
    same = np.zeros(len(h), bool)
    pair = np.zeros(len(h), np.uint64)
    if len(h) > 1:
        inside = doc[1:] == doc[:-1]
        same[1:] = inside & (h[1:] == h[:-1])
        pair[1:] = np.where(inside, common.mix(h[:-1] * np.uint64(3) + h[1:]), np.uint64(0))
    pairs, _ = repeats(pair, doc, n_docs)
    l_starts, l_ends = common.runs(data != 0x0A, offsets)
    l_edge = np.searchsorted(l_starts, offsets)
    lines = np.diff(l_edge).astype(float)
    l_doc = np.repeat(np.arange(n_docs), np.diff(l_edge))
    l_distinct, _ = repeats(common.slice_hashes(data, l_starts, l_ends), l_doc, n_docs)
    short = _per((ends - starts) <= 3, edge)
    return np.stack([np.log1p(size), np.log1p(words), _per(ends - starts, edge) / n_w, upper / np.maximum(letters, 1), count(_DIGIT[data]) / n_c, count(_MARK[data]) / n_c, count(_ODD[data]) / n_c, count(data >= 0x80) / n_c, np.log1p(words / np.maximum(lines, 1)), distinct / n_w, _per(same, edge) / n_w, 1 - pairs / n_w, 1 - l_distinct / np.maximum(lines, 1), top / n_w, _per(in_word == ends - starts, edge) / n_w, short / n_w, _per(last, edge) / n_w, _per(uppers[ends] - uppers[starts] > 1, edge) / n_w], 1)


def document_statistics(docs: DataFrame, rows: bool = False) -> DataFrame:
    """(doc_id, x): the statistics of each row of docs(doc_id, text); with `rows` also row, the key of the row."""
    common.prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            data, offsets = common.utf8(batch.column(1))
            for a, b in common.pieces(offsets, 1 << 20):
                x = statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                key = [batch.column(k).slice(a, b - a) for k in range(2, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())), *key], names=["doc_id", "x", "row"][: 2 + len(key)])

    key = [common.row_key().alias("row")] if rows else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *key).mapInArrow(run, "doc_id long, x array<double>" + ", row long" * rows)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Model:
    """Standardised statistics -> random Fourier features -> ridge -> isotonic steps."""

    def __init__(self, center: np.ndarray, scale: np.ndarray, width: float):
        rng = np.random.default_rng(SEED)
        self.center, self.scale = center, scale
        self.w = rng.standard_normal((len(center), FEATURES)) / width
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.beta = np.zeros(FEATURES + 1)
        self.fitted = False
        self.knots, self.levels = np.zeros(1), np.full(1, 0.5)

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.center) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.levels[0])
        raw = self.raw(x)
        return np.clip((1 - SLOPE) * np.interp(raw, self.knots, self.levels) + SLOPE * np.clip(raw, 0, 1), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (x, level) at both ends of each step."""
    by = np.argsort(x, kind="stable")
    steps: list[list[float]] = []
    for a, b in zip(x[by].tolist(), y[by].tolist(), strict=True):
        steps.append([a, a, b, 1.0])
        while len(steps) > 1 and steps[-2][2] / steps[-2][3] >= steps[-1][2] / steps[-1][3]:
            last = steps.pop()
            steps[-1][1] = last[1]
            steps[-1][2] += last[2]
            steps[-1][3] += last[3]
    return np.array([v for s in steps for v in s[:2]]), np.array([s[2] / s[3] for s in steps for _ in range(2)])


def fit(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from document_statistics and labels(doc_id, quality), without rows whose crc32(doc_id) mod 3 is 1."""
    text_id = F.col("doc_id").cast("string")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).where("doc_id is not null and y is not null").where(F.crc32(text_id) % 3 != 1).groupBy("doc_id").agg(F.min("y").alias("y"))
    # The bound on the sample bounds what is broadcast and every sum below.
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(sample)
    rows = common.written(stats.join(F.broadcast(chosen), "doc_id").withColumn("calibrate", F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(5)) == 0), "fit").coalesce(16)
    k = len(NAMES)

    def moments(batches):
        total = np.zeros(2 * k + 1)
        for batch in batches:
            x = _matrix(batch.column(0))
            total += np.concatenate([x.sum(0), (x * x).sum(0), [len(x)]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    total = sum((np.frombuffer(r[0]) for r in rows.select("x").mapInArrow(moments, "s binary").collect()), np.zeros(2 * k + 1))
    if not total[-1]:
        return Model(np.zeros(k), np.ones(k), 1.0)
    center = total[:k] / total[-1]
    scale = np.sqrt(np.maximum(total[k : 2 * k] / total[-1] - center**2, 0))
    model = Model(center, np.where(scale > 1e-9, scale, 1.0), np.sqrt(2.0 * k))

    def equations(batches):
        a, b = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            y, own = batch.column(1).to_numpy(), ~np.asarray(batch.column(2).to_pylist(), bool)
            z = model.features(_matrix(batch.column(0)))[own]
            a += z.T @ z
            b += z.T @ y[own]
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes() + b.tobytes()], pa.binary())], names=["s"])

    sums = sum((np.frombuffer(r[0]) for r in rows.select("x", "y", "calibrate").mapInArrow(equations, "s binary").toLocalIterator()), np.zeros((FEATURES + 1) * (FEATURES + 2)))
    a, b = sums[: (FEATURES + 1) ** 2].reshape(FEATURES + 1, -1), sums[(FEATURES + 1) ** 2 :]
    model.beta = np.linalg.solve(a + RIDGE * max(1.0, a[-1, -1]) / FEATURES * np.eye(FEATURES + 1), b)

    def raw(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_matrix(batch.column(0)))), batch.column(1)], names=["r", "y"])

    got = rows.where("calibrate").select("x", "y").mapInArrow(raw, "r double, y double").toArrow()
    r, y = got["r"].to_numpy(), got["y"].to_numpy()
    good, n = b[-1] + y.sum(), a[-1, -1] + len(y)
    model.fitted = bool(0 < good < n)
    if not model.fitted:
        model.levels = np.full(1, good / n)
    elif 0 < y.sum() < len(y):
        model.knots, model.levels = isotonic(r, y)
    else:  # too few rows to calibrate: the ridge score as it is
        model.knots = model.levels = np.array([0.0, 1.0])
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rows: bool = False) -> DataFrame:
    """(doc_id, score) of every row of docs(doc_id, text), with `rows` also row; score: how likely labels' quality is 1."""
    stats = common.written(document_statistics(docs, rows), "statistics")
    return scored(stats, fit(stats, labels, sample), rows)


def scored(stats: DataFrame, model: Model, rows: bool = False) -> DataFrame:
    """(doc_id, score) of document_statistics, with `rows` also row."""

    def run(batches):
        for batch in batches:
            key = [batch.column(k) for k in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1)))), *key], names=["doc_id", "score", "row"][: 2 + len(key)])

    return stats.mapInArrow(run, "doc_id long, score double" + ", row long" * rows)


def quality_digest(scores: DataFrame) -> DataFrame:
    return scores.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier does not reject, all of them if nothing could be fitted; each row is judged by its own text."""
    stats = common.written(document_statistics(docs, True), "statistics")
    model = fit(stats, labels)
    if not model.fitted:
        return docs
    return common.without(docs, scored(stats, model, True).where("score < 0.5").select("row").distinct())
