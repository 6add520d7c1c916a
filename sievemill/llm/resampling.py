"""Target-distribution importance resampling over hashed word runs.

One scan of a document keeps a ring of running CRC states, one for each of the last n places at which a run of words may
start. Every word extends them by a space and itself and starts a new one, and each state is the hash of a run, whose
bucket is written. Counts of the buckets over the documents and over the target give each bucket's gain in logarithms; a
document's weight is the floored mean over its runs, and a Gumbel variate drawn from a hash of its id is added, so that the
highest scores are a weighted sample without replacement.

The buckets are written once; counting, weighing and ranking don't read texts again. Counts are summed within each task, only
the gains (one number for each bucket) are broadcast, and ranks come from ranges of the scores.

Defined results: null and wordless texts have no runs and weigh 0; rows that repeat a doc_id are documents of their own, ties
go to the smaller doc_id, a null one last, and then to any; a null id is hashed as an empty string; a very long text is
scanned whole, and its buckets are one value; without documents there are no rows, without a target every count of it is 0; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A-Z to a-z, bytes that are in no word to spaces; every byte of a character beyond ASCII is in a word.
_WORD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


#: Bytes of a text that are cut into words at once.
CHUNK = 1 << 20


def scan(text: bytes, longest: int) -> tuple[int, np.ndarray]:
    """(words, CRC states of all runs of 1 to `longest` consecutive words joined by a space); the ring goes on from chunk to chunk."""
    text, n, at, ring, found = text.translate(_WORD), 0, 0, [], []
    while at < len(text):
        to = text.find(b" ", at + CHUNK)
        to = len(text) if to < 0 else to
        words, at = text[at:to].split(), to
        n += len(words)
        if longest == 1:  # the ring is the new state alone
            found.append(np.fromiter(map(crc32, words), np.uint32, len(words)))
            continue
        states = []
        for word in words:
            spaced = b" " + word
            ring = [crc32(spaced, state) for state in (ring[1:] if len(ring) == longest else ring)]
            ring.append(crc32(word))
            states += ring
        found.append(np.array(states, np.uint32))
    return n, np.concatenate(found) if found else np.zeros(0, np.uint32)


def bucketed(texts: DataFrame, longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """texts(doc_id, text) as doc_id, n_words, buckets (of every run of words)."""
    common.prepare(texts.sparkSession)

    def run(batches):
        for batch in batches:
            n, found, sizes = [], [], [0]
            for text in batch.column(1):
                words, states = scan(text.as_buffer().to_pybytes() if text.is_valid else b"", longest)
                n.append(words)
                found.append((states % np.uint32(buckets)).astype(np.int32))
                sizes.append(len(states))
            flat = np.concatenate(found) if found else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(flat))], names=["doc_id", "n_words", "buckets"])

    rows = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, buckets array<int>")


def bucket_counts(rows: DataFrame, buckets: int = 10_000) -> DataFrame:
    """How many runs fall into each bucket (bucket, n); a task sends each bucket once."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    return rows.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """(bucket, gain) for every bucket that either counts has: thousandths of the log ratio of its smoothed shares, floored."""
    both = source.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full").fillna(0, ["s", "t"])
    sums = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))
    share = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return both.join(F.broadcast(sums)).select("bucket", F.floor(F.lit(1000.0) * F.log(share)).cast("long").alias("gain"))


def weighed(rows: DataFrame, gain: DataFrame, buckets: int = 10_000) -> DataFrame:
    """bucketed() rows as doc_id, n_words, n_features, weight. gain has at most `buckets` rows, which every task gets."""
    # Only the counted buckets of documents are looked up; a row for each bucket comes to the driver.
    table = np.zeros(buckets, np.int64)
    for bucket, g in gain.collect():
        table[bucket] = g

    def run(batches):
        for batch in batches:
            found = batch.column(2)
            flat, edge = found.flatten().to_numpy(zero_copy_only=False), found.offsets.to_numpy().astype(np.int64)
            sums = np.append(0, np.cumsum(table[flat]))
            size, edge = np.diff(edge), edge - edge[0]
            weight = (sums[edge[1:]] - sums[edge[:-1]]) // np.maximum(size, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: str = "2024") -> DataFrame:
    """docs(doc_id, text) as doc_id, n_features, weight, score, rank; rank is null for all but the drawn ones.

    Drawn are `percent` of the documents with at least least_words words. target(text) is what the sample shall be like.
    """
    rows = common.written(bucketed(docs, longest, buckets), "word-buckets")
    goal = bucketed(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), longest, buckets)
    found = weighed(rows, gains(bucket_counts(rows, buckets), bucket_counts(goal, buckets), buckets), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = found.select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= least_words).alias("fit"))
    ranked, totals = common.numbered(scored, [F.col("fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "scores", count="fit")
    drawn = totals * percent // 100
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("fit") & (F.col("at") < drawn), F.col("at") + 1).alias("rank"))


def drawn(docs: DataFrame, ranks: DataFrame) -> DataFrame:
    """The rows of docs that resample() drew, by doc_id; for ids that are unique."""
    return docs.join(ranks.where("rank IS NOT NULL").select("doc_id"), "doc_id", "left_semi")
