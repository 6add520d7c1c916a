"""Token ids in ORC: files in ascending doc_id order with run-length encoded integers, row indexes and Bloom filters.

A stripe is read on its own, so scans split by stripes; the row index and the Bloom filter on doc_id let a lookup skip
whatever cannot hold its ids. Each row also says how many ids its file holds before it, and a sidecar table of the
totals of each file, written with them, gives the place of a document in the stream of all ids: a lookup reads that
table, footers, and the row groups that may hold its ids.

Defined results: null and empty texts are the end id alone; rows with equal doc_id follow each other by a hash of their
text, repeated rows in any order of theirs, which are equal; null doc_ids come first; a very long text is one row, encoded
as a run of its own; an empty table writes no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .encoder import PIECE, encoder

SCHEMA = "doc_id long, part long, before long, n_tokens long, ids array<int>"
ORC = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "2000", "orc.stripe.size": str(32 << 20), "compression": "zstd"}
#: The sidecar's folder, which readers of the data pass over. Up to so many files its rows (16 bytes each) are broadcast; beyond, joined by a shuffle.
TOTALS, BROADCAST_PARTS = "_totals", 100_000


def write(docs: DataFrame, path: str, vocab: str, end_id: int = 1) -> None:
    """Encode every text of docs(doc_id, text) and write the ids under path."""
    common.prepare(docs.sparkSession)

    def run(batches):
        part, code, before = TaskContext.get().partitionId(), encoder(vocab, "bare"), 0
        for batch in batches:
            data, offsets = common.utf8(batch.column(1))
            for a, b in common.pieces(offsets, PIECE):
                ids, o = code.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n = np.diff(o) + 1
                ids = np.insert(ids, o[1:], end_id).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.full(len(n), part)), pa.array(before + np.cumsum(n) - n), pa.array(n), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(ids))], names=["doc_id", "part", "before", "n_tokens", "ids"])
                before += int(n.sum())

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    ordered.mapInArrow(run, SCHEMA).write.mode("errorifexists").options(**ORC).orc(path)
    # Two columns of the files that are there now; a row for each file is what the window sees.
    totals = docs.sparkSession.read.schema(SCHEMA).orc(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base")).write.parquet(f"{path}/{TOTALS}")


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids; only those of doc_ids if given, which skips stripes and row groups."""
    rows = spark.read.schema(SCHEMA).orc(path)
    totals = spark.read.schema("part long, base long").parquet(f"{path}/{TOTALS}")
    if totals.count() <= BROADCAST_PARTS:
        totals = F.broadcast(totals)
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(doc_ids))
    return rows.join(totals, "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids")


def ids_digest(rows: DataFrame) -> DataFrame:
    """The rows of read() with a checksum in place of the ids."""
    from zlib import crc32

    def run(batches):
        for batch in batches:
            ids = batch.column(3)
            flat, o = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            raw = memoryview(flat).cast("B")
            crc = [crc32(raw[4 * a : 4 * b]) for a, b in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
