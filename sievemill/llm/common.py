"""Plumbing shared by the llm operators: shared scratch folders, Arrow text buffers, word hashes, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []
_recorders: list[list[str]] = []

#: Rows and bytes that one Arrow batch may hold; long texts then don't pile up in a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def prepare(spark: SparkSession) -> None:
    """Set what every operator here relies on: small Arrow batches, and workers that can import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}" if known else root


def result_dir(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share, under spark.checkpoint.dir.

    Only where that setting is absent and the session is local a temporary folder of this machine is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="sievemill-"))
            atexit.register(shutil.rmtree, _own_dir[0], True)
        base = f"file://{_own_dir[0]}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/sievemill-{name}-{uuid.uuid4().hex}"


def work_dir(spark: SparkSession, name: str) -> str:
    """A result_dir() for what an operator keeps meanwhile."""
    path = result_dir(spark, name)
    for made in _recorders:
        made.append(path)
    return path


@contextmanager
def recorded():
    """The work folders that are made within, as a list."""
    made: list[str] = []
    _recorders.append(made)
    try:
        yield made
    finally:
        _recorders.remove(made)


def delete(spark: SparkSession, folders: list[str]) -> None:
    """Delete folders, and empty the list; only for those whose readers are done."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folders.pop())
        path.getFileSystem(conf).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and survives lost executors."""
    path = work_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key():
    """A hash of a row's text; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def row_key():
    """A hash of a row's doc_id, which may be null, and text."""
    return F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), text_key())


def whole_row(docs: DataFrame):
    """All columns of docs as one, which leaves every name free."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs without those rows whose row_key() is in rows(row)."""
    return docs.select(row_key().alias("row"), whole_row(docs).alias("doc")).join(rows, "row", "left_anti").select("doc.*")


#: A key with more than this share of all rows is hot; there are fewer of them than its inverse, so that they can be broadcast.
HOT_SHARE = 1000


def split_join(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows joined with table(key, count, ...), which has a row for each key and how many of `total` rows have it.

    The rows of hot keys meet the table by a broadcast of those keys (fewer than HOT_SHARE), all others by a shuffle.
    """
    hot = table.where(F.col(count) * HOT_SHARE > total)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(F.col(count) * HOT_SHARE <= total), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column over bytes and offsets, without a copy per value."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def pieces(offsets: np.ndarray, limit: int = 1 << 20):
    """(from, to) of runs of rows with about `limit` bytes at most; a longer row makes a run of its own. Arrays over a run are several times its bytes."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = to


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; a bijection."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


#: Masks of the lowest 0 to 8 bytes.
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every data[start:end]; 0 is never returned.

    Eight bytes at a time are mixed with their place, and the results added and mixed with the length. No step is
    linear in the bytes, so texts of a regular build don't collide as they do for a polynomial modulo 2**64.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    words = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from every place on
    n = np.maximum((ends - starts + 7) >> 3, 1)
    first = np.cumsum(n) - n
    k = np.arange(int(first[-1] + n[-1])) - np.repeat(first, n)
    at = np.repeat(starts, n) + 8 * k
    w = words[at] & _BYTES[np.clip(np.repeat(ends, n) - at, 0, 8)]
    h = np.add.reduceat(mix(mix(w + np.uint64(0x9E3779B97F4A7C15)) ^ (k.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)), first)
    return np.maximum(mix(h ^ (ends - starts).astype(np.uint64) * np.uint64(0x165667B19E3779F9)), np.uint64(1))


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of True that don't cross an offset."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = mask[:-1]
    before[cut[:n]] = False
    after = np.zeros(n, bool)
    after[:-1] = mask[1:]
    after[cut[1:]] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of edges (src, dst: orderable, src != dst): a row (id, root) per vertex, root the smallest.

    Alternating large-star and small-star rounds; each is one grouped pass over the edges, written to the shared
    folder, so that lineage stays short. It ends with the first round that leaves the set of edges as it is: equal
    counts and sums of hashes, and then no edge that the round before lacks. Nothing else is gathered on the driver.
    A hot vertex only takes part in partial minima and hash joins, never in a collected list.
    """
    now, seen = written(edges.select("src", "dst").distinct(), f"{name}-edges"), None
    while True:
        # Large star: every neighbour that is larger than u goes to the least of u and its neighbours.
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        # Small star: u and its smaller neighbours go to the least of them.
        low = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(low, "src").select(F.explode(F.array(F.struct(F.col("dst").alias("src"), F.col("m").alias("dst")), F.struct("src", F.col("m").alias("dst")))).alias("e")).select("e.*").where("src <> dst").distinct()
        before, now = now, written(small, f"{name}-edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if state == seen and now.join(before, ["src", "dst"], "left_anti").isEmpty():
            return now.select(F.col("src").alias("id"), F.col("dst").alias("root")).unionByName(now.select(F.col("dst").alias("id"), F.col("dst").alias("root")).distinct())
        seen = state


def numbered(df: DataFrame, order: list, name: str, count: str | None = None) -> tuple[DataFrame, int]:
    """(df with `at`, each row's place from 0 in that order; how many rows there are, or for how many `count` is true).

    Rows are dealt out by ranges of the order, written, and counted for each range; a row for each range meets on one task.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    made = written(ordered.withColumn("_id", F.monotonically_increasing_id()), name)
    part = F.shiftright("_id", 33)
    sizes = made.groupBy(part.alias("_part")).agg(F.count("*").alias("n"), F.count_if(F.col(count)).alias("k") if count else F.count("*").alias("k"))
    sizes = sorted(sizes.collect())
    spark = df.sparkSession
    base, rows = 0, []
    for p, n, _ in sizes:
        rows.append((p, base))
        base += n
    bases = F.broadcast(spark.createDataFrame(rows, "_part long, _base long"))
    out = made.withColumn("_part", part).join(bases, "_part").withColumn("at", F.col("_base") + F.col("_id").bitwiseAND((1 << 33) - 1))
    return out.drop("_part", "_base", "_id"), sum(k for _, _, k in sizes)
