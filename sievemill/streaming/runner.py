"""Reading tables as streams and running streams into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def stream_table(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The Parquet files at path (a folder or one file), and those that come later to it, as a stream."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # As a pattern, for a plain path must be a folder.
    path = path.rstrip("/")
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def run_to_table(out: DataFrame, path: str) -> DataFrame:
    """Run an append-mode stream over all that its source now holds, and return the table of its rows.

    A further run with the same path goes on after the files that are done, and adds each row once.
    """
    query = out.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{path}/rows")


def run_to_state(out: DataFrame, path: str) -> DataFrame:
    """Run an aggregate over all that its source now holds, and return the table after the last micro-batch.

    Every micro-batch writes the whole aggregate to a folder named by its number, so a batch that is tried again
    overwrites only its own rows.
    """
    last: list[int] = []

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        last[:] = [batch]

    query = out.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/progress").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    if not last:
        return out.sparkSession.createDataFrame([], out.schema)
    return out.sparkSession.read.schema(out.schema).parquet(f"{path}/batch={last[0]}")
