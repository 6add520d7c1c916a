"""Readers and writers: row files, JSON line dumps, step folders, result caches, corpora and metric rows.

Paths are any that Hadoop file systems know; nothing is copied to a local disk first.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FORMS = {"parquet": "parquet", "json": "json", "jsonl": "json"}


def _form(path: str) -> str:
    end = path.rstrip("/").removesuffix(".gz").removesuffix(".bz2").rsplit(".", 1)[-1]
    if end not in _FORMS:
        raise ValueError(f"neither Parquet nor JSON lines: {path}")
    return _FORMS[end]


def read_rows(spark: SparkSession, *paths: str, order: list[str] | None = None, most: int | None = None, seed: int | None = None) -> DataFrame:
    """The rows of all files, columns by name, absent ones null.

    With most, the first rows by `order`, or with a seed too a sample drawn by the hash of seed and order columns, the
    same at every partitioning. Spark keeps `most` rows a task, so a large share is better taken by a hash threshold.
    """
    frames = [spark.read.format(_form(p)).load(p) for p in paths]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if most is None:
        return rows
    if not order:
        raise ValueError("a DataFrame has no first rows without an order")
    return rows.orderBy(*([F.xxhash64(F.lit(seed), *order)] if seed is not None else []), *order).limit(most)


def write_rows(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet with zstd; no rows are an error. The check reads one row, not the table."""
    if df.isEmpty():
        raise ValueError(f"no rows to write to {path}")
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def append_records(df: DataFrame, path: str) -> None:
    """Add JSON lines to a log folder; a committed write adds whole files, a failed one nothing."""
    df.write.mode("append").json(path)


def write_splits(df: DataFrame, path: str, split: str, **summary: Column) -> DataFrame:
    """Parquet in a folder for each split, over what was there, and a JSON summary of each; returns the summary."""
    df.write.mode("overwrite").partitionBy(split).parquet(f"{path}/rows")
    back = df.sparkSession.read.parquet(f"{path}/rows")
    out = back.groupBy(split).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in summary.items()])
    out.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    return out


def last_wins(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row by order for each key; combined before the shuffle, so a hot key costs one row a task."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)) if rest else F.lit(None)
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, *[F.col("_row").getField(c).alias(c) for c in rest]).select(*df.columns)


def read_cache(spark: SparkSession, path: str, schema: str, keys: list[str], *order: str, where: Column | None = None) -> DataFrame:
    """JSON lines of a cache: lines that don't parse and rows beside `where` go, then the last row of each key stays."""
    rows = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).where("_bad IS NULL").drop("_bad")
    return last_wins(rows if where is None else rows.where(where), keys, *order)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def should_dump(step: int, path: str | None, every: int) -> bool:
    """Whether this step is written: a folder is set, and the step is a multiple of `every`."""
    if every <= 0:
        raise ValueError("every must be positive")
    return bool(path) and step % every == 0


def dump_step(df: DataFrame, path: str, step: int, form: str = "json") -> None:
    """Write one step's rows, over those of an earlier try."""
    df.write.mode("overwrite").format(form).save(f"{path}/step={step}")


def load_step(spark: SparkSession, path: str, step: int, form: str = "json") -> DataFrame | None:
    """The rows of a step, or None if it was never finished. Other steps are not listed."""
    at = f"{path}/step={step}"
    return spark.read.format(form).load(at) if _exists(spark, f"{at}/_SUCCESS") else None


def load_steps(spark: SparkSession, path: str, form: str = "json", masked: tuple[str, ...] = ()) -> DataFrame:
    """The rows of all steps with column step (long); the masked strings become * in texts."""
    rows = spark.read.format(form).load(path).withColumn("step", F.col("step").cast("long"))
    texts = [c for c, t in rows.dtypes if t == "string" and masked]
    return rows.withColumns({c: reduce(lambda x, m: F.replace(x, F.lit(m), F.lit("*")), masked, F.col(c)) for c in texts})


def latest_step(spark: SparkSession, path: str) -> int | None:
    """The last finished step, from folder names alone."""
    if not _exists(spark, path):
        return None
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    steps = [int(n[5:]) for n in (f.getPath().getName() for f in found) if n.startswith("step=") and n[5:].isdigit() and _exists(spark, f"{path}/{n}/_SUCCESS")]
    return max(steps, default=None)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(title, sentences) of the .bz2, .jsonl and .json line files at any depth; see normalize_documents.

    A line that is no JSON fails with its file; blank lines and lines that hold no object go.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{bz2,jsonl,json}").text(path).where(F.trim("value") != "")
    read = F.try_parse_json("value")
    bad = F.raise_error(F.concat(F.lit("no JSON in "), F.input_file_name(), F.lit(": "), F.left("value", F.lit(80)))).cast("string")
    v = lines.withColumn("kind", F.coalesce(F.schema_of_variant(read), bad)).where("kind LIKE 'OBJECT%'").withColumn("v", read)
    text = F.coalesce(F.when(F.schema_of_variant(F.try_variant_get("v", "$.text", "variant")).startswith("ARRAY"), F.try_variant_get("v", "$.text", "array<string>")), F.array(F.try_variant_get("v", "$.text", "string")))
    return normalize_documents(v.select(F.try_variant_get("v", "$.title", "string").alias("title"), text.alias("sentences")))


def explode_contexts(samples: DataFrame, context: str = "context") -> DataFrame:
    """(title, sentences) of each entry of context(title: array, sentences: array of arrays)."""
    pair = F.explode(F.arrays_zip(F.col(f"{context}.title").alias("title"), F.col(f"{context}.sentences").alias("sentences")))
    return normalize_documents(samples.select(pair.alias("p")).select("p.title", "p.sentences"))


def normalize_documents(df: DataFrame) -> DataFrame:
    """Titles and sentences trimmed; empty sentences go, and documents without a title or a sentence."""
    trim = lambda c: F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")
    kept = F.filter(F.transform("sentences", trim), lambda s: s != "")
    return df.withColumns({"title": trim(F.col("title")), "sentences": kept}).where("title <> '' AND size(sentences) > 0")


def merged_schema(rows: DataFrame, column: str) -> str:
    """One type for all JSON objects of a text column, as DDL: the union of their fields, of numbers the wider kind; what fits no one type is a variant."""
    kind = rows.agg(F.schema_of_variant_agg(F.try_parse_json(column))).first()[0] or "VOID"
    # Numbers with a point are doubles; what was null throughout is text.
    for old, new in ((r"\bOBJECT<", "STRUCT<"), (r"\bDECIMAL\(\d+,\s*\d+\)", "DOUBLE"), (r"\bVOID\b", "STRING")):
        kind = re.sub(old, new, kind)
    return kind


def merged_rows(rows: DataFrame, column: str) -> DataFrame:
    """The JSON objects of a text column as rows of one merged_schema(); absent fields and lines that don't parse are null."""
    kind = merged_schema(rows, column)
    if not kind.startswith("STRUCT<"):
        raise ValueError(f"no objects of one type in {column}: {kind}")
    return rows.select(F.try_variant_get(F.try_parse_json(column), "$", kind).alias("_v")).select("_v.*")


def metric_rows(spark: SparkSession, metrics: dict, step: int) -> DataFrame:
    """(step, key, value) of one step's metrics, to be appended to a table; what is no number is left out."""
    rows = [(step, k, float(v)) for k, v in metrics.items() if isinstance(v, (int, float)) and not isinstance(v, bool)]
    return spark.createDataFrame(rows, "step long, key string, value double")


def clean_keys(key: Column) -> Column:
    """Metric names with only letters, digits, _ - . / : and spaces; others become _."""
    return F.regexp_replace(key, "[^A-Za-z0-9_./: -]", "_")


def page(df: DataFrame, order: list[Column], offset: int, n: int) -> DataFrame:
    """n rows after the first `offset` in an order, for a viewer."""
    return df.orderBy(*order).offset(offset).limit(n)


def search(df: DataFrame, needle: str) -> DataFrame:
    """Rows of which some text column holds the needle."""
    hits = [F.coalesce(F.contains(F.col(f"`{c}`"), F.lit(needle)), F.lit(False)) for c, t in df.dtypes if t == "string"]
    return df.where(reduce(lambda a, b: a | b, hits, F.lit(False)))
