"""From raw documents to packed training sequences: each stage calls one operator of sievemill.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet and rereads it as the next
one's docs. All but the last return the columns of documents. run() deletes a stage's work folders when the next one
begins; the functions of STAGES do so among themselves, for one run at a time in their order, and never while docs
still reads such a folder.

Defined results, for all stages: each row is judged by its own doc_id and text, so that rows that repeat a doc_id, or lack one,
go or stay alone; null texts are kept by all filters but near_duplicates, where null, empty and wordless texts are one
group; very long texts are worked on whole; of repeated rows one stays; extra columns stay, whatever their names; an
empty documents gives no rows, and an empty or one-sided labels or an empty benchmark rejects nothing.
"""

from __future__ import annotations

from functools import partial
from urllib.parse import urlsplit

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm import common, decontaminate, line_dedup, packing, quality, simhash


class Run:
    """The work folders of a run's last stage."""

    def __init__(self):
        self.before: list[str] = []

    def call(self, operator, spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = [urlsplit(x).path for x in self.before]
        if own and not any(urlsplit(f).path.startswith(x) for f in docs.inputFiles() for x in own):
            common.delete(spark, self.before)
        with common.recorded() as made:
            out = operator(spark, docs, sf_dir)
        self.before.extend(made)
        return out


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: What a column named removed_lines is called meanwhile.
_FREE = "removed_lines of documents"


def line_dedup_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated blocks of lines go from the later document; a document of which nothing is left goes too."""
    extra = [c for c in docs.columns if c == "removed_lines"]
    out = line_dedup.dedup_lines(docs.withColumnsRenamed({c: _FREE for c in extra}))
    out = out.where((F.col("removed_lines") == 0) | (F.trim(F.translate("text", "\n\r\t", "   ")) != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{_FREE}`" if c in extra else f"`{c}`").alias(c) for c in docs.columns])


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return simhash.keep_one(docs)


def decontamination_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all that is left, in sequences of at most 1024 tokens."""
    return packing.pieces_digest(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")))


OPERATORS = [
    ("quality", quality_filter),
    ("line_dedup", line_dedup_filter),
    ("near_duplicates", near_duplicate_filter),
    ("decontamination", decontamination_filter),
    ("packing", pack_sequences),
]

_own = Run()
STAGES = [(name, partial(_own.call, operator)) for name, operator in OPERATORS]

#: A classifier, an alignment and a genetic algorithm have no SQL form; tests/llm compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    this = Run()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = common.result_dir(spark, "pipeline")
    for name, operator in OPERATORS:
        this.call(operator, spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    common.delete(spark, this.before)
    return docs
