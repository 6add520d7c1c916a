"""Payloads apart from their keys: operators work on keys and tags, large fields are fetched where they are needed.

Fields lie in tables bucketed and sorted by key in the shared folder. Fetching deals out the keys only: a bucket of keys meets
the bucket of fields where that lies, without an exchange or a sort of the payload, and reads no fields but those asked
for. New fields become a further table, so none is ever written again with another one. Keys have to be unique and not null.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_dir


class Payloads:
    """A set of fields by key; `buckets` is how many parts each table of fields has."""

    def __init__(self, spark: SparkSession, key: str, buckets: int = 64):
        self.spark, self.key, self.buckets = spark, key, buckets
        self.tables: dict[str, list[str]] = {}

    def put(self, rows: DataFrame, *fields: str) -> DataFrame:
        """Store fields of rows; returns the rest, keys and tags. A field that is there already is read from the new table from now on."""
        if self.key in fields or not fields:
            raise ValueError(f"the key {self.key} is no field, and some field is needed")
        name = f"payload_{uuid.uuid4().hex}"
        kept = rows.select(self.key, *fields)
        # One task writes one bucket, so there is a file for each and no sort when it is read.
        dealt = kept.repartition(self.buckets, self.key)
        dealt.write.bucketBy(self.buckets, self.key).sortBy(self.key).option("compression", "zstd").option("path", work_dir(self.spark, name)).format("parquet").saveAsTable(name)
        self.tables = {t: [f for f in held if f not in fields] for t, held in self.tables.items()} | {name: list(fields)}
        return rows.drop(*fields)

    def fields(self) -> list[str]:
        return sorted(f for held in self.tables.values() for f in held)

    def fetch(self, keys: DataFrame, *fields: str) -> DataFrame:
        """keys with these fields; null where a key has none."""
        if missing := set(fields) - set(self.fields()):
            raise ValueError(f"no such fields: {sorted(missing)}; there are {self.fields()}")
        out = keys
        for table, held in self.tables.items():
            wanted = [f for f in fields if f in held]
            if wanted:
                out = out.join(self.spark.table(table).select(self.key, *wanted), self.key, "left")
        return out

    def bridge(self, needs: list[str], gives: list[str]) -> Callable:
        """A function of rows as one of keys and tags: it gets the fields it needs; those it gives are stored, and keys and tags come back.

        The function has to return each key once; another number of rows than it got is an error.
        """

        def over(f):
            @wraps(f)
            def run(keys: DataFrame, *args, **named) -> DataFrame:
                self.put(f(self.fetch(keys, *needs), *args, **named), *gives)
                made = self.spark.table(list(self.tables)[-1])
                n, distinct = made.agg(F.count("*"), F.count_distinct(self.key)).first()
                if (given := keys.count()) != n or distinct != n:
                    raise ValueError(f"{f.__name__} got {given} rows and returned {n} with {distinct} keys")
                return keys

            return run

        return over

    def close(self) -> None:
        """Forget the tables and delete their files."""
        for table in self.tables:
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.spark.sql(f"DESCRIBE FORMATTED {table}").where("col_name = 'Location'").first()["data_type"])
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        self.tables = {}
