"""Run queries and their SQL on the driver's tables and compare the rows, as the driver does.

python tests/compare.py SF_DIR [NAME...] prints a line for each query that differs.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

ROOT = str(Path(__file__).resolve().parents[1])
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}{'/*' if path.is_dir() else ''}')")
    return con


def rows(columns: list[str], data) -> list[str]:
    """The rows as sorted texts, columns in order of their names."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([r[i] for i in order]) for r in data)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> tuple[int, list[str], list[str]]:
    """(rows, those only Spark has, those only DuckDB has)."""
    ours = rows(df.columns, df.collect())
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    if sorted(names) != sorted(df.columns):
        return len(ours), df.columns, names
    theirs = rows(names, got.fetchall())
    a, b = set(ours), set(theirs)
    extra = ["different counts"] if len(ours) != len(theirs) else []
    return len(ours), sorted(a - b) + extra, sorted(b - a)


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sqls = duck(sys.argv[1]), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or [n for n in queries if n not in ("pipeline",) and not n.startswith("op")]:
        start = time.time()
        try:
            df = queries[name](spark, sys.argv[1])
            if name in sqls:
                n, left, right = differences(df, con, sqls[name])
            else:
                n, left, right = df.count(), [], []
        except Exception as e:
            n, left, right = -1, [f"{type(e).__name__}: {str(e)[:600]}"], []
        took = time.time() - start
        if left or right or not n:
            bad += 1
            print(f"DIFFERS {name} rows={n} {took:.1f}s\n   spark  {len(left)} {left[:2]}\n   duckdb {len(right)} {right[:2]}", flush=True)
        elif took > 4:
            print(f"slow {name} rows={n} {took:.1f}s", flush=True)
    print(f"{bad} differ")
