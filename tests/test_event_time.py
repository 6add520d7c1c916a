"""Late rows, sessions that go on over micro-batches, interval joins; merged schemas of JSON lines."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sievemill.sources import tables
from sievemill.streaming import event_time, runner


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def stream_of(spark, path, batches):
    """A stream with a micro-batch for each list of (minutes, user)."""
    for k, rows in enumerate(batches):
        spark.createDataFrame([(at(m), u, f"{k}-{i}") for i, (m, u) in enumerate(rows)], "ts timestamp, user long, name string").coalesce(1).write.mode("append").parquet(path)
    return runner.stream_table(spark, path, 1)


def test_late_rows(spark, tmp_path):
    stream = stream_of(spark, str(tmp_path / "in"), [[(5, 1), (50, 1)], [(200, 1)], [(201, 2)], [(10, 1), (195, 1)], [(400, 1)]])
    out = runner.run_to_table(event_time.closed_windows(stream, "ts", "10 minutes", "1 hour", None, ["user"], n=F.count("*")), str(tmp_path / "out"))
    # The row of minute 10 comes after its window was given out; that of minute 195 is late, but not too late.
    assert sorted((r["start"], r["n"]) for r in out.collect()) == [(at(0), 2), (at(180), 1), (at(180), 2)]


def test_sessions_over_batches(spark, tmp_path):
    stream = stream_of(spark, str(tmp_path / "in"), [[(0, 1), (0, 2)], [(8, 1)], [(100, 1)], [(300, 3)]])
    out = runner.run_to_table(event_time.closed_sessions(stream, "ts", "1 minute", "10 minutes", ["user"], n=F.count("*")), str(tmp_path / "out"))
    assert sorted((r["user"], r["start"], r["end"], r["n"]) for r in out.collect()) == [(1, at(0), at(18), 2), (1, at(100), at(110), 1), (2, at(0), at(10), 1)]


def test_interval_join(spark, tmp_path):
    left = stream_of(spark, str(tmp_path / "l"), [[(30, 1), (31, 2)], [(90, 1)]])
    right = stream_of(spark, str(tmp_path / "r"), [[(25, 1), (31, 2), (10, 1)], [(85, 1), (91, 1)]])
    out = runner.run_to_table(event_time.within(left, right, "user", "ts", "2 hours", "10 minutes", "1 minute"), str(tmp_path / "out"))
    assert sorted((r["ts"], r["right_ts"], r["user"]) for r in out.collect()) == [(at(30), at(25), 1), (at(31), at(31), 2), (at(90), at(85), 1), (at(90), at(91), 1)]


def test_merged_schema(spark):
    lines = ['{"a": 1, "s": {"x": 1}}', '{"a": 2.5, "s": {"y": [1, 2]}, "z": null}', "broken", None, '{"a": null, "m": "t"}']
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    rows = tables.merged_rows(df, "line")
    assert dict(rows.dtypes) == {"a": "double", "m": "string", "s": "struct<x:bigint,y:array<bigint>>", "z": "string"}
    assert sorted(map(str, (r["a"] for r in rows.collect()))) == ["1.0", "2.5", "None", "None", "None"]
    with pytest.raises(ValueError, match="no objects"):
        tables.merged_rows(df.where("line = 'broken'"), "line")
