"""Readers, writers and sample builders on small cases."""

import bz2
import json

import pytest
from pyspark.sql import functions as F

from sievemill.plans import samples as S
from sievemill.sources import tables as T


def test_rows_of_several_files(spark, tmp_path):
    spark.createDataFrame([(i, "x") for i in range(50)], "i int, a string").write.parquet(str(tmp_path / "p.parquet"))
    (tmp_path / "j.jsonl").write_text('{"i": 99, "b": 1}\n')
    paths = [str(tmp_path / "p.parquet"), str(tmp_path / "j.jsonl")]
    rows = T.read_rows(spark, *paths)
    assert rows.count() == 51 and set(rows.columns) == {"i", "a", "b"}
    assert [r.i for r in T.read_rows(spark, *paths, order=["i"], most=3).collect()] == [0, 1, 2]
    drawn = [sorted(r.i for r in T.read_rows(spark, *paths, order=["i"], most=10, seed=s).collect()) for s in (1, 1, 2)]
    assert drawn[0] == drawn[1] != drawn[2] and len(drawn[0]) == 10
    with pytest.raises(ValueError):
        T.read_rows(spark, "x.csv")
    with pytest.raises(ValueError):
        T.write_rows(rows.limit(0), str(tmp_path / "none"))


def test_cache_keeps_the_last_good_row(spark, tmp_path):
    lines = [{"k": "a", "v": 1, "n": 1, "ok": True}, {"k": "a", "v": 2, "n": 2, "ok": True}, {"k": "a", "v": 3, "n": 3, "ok": False}, {"k": "b", "v": None, "n": 1, "ok": True}]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n\n")
    got = T.read_cache(spark, str(tmp_path / "c.jsonl"), "k string, v int, n int, ok boolean", ["k"], "n", where=F.col("ok"))
    assert sorted((r.k, r.v) for r in got.collect()) == [("a", 2), ("b", None)]


def test_steps(spark, tmp_path):
    path, df = str(tmp_path / "d"), spark.createDataFrame([(1, "secret <pad>")], "i long, t string")
    assert T.latest_step(spark, path) is None and T.load_step(spark, path, 1) is None
    for step in (1, 10, 10):
        T.dump_step(df, path, step)
    assert T.latest_step(spark, path) == 10 and T.load_step(spark, path, 10).count() == 1
    assert sorted(tuple(r) for r in T.load_steps(spark, path, masked=("<pad>",)).select("step", "t").collect()) == [(1, "secret *"), (10, "secret *")]
    assert T.should_dump(4, "x", 2) and not T.should_dump(3, "x", 2) and not T.should_dump(4, None, 2)
    with pytest.raises(ValueError):
        T.should_dump(1, "x", 0)


def test_corpus(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.bz2").write_bytes(bz2.compress(b'{"title": " T ", "text": ["one ", " ", "two"]}\n\n[1]\n'))
    (tmp_path / "y.jsonl").write_text('{"title": "U", "text": "whole"}\n{"title": "", "text": "z"}\n{"title": "V"}\n')
    (tmp_path / "z.txt").write_text("not read")
    assert sorted((r.title, r.sentences) for r in T.read_corpus(spark, str(tmp_path)).collect()) == [("T", ["one", "two"]), ("U", ["whole"])]
    (tmp_path / "bad.json").write_text("{broken\n")
    with pytest.raises(Exception, match="no JSON in"):
        T.read_corpus(spark, str(tmp_path)).collect()


def test_splits_and_metrics(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "split string, v int")
    got = T.write_splits(df, str(tmp_path / "s"), "split", total=F.sum("v"))
    assert sorted(tuple(r) for r in got.collect()) == [("a", 2, 3), ("b", 1, 3)]
    rows = T.metric_rows(spark, {"a@b/c": 1, "t": "x", "f": True}, 3)
    assert [tuple(r) for r in rows.select("step", T.clean_keys(F.col("key")), "value").collect()] == [(3, "a_b/c", 1.0)]
    T.append_records(rows, str(tmp_path / "m"))
    T.append_records(rows, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 2


def test_sample_builders(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(S.hash_answer(F.lit("so #### 1,234.5 ok"))) == "1234.5"
    with pytest.raises(Exception, match="no #### answer"):
        value(S.hash_answer(F.lit("none")))
    assert value(S.route(F.lit(None).cast("string"), F.lit(" Parallel"))) == "compare"
    with pytest.raises(Exception, match="no route"):
        value(S.route(F.lit("x")))
    changed = value(S.replace_content(S.chat(("system", F.lit("a")), ("user", F.lit("b"))), "system", F.lit("c")))
    assert [tuple(m) for m in changed] == [("system", "c"), ("user", "b")]
    assert [tuple(p) for p in value(S.media_parts(F.lit("<video>a<image>"), {"image": F.lit(2)}))] == [("video", None, 0), ("text", "a", None), ("image", None, 2)]
    assert value(S.media_parts(F.lit(None).cast("string"))) == []
    df = spark.createDataFrame([(["T", "T"], [["a"], ["b", "c"]], ["T", "U", "T"], [5, 0, 1])], "t array<string>, s array<array<string>>, ft array<string>, fi array<int>")
    assert df.select(S.evidence(S.facts(F.col("ft"), F.col("fi")), F.col("t"), F.col("s"))).first()[0] == ["[T] b c", "[T] c"]
    with pytest.raises(Exception, match="different sizes"):
        df.select(S.facts(F.col("ft"), F.array(F.lit(1)))).collect()
