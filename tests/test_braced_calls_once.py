"""Calls are read once for each text, and Python gets a text from its first call on only."""

from pyspark.sql import functions as F

from sievemill import queries
from sievemill.operators import toolcalls as C

CALL = '<|tool_call>call:f{a:<|"|>é, {x}<|"|>}<tool_call|>'


def test_one_reading_in_the_plan(spark):
    df = queries.QUERIES["braced_calls"](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1  # before: 2


def test_python_gets_what_follows_the_first_mark(spark, monkeypatch):
    monkeypatch.setattr(C, "read_braced_calls", lambda x: [("got", repr(x))])
    df = spark.createDataFrame([("ünder " * 1000 + CALL + " z",), ("long " * 1000,), (None,), ("<|tool_call>no",)], "t string").coalesce(1)
    got = [r.c[0].arguments for r in df.select(C.braced_calls(F.col("t")).alias("c")).collect()]
    assert got == [repr(CALL + " z"), "None", "None", "None"]  # before: whole texts


def test_calls_and_what_stands_before(spark):
    texts = [None, "", "plain", "é<|tool_call>x", f"ü {CALL}{CALL} z", "a <|tool_call>call:f{a:1}", f"a <|tool_call>call:-{{}} b {CALL}", f"a <|tool_call>no b {CALL}"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    one = '{"a": "é, {x}"}'
    want = [("", []), ("", []), ("plain", []), (texts[3], []), ("ü ", [("f", one)] * 2), (texts[5], []), ("a ", [("f", one)]), ("a ", [("f", one)])]
    for made in (df.select(C.before_calls(F.col("t")).alias("b"), C.braced_calls(F.col("t")).alias("c")), df.withColumn("c", C.braced_calls(F.col("t"))).select(C.before_calls(F.col("t"), F.col("c")).alias("b"), "c")):
        assert [(r.b, [tuple(c) for c in r.c]) for r in made.collect()] == want
    assert [C.read_braced_calls(t) for t in texts] == [c for _, c in want]
