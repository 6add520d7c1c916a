"""Function-tag calls, the tool-call reward and dense search on small cases."""

import numpy as np
from pyspark.sql import functions as F

from sievemill.operators import retrieval as R
from sievemill.operators import toolcalls as C

TYPES = {"f": {"n": "integer", "x": "number", "b": "bool", "o": "object", "l": "array", "s": "string"}}


def test_typed():
    assert [C.typed(v, k) for v, k in [("3", "int"), ("x", "int"), ("2.0", "number"), ("2.5", "float"), ("TRUE", "bool"), ("no", "bool"), ('{"a": true}', "object"), ("{'a': 1}", "dict"), ("[1, 2]", "array"), ("__import__('os')", "array"), ("Null", "int"), ("5", None)]] == [3, "x", 2, 2.5, True, False, {"a": True}, {"a": 1}, [1, 2], "__import__('os')", None, "5"]


def test_function_calls(spark):
    text = "hi <tool_call>\n<function=f>\n<parameter=n>\n7\n</parameter>\n<parameter=s>\n8\n</parameter>\n</function>\n</tool_call><tool_call><function=g><parameter=a>cut"
    df = spark.createDataFrame([(text,), ("none",), (None,), ("<tool_call><function=f</tool_call>",)], "t string")
    got = [[tuple(c) for c in r[0]] for r in df.select(C.function_calls(F.col("t"), TYPES)).collect()]
    assert got == [[("f", '{"n": 7, "s": "8"}'), ("g", '{"a": "cut"}')], [], [], []]


def test_reward(spark):
    gold = '[{"name": "f", "parameters": {"a": 1, "b": 2}}]'
    rows = [(gold, gold), (gold, "[]"), (gold, '[{"name": "f", "parameters": {"a": 1}}]'), (gold, "{bad"), (None, None), ("[]", "[]")]
    got = [r[0] for r in spark.createDataFrame(rows, "g string, m string").select(C.tool_call_reward(F.col("g"), F.col("m"), 1.0, 0.0)).collect()]
    assert np.allclose(got, [1, 0, (1 + 0.5 + 1) / 4, 0, 0, 1])


def test_dense_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.integers(-2, 3, (60, 4)).astype(float)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    docs = spark.createDataFrame([*rows, (100, None), (101, [1.0, None, 1.0, 1.0]), (102, [1.0])], "doc_id long, v array<double>").repartition(5)
    asked = spark.createDataFrame([*rows[:9], (50, None)], "query_id long, q array<double>")
    monkeypatch.setattr(R, "BLOCK_BYTES", 64)
    monkeypatch.setattr(R, "SCORES", 10)
    got = {(r.query_id, r["rank"]): r.doc_id for r in R.dense(docs, asked, 5).collect()}
    want = {(q, k + 1): d for q in range(9) for k, d in enumerate(sorted(range(60), key=lambda d: (-(v[q] @ v[d]), d))[:5])}
    assert got == want
    assert R.dense(docs, asked.limit(0), 5).count() == 0 and R.dense(docs.limit(0), asked, 5).count() == 0
