"""Updates, queues that are cleared, and searches on single cases."""

import pytest
from pyspark.sql import functions as F

from sievemill.operators import flow as X
from sievemill.operators import judging as J
from sievemill.operators import retrieval as R
from sievemill.streaming import runner, state


def test_after_update():
    assert X.after_update(2, 3, 10.0, 15.0, 20.0) == {"stale_samples": 5, "version_time": 10.0, "active_time": 5.0, "idle_ratio": 0.5}
    assert X.after_update(0, 0, 10.0, None, 20.0)["idle_ratio"] == 0


def test_cleared_queue(spark, tmp_path):
    rows = [(1, i, "clear" if i == 5 else "take" if i == 7 else "put") for i in range(9)]
    spark.createDataFrame(rows, "key long, item long, op string").coalesce(1).write.parquet(f"{tmp_path}/in")
    s = runner.stream_table(spark, f"{tmp_path}/in")
    out = state.bounded_queue(s, F.col("key"), F.col("item"), F.col("item"), F.col("op") == "take", 4, F.col("op") == "clear")
    got = runner.run_to_table(out, f"{tmp_path}/out")
    assert [(r["event"], r["item"]) for r in got.orderBy("item", "event").collect() if r["event"] != "put"] == [("dropped", 0), ("cleared", 1), ("cleared", 2), ("cleared", 3), ("cleared", 4), ("consumed", 6)]
    assert state.queue_statistics(got).first()["size"] == 1


def test_context_search(spark):
    df = spark.createDataFrame([("Alpha City founding", ["Beta", "alpha City", "C"], [["The founding."], ["A <b> \'c\'.", "x" * 3000, "never"], []], True), ("", ["t"], [["s"]], True), ("q", ["t"], [["s"]], False), ("z" * 71, ["t"], [["s"]], True), ("none", ["t"], [["s"]], True)], "q string, t array<string>, s array<array<string>>, ok boolean")
    got = [r[0] for r in df.select(R.answer_search(F.col("q"), F.col("t"), F.col("s"), F.col("ok"))).collect()]
    assert got[0].titles == ["alpha City", "Beta"] and got[0].text.startswith('<information>\n<query>Alpha City founding</query>\n<document title="alpha City">\nA &lt;b&gt; &#x27;c&#x27;.\nxxx')
    assert "never" not in got[0].text and len(got[0].text) < 2600
    assert [g.format_error for g in got] == [False, True, True, True, False] and "71 characters" in got[3].text and got[4].text.endswith("<query>none</query><no_results /></information>")
    assert spark.range(1).select(R.title_recall(F.array(F.lit("A  b")), F.array(F.lit("a B"), F.lit("c"), F.lit(" "))), R.title_recall(F.lit(None).cast("array<string>"), F.array().cast("array<string>"))).first()[:] == (0.5, 0.0)


def test_quotas_and_routes_fail(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, kind string")
    with pytest.raises(Exception, match="rows are asked for"):
        J.fill_quotas(J.candidates(df, 1, "k"), "kind", {"a": 2}, 1, "k").collect()
    for allowed, expected in ((["a"], F.col("kind")), (["a", "b"], F.lit("a")), (["a", "b", "c"], F.col("kind"))):
        with pytest.raises(Exception):
            J.check_routes(df, "kind", expected, allowed, True).collect()
