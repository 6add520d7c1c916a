"""Rollouts in rounds against a row-by-row replay, resumption, and payloads that are not exchanged."""

import pytest
from pyspark.sql import functions as F

from sievemill.operators import rollouts as R
from sievemill.sources.payloads import Payloads


def model(i, turn):
    """Tokens of the model: its turn, then a 9 for each call."""
    return [turn + 1] + [9] * ((i * (turn + 1)) % 4)


def generate(rows):
    times = ((F.col("id") * (F.col("turn") + 1)) % 4).cast("int")
    return rows.withColumn("new", F.concat(F.array((F.col("turn") + 1).cast("int")), F.array_repeat(F.lit(9), times)))


def read_calls(new):
    return F.transform(F.filter(new, lambda x: x == 9), lambda x: F.struct(F.lit("f").alias("name"), F.lit("{}").alias("arguments")))


def use_tools(calls):
    return calls.withColumn("answer", F.concat(F.lit("a"), F.col("at").cast("string")))


def write_answers(answers):
    return F.transform(answers, lambda a: F.when(a.startswith("a"), F.lit(100) + F.substr(a, F.lit(2)).cast("int")).otherwise(F.lit(199)))


def replay(i, prompt, limits):
    ids, mask, turn, tools, calls = list(prompt), [], 0, 0, 0
    while True:
        new = model(i, turn)
        ids, mask, turn = ids + new, mask + [1] * len(new), turn + 1
        n = new.count(9)
        if len(mask) >= limits.response:
            why = R.FULL
        elif limits.model_turns and turn >= limits.model_turns:
            why = R.TURNS
        elif limits.tool_turns and tools >= limits.tool_turns:
            why = R.ANSWERS
        elif not n:
            why = R.NO_CALLS
        else:
            calls += n
            reply = [100 + k for k in range(min(n, limits.calls))] + [199] * max(0, n - limits.calls)
            if len(mask) + len(reply) < limits.response:
                ids, mask, tools = ids + reply, mask + [0] * len(reply), tools + 1
                continue
            why = R.TOO_LONG
        cut = len(ids) - len(mask)
        return (i, ids[:cut], ids[cut:][: limits.response], mask[: limits.response], turn + tools + 1, calls, why)


@pytest.mark.parametrize("limits", [R.Limits(30, 6, 4, 2), R.Limits(12), R.Limits(50, 4), R.Limits(50, 0, 2, 3)])
def test_rollouts(spark, tmp_path, limits):
    prompts = [(i, [7] * (i % 3)) for i in range(40)]
    df = spark.createDataFrame(prompts, "id long, ids array<int>")
    got = sorted(tuple(r) for r in R.roll_out(df, str(tmp_path / "r"), limits, generate, read_calls, use_tools, write_answers).collect())
    assert got == [replay(i, p, limits) for i, p in prompts]


def test_rollouts_go_on_after_the_last_whole_round(spark, tmp_path):
    limits, path, rounds = R.Limits(60, 8, 6, 2), str(tmp_path / "r"), []
    prompts = [(i, [5]) for i in range(20)]
    df = spark.createDataFrame(prompts, "id long, ids array<int>")

    def watched(rows):
        rounds.append(rows.count())
        return generate(rows)

    def failing(rows):
        if len(rounds) == 2:
            raise RuntimeError("the model is gone")
        return watched(rows)

    with pytest.raises(RuntimeError):
        R.roll_out(df, path, limits, failing, read_calls, use_tools, write_answers)
    (tmp_path / "r" / "round=3").mkdir()  # a round that was begun, and lost
    (tmp_path / "r" / "round=3" / "part-0.parquet").write_text("broken")
    out = R.roll_out(df, path, limits, watched, read_calls, use_tools, write_answers)
    assert sorted(tuple(r) for r in out.collect()) == [replay(i, p, limits) for i, p in prompts]
    assert rounds[0] == 20 and rounds == sorted(rounds, reverse=True) and len(rounds) >= 4  # no round twice, only active rows
    n = len(rounds)
    R.roll_out(df, path, limits, watched, read_calls, use_tools, write_answers)
    assert len(rounds) == n


def test_rollouts_of_none(spark, tmp_path):
    df = spark.createDataFrame([], "id long, ids array<int>")
    assert R.roll_out(df, str(tmp_path / "r"), R.Limits(5), generate, read_calls, use_tools, write_answers).count() == 0


def test_payload_is_not_exchanged(spark):
    store = Payloads(spark, "id", 8)
    rows = spark.range(2000).select("id", (F.col("id") % 7).alias("tag"), F.repeat(F.lit("x"), 50).alias("text"), (F.col("id") * 2).alias("other"))
    keys = store.put(rows, "text", "other")
    assert keys.columns == ["id", "tag"] and store.fields() == ["other", "text"]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = store.fetch(keys.where("tag = 3"), "text")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan and "other" not in plan
        assert out.count() == 286 and out.where("text IS NULL").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    store.close()
    assert store.fields() == []


def test_bridge(spark):
    store = Payloads(spark, "id", 4)
    keys = store.put(spark.createDataFrame([(1, "a", "xx"), (2, "b", None), (3, "c", "z")], "id long, tag string, text string"), "text")

    @store.bridge(["text"], ["n"])
    def size(rows):
        return rows.withColumn("n", F.length("text"))

    back = size(keys.where("id <> 3"))
    assert back.columns == ["id", "tag"]
    assert sorted(tuple(r) for r in store.fetch(keys, "n", "text").select("id", "tag", "n", "text").collect()) == [(1, "a", 2, "xx"), (2, "b", None, None), (3, "c", None, "z")]
    store.put(spark.createDataFrame([(1, "new")], "id long, text string"), "text")
    assert store.fetch(keys.where("id = 1"), "text").first()["text"] == "new"
    with pytest.raises(ValueError, match="got 3 rows"):
        store.bridge(["text"], ["m"])(lambda rows: rows.where("id = 1").withColumn("m", F.lit(1)))(keys)
    with pytest.raises(ValueError, match="no such fields"):
        store.fetch(keys, "absent")
    store.close()
