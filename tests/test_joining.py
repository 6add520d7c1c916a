"""Joins by time, stored sketches and folded texts against plain versions."""

import datetime
import random
import unicodedata

from pyspark.sql import functions as F

from sievemill.operators import folding, selection, sketches, timejoin

START = datetime.datetime(2024, 1, 1)


def events(spark, rng, n, keys):
    rows = [(rng.choice(keys), START + datetime.timedelta(seconds=rng.randrange(400)) if rng.random() < 0.95 else None, i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "key int, ts timestamp, id long")


def test_as_of_with_ties_nulls_and_a_hot_key(spark):
    rng = random.Random(1)
    (left, a), (right, b) = (events(spark, rng, 150, [1, 1, 1, 2, 3, None]) for _ in range(2))
    for span in (1, 7, 1000):
        got = {r["id"]: r["match"]["id"] if r["match"] else None for r in timejoin.as_of(a, b, "key", "ts", "id", span).collect()}
        assert len(got) == len(left)
        for k, t, i in left:
            fit = [(rt, ri) for rk, rt, ri in right if k is not None and rk == k and t is not None and rt is not None and rt <= t]
            assert got[i] == (max(fit)[1] if fit else None)
    assert timejoin.as_of(a, b.limit(0), "key", "ts", "id", 7).where("match IS NULL").count() == len(left)
    assert timejoin.as_of(a.limit(0), b, "key", "ts", "id", 7).count() == 0


def test_within(spark):
    rng = random.Random(2)
    (left, a), (right, b) = (events(spark, rng, 120, [1, 1, 2, None]) for _ in range(2))
    for before, after, span in ((30, 0, 10), (0, 5, 60), (-3, 9, 4)):
        got = sorted((r["left"]["id"], r["right"]["id"]) for r in timejoin.within(a, b, "key", "ts", before, after, span).collect())
        want = [(i, j) for k, t, i in left for q, u, j in right if k is not None and k == q and t and u and -before <= (u - t).total_seconds() <= after]
        assert got == sorted(want)


def test_no_join_without_equal_keys(spark):
    _, a = events(spark, random.Random(3), 5, [1])
    for df in (timejoin.as_of(a, a, "key", "ts", "id", 9), timejoin.within(a, a, "key", "ts", 1, 1, 9)):
        plan = df._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_sketches_merge_within_their_error(spark):
    rows = spark.range(0, 300_000).select((F.col("id") % 7).alias("step"), (F.hash("id") % 100_000).cast("double").alias("v"), (F.col("id") % 50_000).alias("who"))
    parts = sketches.sketches(rows, ["step"], F.col("v"), F.col("who"))
    one = sketches.merged(parts, []).select("n", sketches.distinct().alias("d"), *[sketches.quantile(q).alias(f"q{i}") for i, q in enumerate((0.1, 0.5, 0.99))]).first()
    assert one["n"] == 300_000 and abs(one["d"] / 50_000 - 1) <= 3 * sketches.DISTINCT_ERROR
    for i, q in enumerate((0.1, 0.5, 0.99)):
        assert abs(rows.where(F.col("v") <= one[f"q{i}"]).count() / 300_000 - q) <= 2 * sketches.RANK_ERROR
    few = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", None)], "g string, v double")
    got = {r["g"]: (r["n"], r["p50"], r["top"]) for r in sketches.sketch_percentiles(sketches.sketches(few, ["g"], F.col("v")), ["g"], {"p50": 0.5, "top": 1.0}).collect()}
    assert got == {"a": (2, 1.0, 3.0), "b": (0, None, None)}
    assert sketches.merged(sketches.sketches(few.limit(0), ["g"], F.col("v")), ["g"]).count() == 0


def plain_words(text):
    plain = "".join(c for c in unicodedata.normalize("NFKD", (text or "").casefold()) if not unicodedata.combining(c))
    return "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in plain).split()


def test_folded_words_as_unicode_says(spark):
    rng = random.Random(5)
    texts = [None, "", "Straße ½ ﬁne ÅNGSTRÖM Ünïcödé", "İstanbul K ſ", "été ́a", "ＡＢＣ①㎏ \U0001d400\U0001f110 \U0001f600x", "Ø ł đ", "a" * 200_000 + "é"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x1E00, 0x2200), rng.randrange(0xFB00, 0xFB07), rng.randrange(0x3200, 0x3400), rng.randrange(0x1D400, 0x1D800), rng.randrange(0x300, 0x370)])) for _ in range(40)) for _ in range(200)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", folding.folded_words(F.col("t")).alias("w")).collect()
    assert {r["i"]: r["w"] for r in got} == {i: plain_words(t) for i, t in enumerate(texts)}


def test_leakage_by_demonyms(spark):
    rows = [
        ("A Brazilian writer", "Brasil", "bridge", None), ("A Brazilian writer", "Brazil", "bridge", "country_demonym_in_question"), ("An ex-north-KOREAN ship", "North Korea", None, "country_demonym_in_question"),
        ("Brazilian or not, Brazil", "brazil", "bridge", None), ("Koreans", "South Korea", "bridge", None), ("Who was in São Paulo?", "Sao Paulo", "bridge", "answer_in_question"), ("Brazilian", "Brazil", " Comparison", None), (None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "q string, a string, kind string, want string")
    assert df.where(~selection.leakage_reason(F.col("q"), F.col("a"), F.col("kind")).eqNullSafe(F.col("want"))).collect() == []
    other = spark.createDataFrame([("The City of Light", "Paris", ["city of light"]), ("City of Lights", "Paris", ["city of light"]), ("x", "Paris", None)], "q string, a string, p array<string>")
    empty = F.coalesce(F.col("p"), F.array().cast("array<string>"))
    assert [r[0] for r in other.select(selection.leakage_reason(F.col("q"), F.col("a"), F.lit("bridge"), empty)).collect()] == ["country_demonym_in_question", None, None]
