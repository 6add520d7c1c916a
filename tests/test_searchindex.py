"""The inverted index against a plain score of every document: equal answers, files opened, shards left out."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievemill.operators import retrieval as R
from sievemill.operators import searchindex as I


def plain(docs, queries, k, k1=1.5, b=0.75):
    """Best k by BM25 of every document, for words of one field."""
    cut = lambda t: [w for w in re.findall("[a-z0-9]+", (t or "").lower()) if w not in R.STOP_WORDS]
    held = {i: Counter(cut(t)) for i, t in docs if i is not None}
    size = {i: max(1, sum(c.values())) for i, c in held.items()}
    mean = sum(size.values()) / max(1, len(size))
    df = Counter(w for c in held.values() for w in c)
    out = []
    for q, text in queries:
        asked = Counter(cut(text))
        score = {}
        for i, c in held.items():
            s = sum(n * math.log(1 + (len(held) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * size[i] / mean)) for w, n in asked.items() if c[w])
            if s > 0:
                score[i] = s
        best = sorted(score, key=lambda i: (-round(score[i], 9), i))[:k]
        out += [(q, i, round(score[i], 7), n + 1) for n, i in enumerate(best)]
    return sorted(out)


def some(rng, n):
    # A few words are in almost every document, most in few.
    return " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(n))


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(4)
    docs = [(i, some(rng, rng.randrange(1, 60))) for i in range(600)] + [(900, None), (901, ""), (902, "the of"), (None, "w1 w2"), (903, "w1 " * 5000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    path = str(tmp_path_factory.mktemp("index") / "i")
    I.build(df.repartition(5), path, {"text": 1.0}, shard_docs=20, buckets=16)
    return docs, df, path


def test_answers(spark, made, monkeypatch):
    docs, df, path = made
    rng = random.Random(6)
    queries = [(q, some(rng, rng.randrange(1, 12))) for q in range(40)] + [(50, None), (51, "the"), (52, "absent"), (53, "w1 w1 w1"), (None, "w1")]
    asked = spark.createDataFrame(queries, "query_id long, text string")
    want = plain(docs, queries[:-1], 7)
    for scores, parts in ((I.SCORES, I.QUERIES), (100, 7)):
        monkeypatch.setattr(I, "SCORES", scores)
        monkeypatch.setattr(I, "QUERIES", parts)
        got = sorted((r["query_id"], r["doc_id"], round(r["score"], 7), r["rank"]) for r in I.search(spark, path, asked, 7).collect())
        assert got == want
    scan = sorted((r["query_id"], r["doc_id"], round(r["score"], 7), r["rank"]) for r in R.bm25(df, asked, 7).collect())
    assert scan == want


def test_only_the_folders_of_the_words_are_opened(spark, made):
    asked = spark.createDataFrame([(1, "w3"), (1, "w40")], "query_id long, term string")
    rows, meta, n = I.blocks_of(spark, made[2], asked)
    opened = {r[0].rsplit("/", 2)[1] for r in rows.select(F.input_file_name()).distinct().collect()}
    want = {f"bucket={r[0]}" for r in asked.select(F.pmod(F.xxhash64("term"), F.lit(16))).distinct().collect()}
    assert n == 1 and meta["n"] == 604 and opened == want and len(opened) <= 2


def test_shards_that_cannot_reach_the_best_are_left_out(spark, made, monkeypatch):
    seen, own = [], I._scored

    def counted(index, wanted, *rest):
        seen.append(wanted.count())
        return own(index, wanted, *rest)

    monkeypatch.setattr(I, "_scored", counted)
    asked = spark.createDataFrame([(1, "w1 w2 w900"), (2, "w1")], "query_id long, text string")
    I.search(spark, made[2], asked, 2).collect()
    assert seen[0] == 4 and sum(seen) < 2 * 31  # 31 shards hold w1


def test_hot_word_is_many_rows(spark, made):
    rows = spark.read.parquet(f"{made[2]}/blocks").where("term = 'w1'")
    assert rows.count() > 25 and rows.agg(F.max("n")).first()[0] < 60


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id string, text string")
    I.build(none, str(tmp_path / "i"), {"text": 1.0})
    assert I.search(spark, str(tmp_path / "i"), spark.createDataFrame([("q", "y")], "query_id string, text string"), 5).count() == 0
    I.build(spark.createDataFrame([("b", "x y"), ("a", "y x")], "doc_id string, text string"), str(tmp_path / "j"), {"text": 1.0})
    asked = spark.createDataFrame([("q", "y")], "query_id string, text string")
    assert [(r["doc_id"], r["rank"]) for r in I.search(spark, str(tmp_path / "j"), asked, 5).collect()] == [("a", 1), ("b", 2)]
    assert I.search(spark, str(tmp_path / "j"), asked.limit(0), 5).count() == 0


def test_index_of_files_is_built_once(spark, tmp_path, monkeypatch):
    calls, own = [], I.build
    monkeypatch.setattr(I, "build", lambda *a, **k: (calls.append(1), own(*a, **k)))
    rows = spark.createDataFrame([(1, "x y")], "doc_id long, text string")
    rows.write.parquet(str(tmp_path / "t"))
    read = lambda: spark.read.parquet(str(tmp_path / "t"))
    one = I.index_of(read(), ("t",), fields={"text": 1.0})
    assert I.index_of(read(), ("t",), fields={"text": 1.0}) == one and len(calls) == 1
    rows.write.mode("append").parquet(str(tmp_path / "t"))
    assert I.index_of(read(), ("t",), fields={"text": 1.0}) != one and len(calls) == 2
