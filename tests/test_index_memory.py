"""What the functions that index a shard and score it hold at once, run here on a whole shard."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from sievemill.operators import searchindex as I


class Captured(Exception):
    pass


def captured(monkeypatch, kind, method, make):
    """The function that make() hands to a method of frames."""
    got = []

    def take(self, run, *_):
        got.append(run)
        raise Captured

    with monkeypatch.context() as m:
        m.setattr(kind, method, take)
        try:
            make()
        except Captured:
            return got[0]


def peak(f):
    tracemalloc.start()
    out = f()
    most = tracemalloc.get_traced_memory()[1] / 2**20
    tracemalloc.stop()
    return out, most


def test_a_shard_is_counted_a_few_documents_at_a_time(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "x", "y")], "doc_id long, title string, text string")
    run = captured(monkeypatch, DataFrame, "mapInArrow", lambda: I.build(docs, str(tmp_path / "i"), {"title": 3.0, "text": 1.0}))
    rng = np.random.default_rng(2)
    n, words = 4096, 250
    code = (rng.zipf(1.3, n * words) % 30_000).astype(np.int64)
    texts = pa.ListArray.from_arrays(pa.array(np.arange(0, n * words + 1, words), pa.int32()), pa.array([f"w{c}" for c in code]))
    titles = pa.array([["w1", "t"], []] * (n // 2))
    whole = pa.RecordBatch.from_arrays([pa.array(np.arange(n) * 7), pa.array(np.full(n, 3)), titles, texts], names=["doc_id", "shard", "f0", "f1"])
    last = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([4]), pa.array([["a"]]), pa.array([["a", "b", "a"]])], names=whole.schema.names)
    (one, two), most = peak(lambda: list(run(iter([whole.slice(0, 3000), whole.slice(3000), last]))))
    assert most < 48  # before: 67
    got = {t: dict(zip(d, f, strict=True)) for t, d, f in zip(one["term"].to_pylist(), one["docs"].to_pylist(), one["tf"].to_pylist(), strict=True)}
    w1 = np.bincount(np.repeat(np.arange(n), words), code == 1, n) + np.where(np.arange(n) % 2 == 0, 3.0, 0.0)
    assert got["w1"] == {i * 7: w1[i] for i in range(n) if w1[i]} and got["t"] == {i * 7: 3.0 for i in range(0, n, 2)} and got[None] == {0: float(n)}
    assert set(got) - {None, "t"} == {f"w{c}" for c in code} | {"w1"} and one["len"].to_pylist()[-1] == [n * words + n]
    assert sorted(zip(two["term"].to_pylist()[:-1], two["tf"].to_pylist()[:-1], strict=True)) == [("a", [5.0]), ("b", [1.0])] and two["shard"].to_pylist() == [4] * 3


def test_pairs_of_words_and_documents_are_bounded(spark, monkeypatch):
    index = spark.createDataFrame([], "term string, shard long, docs array<long>, share array<double>")
    wanted = spark.createDataFrame([], "query_id long, shard long, terms array<struct<term:string,weight:double>>")
    run = captured(monkeypatch, PandasCogroupedOps, "applyInArrow", lambda: I._scored(index, wanted, 5, 1))
    rng = np.random.default_rng(4)
    n, terms, queries = 2000, 60, 200
    share = rng.random((terms, n))
    posts = pa.table({"term": [f"t{i}" for i in range(terms)], "s": [0] * terms, "p": [0] * terms, "docs": [np.arange(n)] * terms, "share": list(share)})
    weight = rng.random((queries, terms))
    asked = pa.table({"shard": np.zeros(queries * terms, int), "part": np.zeros(queries * terms, int), "query_id": np.repeat(np.arange(queries), terms), "term": [f"t{i}" for i in range(terms)] * queries, "weight": weight.ravel()})
    got, most = peak(lambda: run(posts, asked))
    assert most < 48  # before: 644
    score = weight @ share
    top = np.argsort(-np.round(score, 9), axis=1, kind="stable")[:, :5]
    assert got["doc_id"].to_pylist() == top.ravel().tolist() and np.allclose(got["score"].to_numpy(), np.take_along_axis(score, top, 1).ravel())
