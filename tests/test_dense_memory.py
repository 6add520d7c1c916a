"""Dense search: what a task holds at once, and the same best k as a plain sort whatever the order of scores, ties and values that are no numbers."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from sievemill.operators import retrieval as R


def task(ids, q, k, batches):
    """Rows of one task of the search by q, run here, and the most MB it held."""
    field = lambda n, t: SimpleNamespace(name=n, dataType=SimpleNamespace(simpleString=lambda: t))
    block = SimpleNamespace(schema=[field("query_id", "bigint"), field("q", "array<double>")], toArrow=lambda: pa.table({"query_id": ids, "q": pa.chunked_array([pa.array(list(q))])}))
    context = SimpleNamespace(broadcast=lambda value: SimpleNamespace(value=value))
    rows = SimpleNamespace(schema=[field("doc_id", "bigint"), field("v", "array<double>")], sparkSession=SimpleNamespace(sparkContext=context), mapInArrow=lambda run, schema: run)
    run = R._dense_block(rows, block, k, q.shape[1])
    made = [pa.RecordBatch.from_arrays([pa.array(n), pa.array(list(v))], names=["doc_id", "v"]) for n, v in batches]
    tracemalloc.start()
    out = list(run(iter(made)))
    peak = tracemalloc.get_traced_memory()[1] / 2**20
    tracemalloc.stop()
    return pa.Table.from_batches(out).to_pandas().sort_values(["query_id", "doc_id"]), peak


def plain(ids, q, k, names, v):
    score = q @ v.T
    low = np.where(np.isnan(score), -np.inf, -np.round(score, 9))
    top = np.lexsort((np.broadcast_to(names, score.shape), low), axis=-1)[:, :k]
    return sorted((ids[i], names[j], round(score[i, j], 7)) for i in range(len(ids)) for j in top[i])


def test_memory_of_a_task_does_not_grow_to_millions_of_scores():
    rng = np.random.default_rng(3)
    q, v = rng.normal(size=(4000, 16)), rng.normal(size=(6000, 16))
    got, peak = task(np.arange(4000), q, 10, [(np.arange(a, a + 2000), v[a : a + 2000]) for a in range(0, 6000, 2000)])
    assert peak < 48  # before: 82
    few = got[got.query_id < 20]
    assert sorted(zip(few.query_id, few.doc_id, few.score.round(7), strict=True)) == plain(np.arange(20), q[:20], 10, np.arange(6000), v)


@pytest.mark.parametrize("cells", [1, 64, 1 << 19])
def test_best_of_rising_scores_ties_and_nan(monkeypatch, cells):
    monkeypatch.setattr(R, "CELLS", cells, raising=False)
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=(300, 2)), 1)  # many ties
    v[100:200] = np.linspace(0, 9, 100)[:, None]  # each better than those before
    v[250] = np.nan
    names, q = rng.permutation(300), np.round(rng.normal(size=(30, 2)), 1)
    got, _ = task(np.arange(30), q, 7, [(names[a : a + 75], v[a : a + 75]) for a in range(0, 300, 75)])
    want = plain(np.arange(30), q, 7, names, v)
    assert [tuple(map(str, x)) for x in sorted(zip(got.query_id, got.doc_id, got.score.round(7) + 0.0, strict=True), key=lambda x: x[:2])] == [tuple(map(str, (a, b, c + 0.0))) for a, b, c in sorted(want, key=lambda x: x[:2])]
    got, _ = task(np.arange(30), q, 7, [(names[:3], v[:3]), (names[3:5], v[3:5])])
    assert len(got) == 150
