"""Exact top-k for components of any size."""

import numpy as np
import pytest

from larder.llm import top_k


def brute(rows, k):
    whole = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows]
    out = []
    for q, v in whole:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [2e4, 5e6])
def test_large_components(spark, scale):
    rng = np.random.default_rng(8)
    rows = [(k, [float(x) for x in rng.normal(size=20) * (scale if k % 3 else 1)]) for k in range(150)]
    base = rows[1][1]
    rows += [(200 + k, [base[0] + k / 64, *base[1:]]) for k in range(9)]  # scores that differ by less than a double tells
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in top_k.top_k(vectors, vectors, k=5, candidate_block=64, query_block=32).collect()) == brute(rows, 5)


def test_huge_components():
    columns = np.array([[2.0**500, 1.0, 3.0], [0.0, 2.0, 2.0**70]])
    found = list(top_k.search_cell(np.array([9]), np.array([[0.0, 0.0]]), np.array([1, 2, 3]), columns, 2))
    assert [(q, c.tolist(), s.tolist()) for q, c, s in found] == [(0, [1, 2], [0, 0])]
    with pytest.raises(OverflowError):
        list(top_k.search_cell(np.array([9]), np.array([[1.0, 0.0]]), np.array([1, 2, 3]), columns, 2))


@pytest.mark.parametrize("blocks", [(64, 8), (4096, 2048)])
def test_repeated_rows(spark, blocks):
    rng = np.random.default_rng(9)
    rows = [(k, [float(x) for x in rng.normal(size=4)]) for k in range(200)]
    # A query that stands three times, another vector of its id, and a candidate that stands twice.
    rows += [rows[0], rows[0], (0, [1.0, -1.0, 0.5, 0.25]), (7, [3.0, 3.0, 3.0, 3.0]), (7, [3.0, 3.0, 3.0, 3.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = top_k.top_k(vectors, vectors.filter("vec_id % 40 = 0"), k=6, candidate_block=blocks[0], query_block=blocks[1]).collect()
    once = sorted({(i, tuple(v)) for i, v in rows if i % 40 == 0})
    whole = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows]
    want = []
    for q, v in once:
        v = [int(np.floor(64 * x)) for x in v]
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q)[:6]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    assert sorted(tuple(r) for r in found) == sorted(want) and len(want) == 6 * 6


def test_short_blocks_stay_where_they_are(spark, monkeypatch):
    # The longest vectors fill the first block, and no other can reach their scores.
    rows = [(k, [10.0 if k < 64 else 0.125, float(k % 7) / 64]) for k in range(640)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    joined, join = [], type(vectors).join
    monkeypatch.setattr(type(vectors), "join", lambda self, *a, **b: joined.append(join(self, *a, **b)) or joined[-1])
    found = top_k.top_k(vectors, vectors.filter("vec_id % 100 = 0"), k=5, candidate_block=64, query_block=4)
    pairs = next(df for df in joined if "need" in df.columns).filter("longest >= need")
    assert pairs.count() == 0
    monkeypatch.undo()
    assert {r.vec_id < 64 for r in found.collect()} == {True}
