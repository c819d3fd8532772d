"""Exact top-k against all scores."""

import math

import numpy as np
import pytest

from sparkrel.llm import topk


def brute(rows, asked, k):
    good = [(i, [math.floor(256 * x) for x in np.float32(v).astype(float)]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {i: v for i, v in sorted(good, key=lambda r: (r[0], r[1]), reverse=True) if i in asked}.items():
        scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q and len(a) == len(b))[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)}
    return out


def found(spark, rows, asked, k=5):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    return [tuple(r) for r in topk.search(df, df.where(df.vec_id.isin(asked)), k).collect()]


@pytest.mark.parametrize("bins", [4, 2048])
def test_random_vectors_with_ties(spark, monkeypatch, bins):
    monkeypatch.setattr(topk, "BINS", bins)
    monkeypatch.setattr(topk, "BLOCK", 3)
    rng = np.random.default_rng(0)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(300)] + [(i, [1.0, 0.0, 0.0, 1.0]) for i in range(300, 500)]
    got = found(spark, rows, [0, 7, 310, 311, 499, 250, 3])
    assert len(got) == 35 and set(got) == brute(rows, [0, 7, 310, 311, 499, 250, 3], 5)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.5]), (2, None), (3, [0.1, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (None, [0.5, 0.5]), (6, [-0.3, 0.001]), (7, [1.0, 2.0, 3.0]), (8, [])]
    assert set(found(spark, rows, [1, 2, 4, 7, 8])) == {(1, 1, 6, math.floor(256 * float(np.float32(-0.3))) * 128)}
    assert found(spark, [], [1]) == [] and found(spark, rows, [2]) == []


def test_large_components_are_exact_or_refused(spark):
    rows = [(1, [2.0**22, 1.0]), (2, [2.0**22, 2.0]), (3, [2.0**22, 3.0])]
    assert set(found(spark, rows, [1])) == brute(rows, [1], 5)
    with pytest.raises(OverflowError):
        found(spark, [(1, [1e30]), (2, [1e30])], [1])


def test_query(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    got = {tuple(r) for r in topk.op5_topk(spark, small).collect()}
    assert got == brute(rows, {i for i, _ in rows if i % 50 == 0}, 5)
