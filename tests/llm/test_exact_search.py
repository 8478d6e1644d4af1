"""Exact search against brute force: odd vectors, copies, ties, several lengths and huge components; and that bounds hold and save work."""

import math

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import exact_search


def whole(v):
    return [max(-(2**63), min(2**63 - 1, math.floor(64 * x))) if math.isfinite(64 * x) else (2**63 - 1 if x > 0 else -(2**63)) for x in v]


def brute(rows, asks, k):
    vectors = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            vectors[i] = min(whole(v), vectors.get(i, whole(v)))
    out = []
    for i, q in vectors.items():
        if asks(i):
            scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v)))), j) for j, v in vectors.items() if j != i and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def test_exact(spark, monkeypatch):
    monkeypatch.setattr(exact_search, "BLOCK_ROWS", 90)
    monkeypatch.setattr(exact_search, "BLOCK_QUERIES", 20)
    monkeypatch.setattr(exact_search, "SAMPLE", 50)
    monkeypatch.setattr(exact_search, "SAMPLED", 3)
    rng = np.random.default_rng(3)
    rows, centres = [], rng.normal(size=(6, 8)) * 3
    for i in range(400):
        rows.append((i, (centres[i % 6] + rng.normal(size=8) * 0.2).tolist()))
    rows += [(400 + i, rows[20][1]) for i in range(60)]  # copies
    rows += [(500 + i, [float(x) for x in rng.integers(-1, 2, 3)]) for i in range(90)]  # ties
    rows += [(600 + i, rng.normal(size=2).tolist()) for i in range(12)] + [(620, []), (621, []), (640, [0.5]), (700, [0.0] * 8), (705, [0.001] * 8)]
    rows += [(720, [1e30] * 5), (721, [-1e30] * 5), (722, [1e9] * 5), (725, [1e300, -1e300, 0.0, 1.0, 2.0]), (730, [3e7] * 5)]
    rows += [(None, [1.0] * 8), (740, None), (745, [1.0, None] * 4), (750, [float("nan")] * 8), (755, [float("inf")] * 8), (5, [9.0] * 8), (20, rows[20][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit("clash"), "d": F.lit(1), "v": F.lit(2), "query_id": F.lit(3)})
    want = brute(rows, lambda i: i % 5 == 0, 7)
    got = sorted(map(tuple, exact_search.exact_search(frame, F.col("vec_id") % 5 == 0, 7).collect()))
    assert got == want
    assert exact_search.exact_search(frame.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    assert exact_search.exact_search(frame, F.lit(False)).count() == 0


def test_bounds_hold_and_candidates_are_left_out():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16)) * 60
    x = np.floor(centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 16)) * 5).astype(np.int64)
    pivots = exact_search.choose(x[:500])
    assert not pivots[0].any() and len(np.unique(pivots, axis=0)) == len(pivots)
    far, norm = exact_search._distances(x, pivots), (x.astype(float) ** 2).sum(1)
    for i in range(0, 3000, 250):
        top = exact_search.bounds(np.ascontiguousarray(far.T), norm, far[i], norm[i])
        score = x @ x[i]
        assert (top >= score).all()
        rows, q = exact_search.exactly(x, x[i])
        got, best, evaluated = exact_search.best(rows, np.arange(3000), top, q, -(2**63), 21)
        want = np.lexsort((np.arange(3000), -score))[:21]
        assert got.tolist() == want.tolist() and best.tolist() == score[want].tolist()
        assert evaluated < 1500
