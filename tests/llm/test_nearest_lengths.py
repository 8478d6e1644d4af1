"""Vectors of several lengths, copies, odd rows, and the exhaustive way, against brute force."""

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import nearest

EVERY = "vec_id % 5 = 0"


def brute(vectors, k):
    out = {}
    for i, q in vectors.items():
        if i % 5 == 0:
            scored = sorted((-float(np.cumsum(q * v)[-1]), j) for j, v in vectors.items() if j != i and len(v) == len(q))[:k]
            out[i] = [(j, -s) for s, j in scored]
    return {i: x for i, x in out.items() if x}


def test_lengths(spark):
    rng = np.random.default_rng(4)
    vectors = {}
    for d, n in ((8, 300), (3, 60), (1, 25), (2, 12), (5, 10), (7, 6), (9, 1)):
        for _ in range(n):
            vectors[len(vectors)] = rng.normal(size=d)
    for i in range(20, 60):
        vectors[i] = vectors[20]
    rows = [(i, v.tolist(), "x") for i, v in vectors.items()] + [(0, (vectors[0] + 1).tolist(), "x"), (None, [1.0] * 8, "x"), (9000, [], "x"), (9005, None, "x"), (9010, [float("inf")] * 8, "x"), (9015, [0.0] * 3, "x"), (9020, [1.0, None, 2.0], "x")]
    vectors[0] = min(vectors[0], vectors[0] + 1, key=lambda v: v.tolist())
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").withColumn("rank", F.lit("clash"))
    want = brute(vectors, 4)
    read = lambda out: {i: [(r["vec_id"], r["score"]) for r in sorted(rs, key=lambda r: r["rank"])] for i, rs in group(out.collect()).items()}
    assert read(nearest.nearest(frame, F.expr(EVERY), 4, exhaustive=True)) == want
    got = read(nearest.nearest(frame, F.expr(EVERY), 4))
    assert got.keys() == want.keys() and all(len(got[i]) == len(want[i]) for i in want)
    assert np.mean([len({j for j, _ in got[i]} & {j for j, _ in want[i]}) / len(want[i]) for i in want]) > 0.95
    # The fifth length and those after it have no index.
    assert all(got[i] == want[i] for i in want if len(vectors[i]) in (7, 9))


def group(rows):
    out = {}
    for r in rows:
        out.setdefault(r["query_id"], []).append(r)
    return out


def test_recall_of_the_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    by = lambda rows: {i: {r["vec_id"] for r in rs} for i, rs in group(rows).items()}
    queries = F.col("vec_id") % 20 == 0
    got, want = by(nearest.nearest(frame, queries).collect()), by(nearest.nearest(frame, queries, exhaustive=True).collect())
    assert got.keys() == want.keys() and np.mean([len(got[i] & want[i]) / len(want[i]) for i in want]) >= 0.9
