"""The index finds neighbours whatever the vectors' lengths."""

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import nearest


def test_very_short_and_very_long_vectors(spark):
    rng = np.random.default_rng(5)
    made = {16: rng.normal(size=(1200, 16)) * 1e30, 12: rng.normal(size=(1200, 12)) * 1e-30}
    vectors = [v for d in made for v in made[d]]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.nearest(frame, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    shares = []
    for first, x in ((0, made[16]), (1200, made[12])):
        for i in range(0, 1200, 20):
            score = x @ x[i]
            score[i] = -np.inf
            shares.append(len(got.get(first + i, set()) & set((np.argsort(-score)[:20] + first).tolist())) / 20)
    assert np.mean(shares) >= 0.9
