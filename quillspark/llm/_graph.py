"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a")
    return moved.select("a", F.col("m").alias("b")).unionByName(moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()


def stars(edges: DataFrame, used: Iterable[DataFrame] = ()) -> DataFrame:
    """Rows (a, b): b is the smallest node of a's component, for every a that isn't its own. Nulls and loops in edges are ignored.

    Every round halves paths or better and is written to the shared folder, so a lost executor costs one round. used: see written().
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges", used)
    state = None
    while True:
        told = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(told) == state or told[0] == 0:
            return now
        state = tuple(told)
        now = written(_small_star(_large_star(now)), "edges", [now])
