"""Exact top-k search by integer inner product, with a table of distances to pivots.

Every vector's distances to the pivots, PIVOTS vectors of a bounded sample chosen far from each other and the origin, are worked out once and kept. As
|q - v| >= | |q - p| - |v - p| | for each pivot p, the largest of these differences gives the least distance, and
q.v = (|q|^2 + |v|^2 - |q - v|^2) / 2 the largest product that a candidate may have (with the origin alone that is |q| |v|). Candidates are
evaluated in the order of this bound, exactly, until it falls below the k-th best found. A query's products with the sample, whose vectors are
in the table too, give it a k-th best to begin with.

Queries meet candidates in blocks of bounded rows. Equal vectors are evaluated once; of them only the k + 1 of smallest id can be among a query's k
best, and these take the place of the one evaluated. Vectors of each length are searched by themselves. Lengths beyond the SAMPLED commonest have
the origin as their only pivot, which changes the work and not the result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._io import written
from .nearest import _blocked

SCALE = 64
SAMPLE = 2048
PIVOTS = 32
SAMPLED = 4
BLOCK_ROWS = 8192
BLOCK_QUERIES = 1024
#: Of the distances' size, what a bound gives way for their rounding to 32 bits.
SLACK = 1e-5


@dataclass
class Pivots:
    pivots: np.ndarray  # pivots x dims; the first is the origin
    ids: np.ndarray  # of the sample
    sample: np.ndarray  # its vectors


def exactly(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x and q as the smallest kind of number in which their products and all sums of these are exact."""
    most = float(np.abs(x.astype(float)).max(initial=0)) * float(np.abs(q.astype(float)).max(initial=0)) * x.shape[1]
    kind = np.float32 if most < 2.0**24 else np.float64 if most < 2.0**53 else np.int64 if most < 2.0**62 else object
    return x.astype(kind), q.astype(kind)


def _whole(score: np.ndarray) -> np.ndarray:
    """Products as 64-bit integers, held at the ends of these."""
    return (np.clip(score, -(2**63), 2**63 - 1) if score.dtype == object else score).astype(np.int64)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x, p = x.astype(float), pivots.astype(float)
    return np.stack([np.sqrt(((x - each) ** 2).sum(1)) for each in p], axis=1).astype(np.float32)


def choose(x: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """The origin and rows of x, each the farthest from those before."""
    chosen = [np.zeros(x.shape[1], np.int64)]
    nearest = _distances(x, np.stack(chosen))[:, 0]
    while len(chosen) <= most and len(x) and nearest.max() > 0:
        chosen.append(x[int(nearest.argmax())])
        nearest = np.minimum(nearest, _distances(x, chosen[-1][None])[:, 0])
    return np.stack(chosen)


def bounds(far: np.ndarray, norm: np.ndarray, q_far: np.ndarray, q_norm: float) -> np.ndarray:
    """The largest product that each candidate may have. far: pivots x candidates; norm: of candidates, squared."""
    least = np.zeros(far.shape[1], np.float32)
    for own, each in zip(q_far, far):
        np.maximum(least, np.abs(each - own), out=least)
    slack = SLACK * (float(q_far.max(initial=0)) + float(far.max(initial=0)))
    least = np.maximum(least.astype(float) - slack, 0.0)
    top = (q_norm + norm - least**2) / 2
    return top + 1e-9 * (q_norm + norm) + 1e-6


def best(x: np.ndarray, ids: np.ndarray, top: np.ndarray, q: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, products, evaluated): the k largest products of at least ``least``, ties to smaller ids; candidates are taken by top, their bounds, until these fall short.

    x and q: as exactly() gives them.
    """
    over = np.flatnonzero(top >= least)
    over = over[np.argsort(-top[over], kind="stable")]
    got, score, at, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 8 * k
    while at < len(over) and top[over[at]] >= least:
        take = over[at : at + step]
        new = _whole(x[take] @ q)
        reach = new >= least
        got, score = np.concatenate((got, ids[take[reach]])), np.concatenate((score, new[reach]))
        keep = np.lexsort((got, ~score))[:k]  # ~ turns the order around without leaving 64 bits
        got, score = got[keep], score[keep]
        if len(score) == k:
            least = max(least, int(score[-1]))
        at, step = at + len(take), step * 2
    return got, score, at


def _matrix(column, kind=np.int64) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind) if len(column) else np.zeros((0, 0), kind)


def _measured(rows: DataFrame, sent, k: int) -> DataFrame:
    """rows (vec_id, d, v) with far, the distances to the pivots of their length, and least, a product that the k-th best has at least."""

    def measure(batches):
        for batch in batches:
            lengths = batch.column("d").to_numpy(zero_copy_only=False)
            for d in np.unique(lengths):
                part = batch.filter(pa.array(lengths == d))
                x, ids, pivots = _matrix(part.column("v")).reshape(len(part), d), part.column("vec_id").to_numpy(), sent.value.get(int(d))
                far = _distances(x, pivots.pivots if pivots else np.zeros((1, d), np.int64))
                least = np.full(len(x), -(2**63), np.int64)
                if k and pivots:
                    sample, q = exactly(pivots.sample, x)
                    for i, own in enumerate(ids):
                        score = _whole(sample @ q[i])[pivots.ids != own]
                        if len(score) >= k:
                            least[i] = np.partition(score, -k)[-k]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("d"), part.column("v"), pa.array(list(far), pa.list_(pa.float32())), pa.array(least)], names=["vec_id", "d", "v", "far", "least"])

    return rows.mapInArrow(measure, "vec_id bigint, d int, v array<bigint>, far array<float>, least bigint")


def exact_search(vectors: DataFrame, queries: Column, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of each vector for which queries holds, among all others of its length.

    vectors: vec_id, embedding; other columns are ignored. A component x becomes floor(64 x), held at the ends of 64 bits as the score is. Vectors that
    are null or hold null or non-finite components, and rows of null vec_id, take no part; zero and empty vectors do. Rows that repeat a vec_id count
    once, with the smallest vector. Ties go to the smaller vec_id. A query gets fewer rows if there are fewer candidates. An empty table gives
    no rows.
    """
    spark = vectors.sparkSession
    given = F.col("embedding").cast("array<double>")
    finite = F.forall(given, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(given, lambda x: F.floor(F.lit(float(SCALE)) * x).cast("long"))
    rows = vectors.where(F.col("vec_id").isNotNull() & given.isNotNull() & F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"), queries.alias("asks"))
    rows = written(rows.groupBy("vec_id").agg(F.min("v").alias("v"), F.max("asks").alias("asks")).withColumn("d", F.size("v")), "vectors")
    first = Window.partitionBy("v").orderBy("vec_id")
    copies = written(rows.withColumn("copy", F.row_number().over(first)).where(F.col("copy") <= k + 1).withColumn("rep", F.min("vec_id").over(Window.partitionBy("v"))), "copies")
    reps, asked = copies.where("copy = 1").select("vec_id", "d", "v"), rows.where("asks").select("vec_id", "d", "v")

    common = [r["d"] for r in reps.groupBy("d").count().orderBy(F.desc("count"), "d").limit(SAMPLED).collect()]
    pivots = {}
    for d in common:
        sample = reps.where(F.col("d") == d).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec_id", "v").toArrow()
        x = _matrix(sample.column("v")).reshape(len(sample), d)
        pivots[d] = Pivots(choose(x), sample.column("vec_id").to_numpy(), x)
    sent = spark.sparkContext.broadcast(pivots)
    known = written(_measured(reps, sent, 0).drop("least"), "pivots")
    asking = written(_measured(asked, sent, k + 1).withColumnRenamed("vec_id", "query_id"), "asking")

    count = lambda frame, most, name: frame.groupBy("d").agg(F.ceil(F.count("*") / most).cast("long").alias(name))
    sizes = written(count(known, BLOCK_ROWS, "rows").join(count(asking, BLOCK_QUERIES, "readers"), "d"), "sizes")
    left, right = _blocked(known, asking, "d", sizes)

    def scan(key, candidates: pa.Table, asking: pa.Table) -> pa.Table:
        found_q, found_v, found_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(candidates) and len(asking):
            d = key[0].as_py()
            candidates = candidates.sort_by("vec_id")
            ids, x, far = candidates.column("vec_id").to_numpy(), _matrix(candidates.column("v")).reshape(len(candidates), d), np.ascontiguousarray(_matrix(candidates.column("far"), np.float32).T)
            q, q_far = _matrix(asking.column("v")).reshape(len(asking), d), _matrix(asking.column("far"), np.float32)
            norm, q_norm = (x.astype(float) ** 2).sum(1), (q.astype(float) ** 2).sum(1)
            x, q = exactly(x, q)
            for i, (name, least) in enumerate(zip(asking.column("query_id").to_pylist(), asking.column("least").to_pylist())):
                got, score, _ = best(x, ids, bounds(far, norm, q_far[i], q_norm[i]), q[i], least, k + 1)
                found_q.append(np.full(len(got), name, np.int64))
                found_v.append(got)
                found_s.append(score)
        return pa.table({"query_id": np.concatenate(found_q), "rep": np.concatenate(found_v), "score": np.concatenate(found_s)})

    by = lambda frame: frame.groupBy("d", "block", "turn")
    found = by(left).cogroup(by(right)).applyInArrow(scan, "query_id bigint, rep bigint, score bigint")
    of_reps = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")
    few = found.withColumn("_place", F.row_number().over(of_reps)).where(F.col("_place") <= k + 1)
    every = few.join(copies.select("rep", "vec_id"), "rep").where("vec_id <> query_id")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
with usable as (
  select vec_id, list_transform(embedding::double[], lambda x: floor(64 * x)::bigint) as v, len(embedding) as d from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score
  from usable q join usable c on q.d = c.d and q.vec_id <> c.vec_id where q.vec_id % 20 = 0)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::integer as rank, vec_id, score from scored
qualify rank <= 20
"""
