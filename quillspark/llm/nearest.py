"""Approximate nearest neighbours by inner product with score-aware (anisotropic) quantisation.

A vector is a direction and a length, so that vectors of any length are coded equally well; lengths multiply the sums that codes give.
Directions are parted by their nearest of a few coarse centroids. What is left of each is coded with 4 bits for every WIDTH components. The
codes minimise |r|^2 + (eta - 1) (r.x/|x|)^2, r being the residual: error parallel to the vector changes large inner products and weighs eta
times as much (Guo et al., 2020). Codebooks and codes are found by coordinate descent under that loss. A query reads the parts
whose centroids score highest, adds up 4-bit table entries (two at once, from tables of 256), and the best by these sums are ranked again by exact
inner products in double precision. As the sample's vectors are in the table too, a query's scores with their codes tell beforehand what
its best of all will score; what falls short of that isn't passed on.

How many parts are read and how many are ranked again is first estimated from the sample. TRIAL queries are then compared with every vector; while
the index finds less than AIM of their neighbours, more is read and ranked, up to everything.

Centroids and codebooks are fitted on SAMPLE vectors; every vector is indexed. Parts are read in blocks of bounded rows and queries, so a
part may hold any share of the vectors. Equal vectors are scanned once; of them only the k + 1 of smallest id can be among a query's k
nearest, and these take the place of the one scanned.

Vectors of each length are searched by themselves: those of the INDEXES commonest lengths by an index each, all others, and every one if asked to,
exhaustively, by products of blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._io import written

SAMPLE = 8192
MOST_PARTS = 1024
THRESHOLD = 0.2
#: Components that share a code.
WIDTH = 1
#: Share of a sample query's true neighbours that the parts read must hold, and that must be among those ranked again.
COVER = 0.985
RERANK = 64
#: Standard deviations by which the sample may hold more of a query's best RERANK than its share, and a least score still lets them all through.
SLACK = 3.0
#: Queries that measure the index against all vectors, and the share of their neighbours that it must find.
TRIAL = 128
AIM = 0.95
BLOCK_ROWS = 8192
BLOCK_QUERIES = 2048
#: Bytes of the tables of the queries that are scanned together.
TABLES = 1 << 26
INDEXES = 4
#: How many more than k an exhaustive block passes on by rounded products.
SPARE = 16


@dataclass
class Index:
    centroids: np.ndarray  # parts x dims
    books: np.ndarray  # groups x 16 x WIDTH
    probes: int
    rerank: int
    coded: np.ndarray  # the sample's directions as their codes have them
    length: np.ndarray  # their lengths are length * 2 ** power
    power: np.ndarray
    part: np.ndarray  # and their parts
    total: int
    k: int

    @property
    def through(self) -> int:
        """Of the sample, how many a query's least score lets through."""
        share = len(self.coded) / self.total
        return max(self.k + 1, int(np.ceil(self.rerank * share + SLACK * (self.rerank * share * (1 - share)) ** 0.5)))


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(12):
        near = _nearest(x, centres)
        count = np.bincount(near, minlength=k)
        for d in range(x.shape[1]):
            total = np.bincount(near, weights=x[:, d], minlength=k)
            centres[:, d] = np.where(count > 0, total / np.maximum(count, 1), centres[:, d])
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * (x @ centres.T), axis=1)


def _pairs(x: np.ndarray) -> np.ndarray:
    """n x groups x WIDTH; zeros fill up the last group."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % WIDTH))).reshape(len(x), -1, WIDTH)


def _eta(norm: np.ndarray, dims: int) -> np.ndarray:
    t = THRESHOLD**2
    return np.full(len(norm), max(1.0, (dims - 1) * t / (1 - t)))


def _code(x: np.ndarray, centroids: np.ndarray, part: np.ndarray, books: np.ndarray, rounds: int = 3, start: np.ndarray | None = None) -> np.ndarray:
    """Codes (n x pairs) by coordinate descent."""
    target = _pairs(x - centroids[part])
    norm = np.linalg.norm(x, axis=1)
    way = _pairs(x / norm[:, None])
    extra = _eta(norm, x.shape[1]) - 1
    n, pairs, _ = target.shape
    codes = np.empty((n, pairs), np.int64) if start is None else start.copy()
    if start is None:
        for s in range(pairs):
            codes[:, s] = _nearest(target[:, s], books[s])
    parallel = np.zeros(n)
    for s in range(pairs):
        parallel += ((target[:, s] - books[s][codes[:, s]]) * way[:, s]).sum(1)
    for _ in range(rounds):
        for s in range(pairs):
            own = ((target[:, s] - books[s][codes[:, s]]) * way[:, s]).sum(1)
            left = target[:, s][:, None, :] - books[s][None]
            each = (left * way[:, s][:, None, :]).sum(2)
            loss = (left**2).sum(2) + extra[:, None] * (each + (parallel - own)[:, None]) ** 2
            codes[:, s] = loss.argmin(1)
            parallel += each[np.arange(n), codes[:, s]] - own
    return codes


def _books(x: np.ndarray, centroids: np.ndarray, part: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    target = _pairs(x - centroids[part])
    k = min(16, len(x))
    books = np.stack([_k_means(target[:, s], k, rng) for s in range(target.shape[1])])
    books = np.concatenate((books, np.repeat(books[:, :1], 16 - k, axis=1)), axis=1)
    norm = np.linalg.norm(x, axis=1)
    way = _pairs(x / norm[:, None])
    extra = _eta(norm, x.shape[1]) - 1
    codes = None
    for _ in range(4):
        codes = _code(x, centroids, part, books, 1, codes)
        parallel = sum(((target[:, s] - books[s][codes[:, s]]) * way[:, s]).sum(1) for s in range(target.shape[1]))
        for s in range(target.shape[1]):
            c, w, t = codes[:, s], way[:, s], target[:, s]
            own = ((t - books[s][c]) * w).sum(1)
            rest = parallel - own
            a = np.zeros((16, WIDTH, WIDTH))
            b = np.zeros((16, WIDTH))
            for i in range(WIDTH):
                b[:, i] = np.bincount(c, weights=t[:, i] + extra * w[:, i] * (rest + (t * w).sum(1)), minlength=16)
                for j in range(WIDTH):
                    a[:, i, j] = np.bincount(c, weights=(i == j) + extra * w[:, i] * w[:, j], minlength=16)
            used = np.bincount(c, minlength=16) > 1
            books[s][used] = np.linalg.solve(a[used] + 1e-9 * np.eye(WIDTH), b[used][..., None])[..., 0]
            parallel = rest + ((t - books[s][c]) * w).sum(1)
    return books


def _split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions, and lengths as length * 2 ** power, which neither overflow nor vanish."""
    power = np.frexp(np.abs(x).max(axis=1))[1]
    x = np.ldexp(x, -power[:, None])
    length = np.linalg.norm(x, axis=1)
    return x / length[:, None], length, power


def fit(x: np.ndarray, total: int, k: int) -> Index:
    """x: a sample of the total vectors."""
    x, length, power = _split(x)
    far = np.ldexp(length, power - power.max())
    rng = np.random.default_rng(7)
    parts = int(min(MOST_PARTS, max(1, len(x) // 16), max(1, round(total**0.5 / 2))))
    centroids = _k_means(x, parts, rng)
    part = _nearest(x, centroids)
    books = _books(x, centroids, part, rng)
    asked = x[rng.choice(len(x), min(256, len(x)), replace=False)]
    true = np.argsort(-(asked @ x.T * far), axis=1)[:, : min(k + 1, len(x))]
    rank = np.argsort(np.argsort(-(asked @ centroids.T), axis=1), axis=1)
    place = rank[np.arange(len(asked))[:, None], part[true]]
    covered = np.bincount(place.ravel(), minlength=parts).cumsum() / place.size
    probes = int(np.searchsorted(covered, COVER)) + 1
    codes = _code(x, centroids, part, books)
    coded = centroids[part] + np.take_along_axis(books, codes.T[:, :, None], axis=1).transpose(1, 0, 2).reshape(len(x), -1)[:, : x.shape[1]]
    guess = np.argsort(np.argsort(-(asked @ coded.T * far), axis=1), axis=1)
    at = np.sort(guess[np.arange(len(asked))[:, None], true].ravel())
    # A larger table is denser around a query's neighbours than the sample.
    rerank = max(RERANK, int((at[int(COVER * (len(at) - 1))] + 1) * max(1.0, total / len(x)) ** 0.5))
    return Index(centroids, books, min(probes, parts), rerank, coded.astype(np.float32), length, power, part, total, k)


def _least(q: np.ndarray, length: np.ndarray, power: np.ndarray, near: np.ndarray, index: Index) -> np.ndarray:
    """Of each query the score that index.through sample vectors of its parts reach; -inf if these parts hold fewer."""
    out = np.full(len(q), -np.inf)
    if index.through > len(index.coded):
        return out
    for at in range(0, len(q), 256):
        read = np.zeros((len(q[at : at + 256]), len(index.centroids)), bool)
        np.put_along_axis(read, near[at : at + 256], True, axis=1)
        # The tables' sums are rounded otherwise.
        turned = (q[at : at + 256].astype(np.float32) @ index.coded.T).astype(np.float64) - 1e-5
        score = np.ldexp(turned * index.length * length[at : at + 256, None], index.power + power[at : at + 256, None])
        score = np.where(read[:, index.part], score, -np.inf)
        out[at : at + 256] = np.partition(score, -index.through, axis=1)[:, -index.through]
    return out


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _array(batch, name: str) -> np.ndarray:
    column = batch.column(name)
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def _best(scores: np.ndarray, most: int) -> np.ndarray:
    """Places of the most largest scores, earlier places first among equals."""
    if len(scores) <= most:
        return np.arange(len(scores))
    edge = np.partition(scores, len(scores) - most)[len(scores) - most]
    over = np.flatnonzero(scores > edge)
    return np.concatenate((over, np.flatnonzero(scores == edge)[: most - len(over)]))


def _blocked(candidates: DataFrame, asking: DataFrame, key: str, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt to (key, block, turn) so that each block meets each turn once. sizes: key, rows and readers (blocks and turns of the key)."""
    left = candidates.join(sizes, key).withColumns({"block": F.pmod(F.xxhash64("vec_id"), F.col("rows")), "turn": F.explode(F.sequence(F.lit(0).cast("long"), F.col("readers") - 1))}).drop("rows", "readers")
    right = asking.join(sizes, key).withColumns({"turn": F.pmod(F.xxhash64("query_id"), F.col("readers")), "block": F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))}).drop("rows", "readers")
    return left, right


def _exhaustive(reps: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, rep): of each block the k best of each query of the same length, and some more."""
    length = lambda rows: rows.withColumn("d", F.size("v"))
    count = lambda rows, most, name: length(rows).groupBy("d").agg(F.ceil(F.count("*") / most).cast("long").alias(name))
    sizes = written(count(reps, BLOCK_ROWS, "rows").join(count(asked, BLOCK_QUERIES, "readers"), "d"), "sizes")
    left, right = _blocked(length(reps), length(asked.withColumnRenamed("vec_id", "query_id")), "d", sizes)

    def scan(key, candidates: pa.Table, asking: pa.Table) -> pa.Table:
        found_q, found_v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(candidates) and len(asking):
            ids, names, x, q = candidates.column("vec_id").to_numpy(), asking.column("query_id").to_numpy(), _array(candidates, "v"), _array(asking, "v")
            for at in range(0, len(q), 256):
                for name, score in zip(names[at : at + 256], q[at : at + 256] @ x.T):
                    most = min(k + 1 + SPARE, len(score))
                    best = np.partition(score, len(score) - most)[len(score) - most]
                    near = np.flatnonzero(score >= best - 1e-9 * (abs(best) + 1e-300))
                    found_q.append(np.full(len(near), name))
                    found_v.append(ids[near])
        return pa.table({"query_id": np.concatenate(found_q).astype(np.int64), "rep": np.concatenate(found_v).astype(np.int64)})

    return left.groupBy("d", "block", "turn").cogroup(right.groupBy("d", "block", "turn")).applyInArrow(scan, "query_id bigint, rep bigint")


def _indexed(reps: DataFrame, asked: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """(query_id, rep): the candidates that are ranked again, of vectors of one number of components."""
    spark = reps.sparkSession
    total = reps.count()
    found = reps.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    index = fit(_array(found, "v"), total, k)
    sent = spark.sparkContext.broadcast(index)

    def encode(batches):
        index = sent.value
        for batch in batches:
            x = _array(batch, "v")
            if len(x):
                x, length, power = _split(x)
                part = _nearest(x, index.centroids)
                codes = np.concatenate([_code(x[a : a + 2048], index.centroids, part[a : a + 2048], index.books) for a in range(0, len(x), 2048)])
                codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
                packed = (codes[:, 0::2] << 4 | codes[:, 1::2]).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(part.astype(np.int32)), pa.array([r.tobytes() for r in packed], pa.binary()), pa.array(length), pa.array(power.astype(np.int32))], names=["vec_id", "part", "codes", "length", "power"])

    coded = written(reps.mapInArrow(encode, "vec_id bigint, part int, codes binary, length double, power int"), "codes")

    # The parts' sizes are MOST_PARTS numbers at most. Enough parts are read to hold k others in any case.
    sizes = {r["part"]: r["count"] for r in coded.groupBy("part").count().collect()}
    enough = int(np.searchsorted(np.cumsum(sorted(sizes.values())), k + 1)) + 1 + len(index.centroids) - len(sizes)
    index.probes = min(len(index.centroids), max(index.probes, enough))

    trial = written(asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRIAL), "trial")
    true = written(_ranked(_exhaustive(reps, trial, k), trial, copies, k), "true")
    wanted = true.count()
    while index.probes < len(index.centroids) or index.rerank < total:
        met = _ranked(_searched(coded, sizes, trial, index), trial, copies, k).join(true.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count()
        if met >= AIM * wanted:
            break
        index.probes, index.rerank = min(2 * index.probes, len(index.centroids)), min(4 * index.rerank, total)
    return _searched(coded, sizes, asked, index)


def _searched(coded: DataFrame, sizes: dict[int, int], asked: DataFrame, index: Index) -> DataFrame:
    """(query_id, rep): of each query the index.rerank best by their codes, in the index.probes parts that it reads. sizes: rows of each part."""
    spark = coded.sparkSession
    sent_probes = spark.sparkContext.broadcast(index)

    def probe(batches):
        index = sent_probes.value
        for batch in batches:
            x = _array(batch, "v")
            if len(x):
                x, length, power = _split(x)
                score = x @ index.centroids.T
                near = np.argpartition(-score, index.probes - 1, axis=1)[:, : index.probes] if index.probes < score.shape[1] else np.tile(np.arange(score.shape[1]), (len(x), 1))
                which = np.repeat(np.arange(len(x)), near.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(which)), pa.array(near.ravel().astype(np.int32)), pa.array(_least(x, length, power, near, index)[which])], names=["query_id", "part", "least"])

    told = written(asked.select("vec_id", "v").mapInArrow(probe, "query_id bigint, part int, least double"), "probes")
    readers = {r["part"]: r["count"] for r in told.groupBy("part").count().collect()}
    blocks = spark.createDataFrame([(int(p), -(-n // BLOCK_ROWS), -(-readers.get(p, 0) // BLOCK_QUERIES)) for p, n in sizes.items() if p in readers] or [(-1, 1, 1)], "part int, rows bigint, readers bigint")
    left, right = _blocked(coded, told.join(asked.select(F.col("vec_id").alias("query_id"), "v"), "query_id"), "part", F.broadcast(blocks))

    def scan(key, candidates: pa.Table, asking: pa.Table) -> pa.Table:
        index = sent_probes.value
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "guess": pa.array([], pa.float64())})
        if not len(candidates) or not len(asking):
            return empty
        candidates = candidates.sort_by("vec_id")
        ids = candidates.column("vec_id").to_numpy()
        codes = np.frombuffer(b"".join(candidates.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1).T.astype(np.int64)
        length, power = candidates.column("length").to_numpy(), candidates.column("power").to_numpy()
        (q, far, of), names = _split(_array(asking, "v")), asking.column("query_id").to_numpy()
        base = q @ index.centroids[key[0].as_py()]
        least = asking.column("least").to_numpy()
        together = max(1, TABLES // (len(codes) * 256 * 4))
        out_q, out_v, out_s = [], [], []
        for at in range(0, len(q), together):
            tables = np.einsum("nsd,scd->nsc", _pairs(q[at : at + together]), index.books)
            tables = np.pad(tables, ((0, 0), (0, tables.shape[1] % 2), (0, 0)))
            two = (tables[:, 0::2, :, None] + tables[:, 1::2, None, :]).reshape(len(tables), -1, 256).astype(np.float32)
            for i in range(at, at + len(two)):
                score = np.zeros(len(ids), np.float32)
                for s in range(len(codes)):
                    score += two[i - at, s][codes[s]]
                score = np.ldexp((score + base[i]) * length * far[i], power + of[i])
                over = np.flatnonzero(score >= least[i])
                over = over[_best(score[over], index.rerank)]
                out_q.append(np.full(len(over), names[i]))
                out_v.append(ids[over])
                out_s.append(score[over])
        return pa.table({"query_id": np.concatenate(out_q).astype(np.int64), "vec_id": np.concatenate(out_v), "guess": np.concatenate(out_s).astype(np.float64)})

    guesses = left.select("part", "block", "turn", "vec_id", "codes", "length", "power").groupBy("part", "block", "turn").cogroup(right.select("part", "block", "turn", "query_id", "least", "v").groupBy("part", "block", "turn")).applyInArrow(scan, "query_id bigint, vec_id bigint, guess double")
    by_guess = Window.partitionBy("query_id").orderBy(F.desc("guess"), "vec_id")
    return guesses.withColumn("place", F.row_number().over(by_guess)).where(F.col("place") <= index.rerank).select("query_id", F.col("vec_id").alias("rep"))


def _ranked(found: DataFrame, asked: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """Of the candidates found (query_id, rep) and their copies, each query's k nearest by exact products."""
    exact = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    scored = found.join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id").join(copies.select("rep", "vec_id", "v"), "rep").where("vec_id <> query_id").select("query_id", "vec_id", exact.alias("score"))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(vectors: DataFrame, queries: Column, k: int = 20, exhaustive: bool = False) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest of each vector for which queries holds, among all others of its length.

    vectors: vec_id, embedding; other columns are ignored. Vectors that are null, zero, empty, or hold null or non-finite components, and rows of
    null vec_id, take no part. Rows that repeat a vec_id count once, with the smallest embedding. Ties go to the smaller vec_id. A query gets fewer rows if
    there are fewer candidates. An empty table gives no rows. exhaustive: compare every pair of query and vector instead of using an index.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), queries.alias("asks")).where(F.col("vec_id").isNotNull() & _usable(F.col("v")))
    rows = written(rows.groupBy("vec_id").agg(F.min("v").alias("v"), F.max("asks").alias("asks")), "vectors")
    lengths = [r["d"] for r in rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(INDEXES + 1).collect()]
    if not lengths:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    first = Window.partitionBy("v").orderBy("vec_id")
    copies = written(rows.withColumn("copy", F.row_number().over(first)).where(F.col("copy") <= k + 1).withColumn("rep", F.min("vec_id").over(Window.partitionBy("v"))), "copies")
    reps, asked = copies.where("copy = 1").select("vec_id", "v"), rows.where("asks").select("vec_id", "v")
    of = lambda frame, d: frame.where(F.size("v") == d)
    indexed = [] if exhaustive else lengths[:INDEXES]
    short = [_indexed(of(reps, d), of(asked, d), copies, k) for d in indexed]
    if len(lengths) > len(indexed):
        others = lambda frame: frame.where(~F.size("v").isin(indexed)) if indexed else frame
        short.append(_exhaustive(others(reps), others(asked), k))
    found = short[0]
    for more in short[1:]:
        found = found.unionByName(more)
    return _ranked(found, asked, copies, k)
