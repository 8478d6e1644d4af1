"""A kept inverted index of passages: written once, searched by many queries, each of which reads the buckets of its own terms only.

postings/bucket=b: pool, term, block, keys, tf, len. Terms are dealt to buckets by hash; rows are written by ranges of (bucket, pool, term, block), so a
term of any number of passages fills as many tasks and files as it needs, and stays sorted for the reader's statistics.
blocks/bucket=b: pool, term, block, rows, most: of each term and block, how many passages hold it, and the largest share of a score that one can have,
without the term's weight.
terms/bucket=b: pool, term, df. pools: pool, n, avg_len. passages: keys, len.

A block holds passages of one pool and of about one length, by halves of a power of two, dealt by hash, so that maxima of blocks differ. Top-k search
adds the maxima up to a bound of each block, scores the blocks of largest bound until these hold a few times k passages, and then only the blocks whose bound reaches
the k-th score found. What is left out can't be among the k best, so the result is that of scoring everything.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import counted_words, tokens
from ..sources.shared import delete, kept
from .ranking import B, K1

BUCKETS = 64
#: Passages of a block, about.
BLOCK = 1024
#: So many different terms are named in the filter of a scan; more meet it in a join of their own, before any other.
NAMED = 256
#: Times k passages that the first blocks scored hold.
AHEAD = 4
#: By how much a bound is raised for the rounding of sums.
SLACK = 1e-9


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _share(avg_len: Column) -> Column:
    """What a term's occurrences are worth in a passage, before its weight."""
    return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / avg_len))


@dataclass
class Index:
    spark: SparkSession
    path: str
    keys: list[str]  # of a passage, the pool among them
    pool: list[str]
    buckets: int = BUCKETS

    def part(self, name: str) -> DataFrame:
        """A part by its name; without rows, its folders have no files to tell its columns."""
        passages = self.spark.read.parquet(f"{self.path}/passages")
        kinds = lambda names: "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in passages.select(*names).schema)
        schema = {
            "passages": kinds(passages.columns).rstrip(", "), "pools": kinds(self.pool) + "n bigint, avg_len double", "terms": kinds(self.pool) + "term string, df bigint, bucket int",
            "postings": kinds(self.keys) + "term string, tf bigint, len bigint, block bigint, bucket int", "blocks": kinds(self.pool) + "term string, block bigint, rows bigint, most double, bucket int"}
        return self.spark.read.schema(schema[name]).parquet(f"{self.path}/{name}")

    @property
    def passages(self) -> DataFrame:
        """keys, len: every passage, also without tokens."""
        return self.part("passages")

    @property
    def counts(self) -> DataFrame:
        """keys, term, tf."""
        return self.part("postings").select(*self.keys, "term", "tf")

    @property
    def frequencies(self) -> DataFrame:
        """pool, term, df."""
        return self.part("terms").drop("bucket")

    def _of(self, name: str, asked: DataFrame) -> DataFrame:
        """Rows of a part for the terms asked for, read from their buckets only. asked: pool, term."""
        told = asked.select("term").distinct()
        buckets = [r["b"] for r in told.select(_bucket(F.col("term"), self.buckets).alias("b")).distinct().collect()]  # at most BUCKETS numbers
        out = self.part(name).where(F.col("bucket").isin(buckets) if buckets else F.lit(False))
        named = [r["term"] for r in told.limit(NAMED + 1).collect()]
        if 0 < len(named) <= NAMED:
            return out.where(F.col("term").isin(named))
        return out.join(asked.select(*self.pool, "term").distinct(), [*self.pool, "term"], "left_semi")

    def weights(self, queries: DataFrame, query_keys: list[str]) -> DataFrame:
        """pool, query_keys, term, idf, avg_len of the terms of queries (pool, query_keys, query) that the pool holds."""
        asked = kept(queries.select(*self.pool, *query_keys, F.explode(F.array_distinct(tokens(F.col("query")))).alias("term")), "asked")
        met = asked.join(self._of("terms", asked).drop("bucket"), [*self.pool, "term"])
        pools = self.part("pools")
        met = met.join(pools, self.pool) if self.pool else met.crossJoin(F.broadcast(pools))  # without a pool, pools is one row
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return kept(met.select(*self.pool, *query_keys, "term", idf.alias("idf"), "avg_len"), "weights", [asked])

    def _scored(self, weights: DataFrame, chosen: DataFrame, query_keys: list[str]) -> DataFrame:
        """keys, query_keys, score of all passages of the chosen blocks (pool, query_keys, block) that hold a term."""
        wanted = weights.join(chosen, [*self.pool, *query_keys])
        rows = self._of("postings", weights).drop("bucket").join(wanted, [*self.pool, "term", "block"])
        return rows.groupBy(*self.keys, *query_keys).agg(F.sum(F.col("idf") * _share(F.col("avg_len"))).alias("score"))

    def search(self, queries: DataFrame, query_keys: list[str], k: int, digits: int = 6) -> DataFrame:
        """keys, query_keys, score, rank: the k best passages of each query (pool, query_keys, query) in its pool, of those that hold a term of it.

        Scores are rounded to ``digits`` places before they are ranked; ties go to the smaller keys. A query without terms of its pool has no rows.
        """
        weights = self.weights(queries, query_keys)
        of_query = [*self.pool, *query_keys]
        blocks = self._of("blocks", weights).drop("bucket").join(weights, [*self.pool, "term"])
        bounds = kept(blocks.groupBy(*of_query, "block").agg(F.sum(F.col("idf") * F.col("most")).alias("bound"), F.max("rows").alias("rows")), "bounds")
        # A block holds at least as many passages with a term as its most frequent term has.
        before = F.coalesce(F.sum("rows").over(Window.partitionBy(*of_query).orderBy(F.desc("bound"), "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = kept(bounds.withColumn("first", before < AHEAD * k), "placed", [bounds])
        place = Window.partitionBy(*of_query).orderBy(F.desc("score"), *[c for c in self.keys if c not in self.pool])
        best = lambda rows: rows.withColumn("score", F.round("score", digits)).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
        begun = kept(best(self._scored(weights, placed.where("first").select(*of_query, "block"), query_keys)), "begun")
        least = begun.groupBy(*of_query).agg(F.min(F.when(F.col("rank") == k, F.col("score"))).alias("least"))
        rest = placed.where("not first").join(least, of_query, "left").where(F.col("least").isNull() | (F.col("bound") + SLACK + 10.0**-digits >= F.col("least")))
        return best(begun.drop("rank").unionByName(self._scored(weights, rest.select(*of_query, "block"), query_keys))).select(*self.keys, *query_keys, "score", "rank")


def build(docs: DataFrame, keys: list[str], pool: list[str], path: str, text: str = "text", buckets: int = BUCKETS, block: int = BLOCK) -> Index:
    """Writes the index of docs (keys, text) to path, which must not exist. keys tell passages apart; null texts have no tokens and length 1."""
    spark = docs.sparkSession
    rest = [c for c in keys if c not in pool]
    counted = kept(counted_words(docs, keys, text), "counted")
    counted.where("term = ''").select(*keys, F.greatest("len", F.lit(1)).cast("long").alias("len")).write.parquet(f"{path}/passages")
    out = Index(spark, path, keys, pool, buckets)
    told = out.passages
    sizes = told.groupBy(*pool) if pool else told.groupBy()
    sizes.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len")).where("n > 0").write.parquet(f"{path}/pools")
    # Passages of a pool by length: class 2 * log2(len), and as many blocks of each as they fill.
    kind = F.floor(2 * F.log2(F.col("len"))).cast("long")
    full = kept(told.groupBy(*pool, kind.alias("_class")).agg(F.ceil(F.count("*") / block).cast("long").alias("_parts")), "classes")
    placed = _joined(counted.where("term <> ''").withColumn("_class", kind), full, [*pool, "_class"])
    placed = placed.select(*keys, "term", "tf", "len", (F.col("_class") * (1 << 32) + F.pmod(F.xxhash64(*rest), F.col("_parts"))).alias("block"), _bucket(F.col("term"), buckets).alias("bucket"))
    ranged = placed.repartitionByRange("bucket", *pool, "term", "block", F.xxhash64(*rest)).sortWithinPartitions("bucket", *pool, "term", "block")
    ranged.write.partitionBy("bucket").parquet(f"{path}/postings")
    postings = _joined(out.part("postings"), out.part("pools").select(*pool, "avg_len"), pool)
    by_block = postings.groupBy("bucket", *pool, "term", "block").agg(F.count("*").alias("rows"), F.max(_share(F.col("avg_len"))).alias("most"))
    by_block.repartitionByRange("bucket", *pool, "term", "block").write.partitionBy("bucket").parquet(f"{path}/blocks")
    by_term = out.part("blocks").groupBy("bucket", *pool, "term").agg(F.sum("rows").alias("df"))
    by_term.repartitionByRange("bucket", *pool, "term").write.partitionBy("bucket").parquet(f"{path}/terms")
    delete(spark, counted._kept_path)
    return out


def _joined(rows: DataFrame, told: DataFrame, by: list[str]) -> DataFrame:
    """rows with the other columns of told, where null keys are keys too. By no key, told is one row."""
    if not by:
        return rows.crossJoin(F.broadcast(told))
    told = told.withColumnsRenamed({c: f"_of_{c}" for c in by})
    return rows.join(told, reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by))).drop(*(f"_of_{c}" for c in by))
