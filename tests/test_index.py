"""The kept index against scoring everything; what a search reads; odd texts and pools."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import index, ranking
from quillspark.sources.shared import new_folder

WORDS = "license vaccine quantum river bread immune cell protein market engine".split()


def made(seed=4, n=240):
    rng = random.Random(seed)
    rows = [(f"p{i % 3}" if i % 7 else "hot", i, " ".join(rng.choices(WORDS, range(1, 11), k=rng.choice([3, 8, 40, 160])))) for i in range(n)]
    return rows + [("hot", 900 + i, "bread river bread") for i in range(30)] + [("p0", 950, None), ("p0", 951, ""), ("lone", 952, "of the and"), ("odd", 953, "é 日本"), ("p1", 954, "engine " * 20_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(), "pool string, id long, text string").withColumns({"len": F.lit("clash"), "score": F.lit(1)})


@pytest.fixture(scope="module")
def built(spark, docs):
    return index.build(docs, ["pool", "id"], ["pool"], new_folder(spark, "index"), buckets=8, block=4)


def everything(docs, queries, pool, k):
    """All scores by the plain operator, ranked."""
    rows = ranking.bm25(docs, queries, [*pool, "id"], pool, ["q"]).select("q", *pool, "id", F.round("score", 6).alias("score")).collect()
    out = []
    for q in {(r["q"], *(r[c] for c in pool)) for r in rows}:
        mine = sorted((-r["score"], r["id"]) for r in rows if (r["q"], *(r[c] for c in pool)) == q)[:k]
        out += [(*q, i, -s, n + 1) for n, (s, i) in enumerate(mine)]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_search(spark, docs, built, k):
    queries = spark.createDataFrame([(q, p, t) for q, t in enumerate(["bread", "license market engine", "nothing here", "", "cell proteins bread quantum river"]) for p in ("p0", "p1", "hot", "lone", "gone")], "q int, pool string, query string")
    got = built.search(queries, ["q"], k).select("q", "pool", "id", "score", "rank").collect()
    assert sorted(map(tuple, got)) == everything(docs, queries, ["pool"], k)


def test_search_without_pools(spark, docs):
    one = index.build(docs, ["id"], [], new_folder(spark, "index"), buckets=3, block=16)
    queries = spark.createDataFrame([(0, "bread river"), (1, "license")], "q int, query string")
    assert sorted(map(tuple, one.search(queries, ["q"], 12).select("q", "id", "score", "rank").collect())) == everything(docs, queries, [], 12)


def test_parts(docs, built):
    plain = ranking.term_counts(docs, ["pool", "id"])
    both = lambda frame: sorted(map(tuple, frame.collect()))
    assert both(built.counts) == both(plain.select("pool", "id", "term", "tf"))
    assert both(built.frequencies.select("pool", "term", "df")) == both(plain.groupBy("pool", "term").agg(F.count("*")))
    assert built.passages.count() == docs.count() and built.passages.agg(F.min("len")).first()[0] == 1


def test_empty(spark, docs):
    none = index.build(docs.limit(0), ["pool", "id"], ["pool"], new_folder(spark, "index"))
    assert none.search(spark.createDataFrame([(0, "p0", "bread")], "q int, pool string, query string"), ["q"], 3).count() == 0


def test_a_search_reads_its_buckets_only(spark, built):
    asked = spark.createDataFrame([("p0", "bread")], "pool string, term string")
    rows = built._of("postings", asked)
    files = [r[0] for r in rows.select(F.input_file_name()).distinct().collect()]
    assert files and {re.search(r"bucket=(\d+)", f)[1] for f in files} == {str(spark.range(1).select(index._bucket(F.lit("bread"), 8)).first()[0])}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(term), EqualTo(term,bread)" in plan


def test_blocks_of_low_bound_are_not_scored(spark, docs, built, monkeypatch):
    scored = []
    whole = index.Index._scored
    monkeypatch.setattr(index.Index, "_scored", lambda self, w, chosen, q: scored.append(chosen.count()) or whole(self, w, chosen, q))
    queries = spark.createDataFrame([(0, "hot", "bread")], "q int, pool string, query string")
    got = built.search(queries, ["q"], 3).collect()
    assert len(got) == 3 and sum(scored) < built.part("blocks").where("pool = 'hot' and term = 'bread'").count()
