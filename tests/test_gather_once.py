"""Gathering reads each text twice at most: once for filters and ranks, once if it is chosen; terms are met by the words that can have their stems."""

import random

from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.plans import briefing


def test_texts_are_read_twice_at_most(spark):
    docs = spark.createDataFrame([(i, f"title {i % 30}\nsome words of an MIT license {i}", f"src{i % 3}") for i in range(60)] + [(60, "xxx and porn\nwords", "src0")], "doc_id bigint, text string, source string")
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(t):
        read.add(1)
        return t

    sources = briefing.document_sources(docs).withColumn("text", counted(F.col("text")))
    topics = spark.createDataFrame([(0, "mit license", ["mit", "license"])], "topic_id bigint, topic string, terms array<string>").repartition(4)
    got = briefing.gather(sources, topics, 2025)
    rows = got.select("id", "ord", "kind", "place").orderBy("id").collect()
    assert read.value <= 2 * docs.count()
    assert got.columns == [*sources.columns, "relevance", "rank", "place", "id"]
    assert [r["id"] for r in rows] == list(range(1, len(rows) + 1)) and 60 not in {r["ord"] for r in rows}
    assert {r["kind"] for r in rows} == {"encyclopedia", "web", "academic", "news"}, rows


def test_rows_of_one_order_stay_apart(spark):
    docs = spark.createDataFrame([(1, "a\nlicense", "s0"), (1, "b\nlicense", "s1"), (1, "b\nlicense", "s1"), (None, "c\nlicense", "s1")], "doc_id bigint, text string, source string")
    topics = spark.createDataFrame([(0, "license", ["license"])], "topic_id bigint, topic string, terms array<string>")
    sources = briefing.document_sources(docs).withColumn("kind", F.lit("academic"))
    assert sorted(r["title"] for r in briefing.gather(sources, topics.withColumn("terms", F.array().cast("array<string>")), 2025).collect()) == ["a", "b", "b", "c"]


def test_term_hits_of_all_endings(spark):
    rng = random.Random(3)
    ends = ["", "s", "es", "ies", "y", "ing", "ingly", "edly", "ed", "e", "xes", "sses", "ss", "us", "nn", "nning", "yies", "'s"]
    made = [rng.choice(["stud", "y", "run", "box", "a", "li", "car", "pass", "free"]) + rng.choice(ends) for _ in range(600)]
    rows = [(" ".join(made[i : i + 6]), made[i + 6 : i + 9] + ["", None, "Study"][: i % 4]) for i in range(0, 590, 3)] + [(None, ["a"]), ("x", []), ("studies", None)]
    found = tx.tokens(F.col("text"), keep_stop=True)
    plain = F.size(F.filter(tx.stem_all(F.transform("terms", F.lower)), lambda t: F.array_contains(found, t)))
    got = spark.createDataFrame(rows, "text string, terms array<string>").select(plain.alias("want"), tx.term_hits(F.col("terms"), F.col("text")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got] and sum(r["got"] or 0 for r in got) > 20
