"""Words counted where texts are read: the tokens of word_rows(); an index is built with its postings shuffled once."""

import random

from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import index
from quillspark.sources.shared import new_folder


def test_counts_are_those_of_rows(spark, monkeypatch):
    monkeypatch.setattr(tx, "REMEMBERED", 50)
    monkeypatch.setattr(tx, "SENT", 40)
    rng = random.Random(5)
    ends = ["", "s", "es", "ies", "y", "ing", "ingly", "edly", "ed", "e", "xes", "sses", "ss", "us", "is", "nn", "nning", "zes", "'s", "-", "--", "'", "ll", "é", "İ", "K"]
    made = [rng.choice(["stud", "Y", "run", "-box", "a", "'li", "car", "the", "FREE", "9", "it", "日", "x" * 50]) + rng.choice(ends) for _ in range(1200)]
    rows = [(i, f"s{i % 3}", rng.choice([" ", ".", "\n", "_", "é", "\0"]).join(made[i : i + 25])) for i in range(0, 1175, 5)] + [(-1, None, None), (-2, "s", ""), (-3, "s", "the -- ' é")]
    docs = spark.createDataFrame(rows, "id int, source string, text string")
    for keep in (False, True):
        plain = tx.word_rows(docs, ["id", "source"], keep_stop=keep).groupBy("id", "source", "term").agg(F.count("*").alias("tf")).collect()
        got = tx.counted_words(docs, ["source", "id"], keep_stop=keep).select("id", "source", "term", "tf", "len").collect()
        assert sorted(tuple(r)[:4] for r in got if r["term"]) == sorted(map(tuple, plain))
        assert sorted(r["id"] for r in got if not r["term"]) == sorted(r[0] for r in rows)
        length = {}
        for r in plain:
            length[r["id"]] = length.get(r["id"], 0) + r["tf"]
        assert all(r["len"] == length.get(r["id"], 0) for r in got)
    long = tx.counted_words(docs, ["id"], name="word", only=lambda t: len(t) > 9)
    assert {(r["id"], r["len"]) for r in tx.counted_words(docs, ["id"], keep_stop=True, least=20).collect()} == {(i, n) for i, n in length.items() if n >= 20}
    assert {r["word"] for r in long.collect()} - {""} == {r["term"] for r in tx.word_rows(docs, ["id"]).where(F.length("term") > 9).collect()}


def test_texts_are_read_once_and_null_pools_are_pools(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(t):
        read.add(1)
        return t

    docs = spark.createDataFrame([(i, [None, "a"][i % 2], f"license w{i} license") for i in range(40)], "id long, pool string, text string").withColumn("text", counted(F.col("text")))
    made = index.build(docs, ["pool", "id"], ["pool"], new_folder(spark, "index"), buckets=4, block=4)
    assert read.value == 40
    assert {(r["pool"], r["df"]) for r in made.frequencies.where("term = 'licens'").collect()} == {(None, 20), ("a", 20)}
    assert made.counts.where("term = 'licens' and tf = 2").count() == 40


def test_many_terms_asked_for_meet_postings_before_blocks_do(spark, monkeypatch):
    monkeypatch.setattr(index, "NAMED", 2)
    docs = spark.createDataFrame([(i, "p", f"license vaccine w{i} quantum") for i in range(60)], "id long, pool string, text string")
    made = index.build(docs, ["pool", "id"], ["pool"], new_folder(spark, "index"), buckets=1, block=4)
    asked = spark.createDataFrame([("p", "licens"), ("p", "w3"), ("p", "w4"), ("q", "w5")], "pool string, term string")
    assert sorted(r["term"] for r in made._of("postings", asked).where("term <> 'licens'").collect()) == ["w3", "w4"]
