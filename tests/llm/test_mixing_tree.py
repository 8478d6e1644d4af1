"""Budgets dealt in Spark against the plain version, cuts in leaves of every size, repeated and odd rows, clashing columns."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.llm import mixing
from quillspark.llm._scan import running

COLUMNS = "doc_id long, text string, lang string, source string, domain string"


def made(seed, n):
    rng = random.Random(seed)
    return [(i, " ".join("w" for _ in range(rng.choice([0, 1, 3, 20, 200]))), rng.choice(["en", "fr", "de", None]), f"s{rng.randrange(12)}", rng.choice(["web", "web", "web", "book", "code"])) for i in range(n)]


def leaf(r):
    return (r["domain"], r["lang"] or "none", r["source"] or "none")


@pytest.mark.parametrize("ratio, weights, epochs", [(0.6, {}, 4), (1.7, {("web",): 1.0, ("book",): 5.0, ("code",): 0.0, ("web", "fr"): 3.0, ("web", "en", "s1"): 9.0}, 2), (9.0, {("code",): 1.0}, 3)])
def test_budgets(spark, ratio, weights, epochs):
    rows = made(1, 400) + [(900, None, None, None, None), (901, "", "en", "s1", "web")] + [(950, "same text here", "en", "s3", "web")] * 30
    docs = spark.createDataFrame(rows, COLUMNS).withColumn("tokens", F.lit("clash")).withColumn("n_tokens", F.lit("clash")).withColumn("h", F.lit(1))
    out = mixing.selection(docs, ratio, weights, epochs)
    assert len(set(out.columns)) == len(out.columns)
    got = out.collect()
    have, taken = Counter(), Counter()
    for r in got:
        have[leaf(r)] += r["n_tokens"]
        taken[leaf(r)] += r["tokens"]
        assert r["tokens"] <= epochs * r["n_tokens"] and (not r["n_tokens"] or r["epochs"] == -(-r["tokens"] // r["n_tokens"]))
    want = mixing.budgets(have, round(ratio * sum(have.values())), weights, epochs)
    assert len(got) == len(rows) and {k: v for k, v in want.items() if v} == {k: v for k, v in taken.items() if v}
    # Of each leaf one document at most is taken in part.
    part = Counter(leaf(r) for r in got if r["n_tokens"] and r["tokens"] % r["n_tokens"])
    assert max(part.values(), default=0) <= 1
    if not weights:
        mixed = mixing.mixed(docs, ratio=ratio, weights=weights, epochs=epochs)
        assert mixed.columns == docs.columns and mixed.count() == sum(r["epochs"] for r in got)


def test_prefix_follows_the_hash(spark):
    """In a leaf every document before the cut has one epoch more than those after it, in the order of the seeded hash."""
    docs = spark.createDataFrame([(i, "a b c", "en", "s1") for i in range(500)], "doc_id long, text string, lang string, source string")
    got = mixing.selection(docs, 1.5).withColumn("h", mixing._hash(F.lit(mixing.SEED), F.lit(1).cast("long"), F.col("doc_id"))).orderBy("h").collect()
    assert [r["tokens"] for r in got] == [6] * 250 + [3] * 250 and {r["domain"] for r in got} == {"s"}
    other = mixing.selection(docs, 1.5, seed=3).collect()
    assert {r["doc_id"] for r in other if r["epochs"] == 2} != {r["doc_id"] for r in got if r["epochs"] == 2}
    assert mixing.selection(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


def test_running(spark):
    rng = random.Random(5)
    rows = [(rng.choice("aaaaab"), rng.randrange(1000), i, rng.randrange(50)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "g string, k int, i int, n int")
    got, same = ({r["i"]: r["before"] for r in running(frame, ["g"], [F.desc("k"), F.col("i")], small, before="n").collect()} for small in (0, 5000))
    want, at = {}, Counter()
    for g, _, i, n in sorted(rows, key=lambda r: (-r[1], r[2])):
        want[i] = at[g]
        at[g] += n
    assert got == same == want


@pytest.mark.parametrize("ratio, weights, epochs", [(0.6, {}, 4), (1.7, {("web",): 1.0, ("book",): 5.0, ("code",): 0.0, ("web", "fr"): 3.0, ("web", "en", "s1"): 9.0}, 2), (9.0, {("code",): 1.0}, 3)])
def test_budgets_of_many_leaves(spark, monkeypatch, ratio, weights, epochs):
    """The same for trees that are too large for the driver."""
    monkeypatch.setattr(mixing, "TREE", 0)
    test_budgets(spark, ratio, weights, epochs)
