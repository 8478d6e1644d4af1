"""Of a text, term_hits takes only the words that can have a term's stem; which these are goes by ASCII letters and by where TOKEN begins."""

import random
import time

from pyspark.sql import functions as F

from quillspark.functions import text as tx


def plain(terms, text):
    found = tx.tokens(text, keep_stop=True)
    return F.size(F.filter(tx.stem_all(F.transform(terms, F.lower)), lambda t: F.array_contains(found, t)))


def test_words_begin_where_tokens_do(spark):
    rng = random.Random(5)
    signs = ["-", "'", "--'", " ", ".", "\n", "", "K", "ſ", "é", "ı", "\U0001f600", "|", "\\", "_"]
    parts = ["mit", "MIT", "flies", "fly", "xyies", "xyy", "xxyyies", "ties", "sses", "Studies", "study", "stud", "y", "a", "it's", "re-running", "run", "kit", "sit", "9s", "ab-ing"]
    odd = ["", None, "-mit", "'fly", "a.*", "mit|fly", "(", "[y]", "\\E", "mit\n", "Kit", "\u212ait", "\u017fit", "y", "ab-", "9s", "\u00e9"]
    rows = [("".join(rng.choice(signs) + rng.choice(parts) + rng.choice(signs) for _ in range(5)), rng.sample(odd + parts, i % 6)) for i in range(900)]
    rows += [("-" * 3000 + "mit", ["mit"]), ("'-'-a-mit", ["mit"]), ("'mit", ["mit"]), ("mit" * 3000, ["mit"]), ("flies", ["fly", "fly", "flies"]), (None, ["a"]), ("x", []), ("x", None)]
    rows = [(*r, None if r[1] is None or i % 3 else r[1]) for i, r in enumerate(rows)]
    got = spark.createDataFrame(rows, "text string, terms array<string>, others array<string>").select(
        *(f(F.col(c), F.col("text")).alias(f"{c}{i}") for c in ("terms", "others") for i, f in enumerate((plain, tx.term_hits)))).collect()
    assert [r["terms1"] for r in got] == [r["terms0"] for r in got] and [r["others1"] for r in got] == [r["others0"] for r in got]
    assert sum(r["terms0"] or 0 for r in got) > 300 and [r["terms1"] for r in got[-8:]] == [1, 0, 1, 0, 3, 0, 0, None]


def test_other_words_are_not_taken_from_the_text(spark):
    """Listing all words was a part of meeting terms before, which took 2.6 times as long as that alone."""
    docs = spark.range(0, 300, 1, 1).select(F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(4000)), lambda i: F.concat(F.lit("w"), F.conv((i * (F.col("id") + 7)).cast("string"), 10, 36)))).alias("text")).persist()
    docs.count()
    terms = F.array(*map(F.lit, ["license", "released", "mit", "apache"]))

    def took(c):
        began = time.time()
        docs.select(c.alias("n")).agg(F.sum("n")).collect()
        return time.time() - began

    times = [(took(tx.term_hits(terms, F.col("text"))), took(F.size(tx.words(F.col("text"), keep_stop=True)))) for _ in range(4)]
    assert min(t[0] for t in times) < 1.4 * min(t[1] for t in times), times
    docs.unpersist()
