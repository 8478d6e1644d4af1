"""Kernels, solvers and scores of the string-kernel classifiers against plain versions, and their independence of neighbouring rows."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import language_id, near_duplicates, token_files, toxicity
from quillspark.llm._sample import balanced


def grams(text):
    s = [c.lower() if c.isalpha() else "" for c in text]
    return {tuple(s[i : i + n]) for n in (1, 2, 3) for i in range(len(s) - n + 1)}


def test_presence_kernel():
    """Of one window and of several, with the last window's n-grams reaching to the text's end and those of others into the next window."""
    rng = random.Random(1)
    marks = ["".join(rng.choice("abcé üß1.") for _ in range(200)) for _ in range(5)]
    texts = ["".join(rng.choice("abcdé üß1.") for _ in range(n)) for n in (1, 30, 999, 1000, 2500)] + ["", "12"]
    model = language_id.landmarks(marks)
    got, letters = language_id.kernels(model, texts)
    for text, row, n in zip(texts, got, letters):
        whole, want, total = text + "\n", np.zeros(5), 0
        for at in range(0, len(whole), 1000):
            part, own = whole[at : at + 1000], sum(c.isalpha() for c in whole[at : at + 1000])
            held = {g for g in grams(whole[at : at + 1002]) if any(tuple(c.lower() if c.isalpha() else "" for c in whole[at + i : at + i + len(g)]) == g for i in range(len(part)))}
            want += own * np.array([len(held & grams(m + "\n")) / (len(held) * len(grams(m + "\n"))) ** 0.5 for m in marks])
            total += own
        assert n == total and np.allclose(row, want / max(total, 1), atol=2e-6)


def test_ridge():
    """In the space of the landmarks' span, against ridge regression on explicit features."""
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abcd " if k % 2 else "cdef "), 60)) for k in range(40)]
    labels = ["x" if k % 2 else "y" for k in range(40)]
    model = language_id.landmarks(texts[:12])
    rows, _ = language_id.kernels(model, texts)
    solved = language_id.solve(model, rows, labels)
    k_mm = (model.landmarks.T @ model.landmarks).astype(float) / np.outer(model.size, model.size)
    z = np.column_stack((rows @ np.linalg.inv(np.linalg.cholesky(k_mm)).T, np.ones(40)))
    y = np.where(np.array(labels) == "x", 1.0, -1.0) / 1
    w = np.linalg.solve(z.T @ z / 20 + language_id.RIDGE * np.eye(z.shape[1]), z.T @ y / 20)
    decision = rows @ (solved.weights * 2.0**-solved.bits) + solved.bias
    assert solved.languages == ["x", "y"] and np.allclose(decision[:, 0], z @ w, atol=1e-4)


def test_language_of_odd_texts(spark):
    rows = [(i, "the rain in spain " * 3, "en") for i in range(40)] + [(100 + i, "la pluie en été " * 3, "fr") for i in range(40)]
    odd = [(1000, "\U0001F600\U0001F600", "en"), (1001, "\U00010400\U00010401", "en"), (1002, "12!", None), (1003, "the", None), (1004, "the rain " * 150_000, None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit(0))
    got = {r["doc_id"]: r for r in language_id.languages(docs).collect()}
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und", got[1001]["lang_pred"], "und"] and got[1001]["lang_pred"] != "und"
    assert got[1000]["score"] == 0 and got[1004]["lang_pred"] == "en" and got[3]["score"] == got[5]["score"]
    kept = language_id.recognised(docs)
    assert kept.columns == docs.columns and {1000, 1002} & {r["doc_id"] for r in kept.collect()} == set()


def test_scores_of_a_row_alone(spark):
    """Alone, in one batch, and over seven partitions: equal to the last bit."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model, machine = language_id.fitted(docs), toxicity.fitted(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels)
    texts = [r["text"] or "" for r in docs.orderBy("doc_id").collect()] + ["the", "zz", "éé", "i d i", "o t x", "x y", "z w", ""]
    together, alone = language_id.decide(model, texts), [language_id.decide(model, [t]) for t in texts]
    assert together[0] == [a[0][0] for a in alone] and together[1].tolist() == [a[1][0] for a in alone]
    assert toxicity.Scorer(machine)(texts).tolist() == [toxicity.Scorer(machine)([t])[0] for t in texts]
    one, seven = ({r["doc_id"]: r["score"] for r in language_id.predicted(d, model).collect()} for d in (docs.coalesce(1), docs.repartition(7)))
    assert one == seven


def plain_kernel(a, b):
    """Of two words, by all subsequences of three letters that span SPAN + 1 places at most."""

    def features(w):
        w, out = "\1" + w + "\2", {}
        for i, j, k in itertools.combinations(range(len(w)), 3):
            if k - i <= toxicity.SPAN:
                out[w[i] + w[j] + w[k]] = out.get(w[i] + w[j] + w[k], 0) + toxicity.DECAY ** (k - i - 2)
        return out

    x, y = features(a), features(b)
    dot = lambda p, q: sum(v * q.get(k, 0) for k, v in p.items())
    return (dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5) ** toxicity.POWER


def test_subsequence_kernel():
    words = "idiot id1ot idxiot idot moron banana a ab xyz idiotidiot".replace("1", "i").split()
    got = toxicity.kernels(words, *toxicity._landmark_table(["idiot", "moron", "ab"]))
    assert np.allclose(got, [[plain_kernel(w, m) for m in ("idiot", "moron", "ab")] for w in words], atol=1e-5)


def test_spelt_words_end_with_their_text():
    assert [w for _, w in toxicity.Sentences(["x y", "z w", "a i d i o t b", "q r s"]).spelled] == ["aidiotb", "qrs"]
    assert toxicity.vocabulary(["i d i", "o t x and", ""]) == [["d", "i", "idi"], ["and", "o", "otx", "t", "x"], []]


def test_toxicity_of_odd_rows(spark):
    rng = random.Random(3)
    clean = "th er in on an re at st nd".split()
    texts = [" ".join("".join(rng.choice(clean) for _ in range(3)) for _ in range(20)) for _ in range(120)]
    texts = [t + " scumbag here." if i % 3 == 0 else t for i, t in enumerate(texts)]
    long = " ".join(texts[1:60:3]) * 40 + " scumbag"
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (500, None), (501, ""), (502, long), (None, "scumbag")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("toxic", F.lit(9))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) and len({r["score"] for r in got if r["doc_id"] == 7}) == 1
    by = {r["doc_id"]: r for r in got}
    assert by[500]["score"] == by[501]["score"] and not by[501]["predicted"] and by[None]["held_out"] and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0 and toxicity.toxicity(docs, labels.limit(0)).count() == len(rows)


def test_balanced(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "if(id < 2990, 'a', 'b') AS lang")
    got = balanced(rows, "lang", 50).toPandas()
    assert got.groupby("lang").size().to_dict() == {"a": 50, "b": 10} and sorted(got[got.lang == "a"].place) == list(range(1, 51))
    assert balanced(rows.limit(0), "lang", 50).count() == 0


def test_codes_keep_their_limit():
    rng = np.random.default_rng(0)
    for n in (40_000, 65_536):
        lengths = token_files.code_lengths(rng.integers(1, 10**6, n))
        ids = rng.integers(0, n, 3000)
        steps, bits = token_files.pack(ids, lengths, token_files.canonical(lengths))
        assert lengths.max() == 16 and (token_files.unpack(steps, bits, 3000, token_files.decoding_table(lengths)) == ids).all()


def test_near_duplicates_of_hot_shingles(spark):
    """With every shared shingle treated as a hot one: many salts, the same classes as brute force."""
    rng = random.Random(8)
    pools = [[f"w{p}_{k}" for k in range(40)] for p in range(6)]
    rows = []
    for i in range(160):
        words = list(pools[i % 6])
        for _ in range(rng.choice([0, 0, 1, 2, 9])):
            words[rng.randrange(40)] = f"x{rng.randrange(30)}"
        rows.append((i, " ".join(words)))
    rows += [(500 + i, "") for i in range(20)] + [(600, None), (601, "a b"), (602, "A  b"), (603, "a b c")]
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, j in itertools.combinations(sets, 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates.classes(spark.createDataFrame(rows, "doc_id long, text string"), hot_level=2, salt_level=1).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}


