"""Each corpus operator against a brute-force version, a round trip or held-out labels, on small fixtures with odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import decontamination, html_text, language_id, mixing, near_duplicates, nearest, personal_data, suffix_tree, token_files, toxicity

DOCS = "doc_id long, text string, lang string, source string"
ODD = [(900, None, None, None), (901, "", "en", "s1"), (902, "  \n", "en", "s1"), (903, "12 34 !!", "en", None), (904, "\U0001F600 日本 é" + " ab cd" * 6000, "en", "s1"), (905, "same words here again and again", "en", "s2"), (905, "same words here again and again", "en", "s2")]


def made(seed=1, n=120):
    rng = random.Random(seed)
    parts = {"en": "the er in on th an re at st".split(), "fr": "ré eau que ment ou ai elle les".split()}
    rows = []
    for i in range(n):
        lang = "en" if i % 3 else "fr"
        words = ["".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(8, 90))]
        if i % 5 == 0 and i and rows[-1][1]:
            words, lang = rows[-1][1].split(), rows[-1][2]
            if len(words) > 40:
                words[3] = "changed"
        rows.append((i, " ".join(words), lang, f"s{i % 4}"))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made() + ODD, DOCS).withColumn("score", F.lit("clash")).withColumn("tokens", F.lit(1))


def texts(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))


def test_language(spark, docs):
    got = language_id.languages(docs).collect()
    assert len(got) == docs.count()
    lang = {r["doc_id"]: r["lang_pred"] for r in got}
    assert lang[900] == lang[901] == lang[902] == lang[903] == "und"
    assert np.mean([lang[i] == l for i, _, l, _ in made()]) > 0.95
    assert language_id.recognised(docs).columns == docs.columns
    assert language_id.languages(docs.limit(0)).count() == 0


def test_near_duplicates(spark, docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates.classes(docs).collect()}
    sets = {}
    for i, t in texts(docs):
        w = split(t)
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    assert near_duplicates.classes(docs.limit(0)).count() == 0


def test_near_duplicates_without_an_id(spark):
    rows = [(None, "a b c d e f"), (None, "short"), (None, None), (None, ""), (1, "a b c d e f")]
    got = near_duplicates.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in got) == [(0, 0, 0), (0, 0, 0), (0, 1, 0), (0, 2, 0), (1, 2, 1)]


def test_near_duplicate_group_of_many(spark):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    rows = [(i, " ".join(w if rng.random() > 0.004 else f"x{i}_{k}" for k, w in enumerate(base))) for i in range(150)]
    got = near_duplicates.classes(spark.createDataFrame(rows, "doc_id long, text string")).select("component_id").distinct().count()
    assert got < 30


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.TOKENIZER)
    at = 0
    want = []
    for i, x in sorted(texts(docs)):
        ids = t.encode(x, add_special_tokens=False).ids + [1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_files.digests(docs).collect()), key=lambda r: r[1]) == want
    assert token_files.digests(docs.limit(0)).count() == 0


def test_encoder_is_the_tokenizer():
    rng = random.Random(3)
    e = token_files.Encoder(token_files.TOKENIZER, None)
    assert e.by_piece
    odd = ["it's don't WE'LL 'tis 'Re x\xb2y a\x85b\xa0c \x1c\x1d _a_b \xc0\xc9\xdf\xf7\xd7 \xaa \xba \xb5", "\u0130stanbul \ufb01 e\u0301 <|endoftext|> a", "a" * 3000 + "  \n\t!!'s's", "''s ''ll 'lll '", "\0\x01 \x7f \x9f \xad", ""]
    odd += ["".join(chr(rng.choice([rng.randrange(256), rng.randrange(32, 127), 39, 115])) for _ in range(150)) for _ in range(150)]
    odd += ["".join(chr(rng.choice([rng.randrange(0x3000), rng.randrange(32, 127)])) for _ in range(80)) for _ in range(60)]
    for _ in range(2):  # learned, then remembered
        for text, got in zip(odd, e(odd)):
            assert np.frombuffer(got, e.type).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_code_is_length_limited():
    counts = np.array([2**min(k, 50) for k in range(40)] + [0])
    lengths = token_files.code_lengths(counts)
    assert lengths.max() <= 16 and lengths[-1] == 0 and abs(sum(2.0 ** -lengths[lengths > 0]) - 1) < 1e-9
    ids = np.random.default_rng(0).integers(0, 40, 5000)
    steps, bits = token_files.pack(ids, lengths, token_files.canonical(lengths))
    assert (token_files.unpack(steps, bits, 5000, token_files.decoding_table(lengths)) == ids).all()


def test_suffix_tree(spark, docs):
    got = suffix_tree.scores(docs).collect()
    count = Counter()
    for i, t in texts(docs):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(split(t))
            count[None] += 1
    n, v = sum(count.values()), len(count)
    want = {}
    for i, t in texts(docs):
        w = split(t) + [None]
        want[i] = (len(w), sum(count[x] > 0 for x in w), sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w))
    assert len(got) == docs.count()
    for r in got:
        k = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (k[0], k[1], n) and abs(r["base_score"] - k[2]) < 1e-6 * abs(k[2]) and r["score"] < 0


def test_suffix_tree_keeps_all_states_and_letters(spark):
    """Against dictionaries: more contexts earn a place than 24,000, and there are more letters than symbols."""
    rng = random.Random(4)
    words = ["".join(chr(0x4E00 + rng.randrange(300)) for _ in range(6)) for _ in range(4000)]
    pool = words * 12
    rng.shuffle(pool)
    data = [(i, " ".join(pool[i * 200 : i * 200 + 200])) for i in range(len(pool) // 200)] + [(900, "a\U0001F600b"), (901, "a\U0001F601b"), (902, "")]
    got = {r["doc_id"]: r["score"] for r in suffix_tree.scores(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    train = [t for i, t in data if zlib.crc32(str(i).encode()) % 7 != 2]
    often = Counter(c for t in train for c in t if c != " ")
    own = dict(zip(sorted(sorted(often, key=lambda c: (-often[c], c))[:136]), range(1000)))

    def symbols(t):
        out = []
        for c in t:
            u = c.encode() if ord(c) > 127 else bytes([0xC0 | ord(c) >> 6, 0x80 | ord(c) & 63])
            out += [c] if c == " " or c in own else [("lead", u[0])] + [("tail", b) for b in u[1:]]
        return ["^"] * 5 + out + ["$"]

    n, of, kinds = Counter(), Counter(), Counter()
    for t in train:
        s = symbols(t)
        for k in range(5, len(s)):
            n.update((tuple(s[k - d : k]), s[k]) for d in range(6))
    for (c, _), k in n.items():
        of[c] += k
        kinds[c] += 1
    gain = Counter()
    for (c, x), k in n.items():
        if c:
            gain[c] += k * math.log(k / of[c] / (n[c[1:], x] / of[c[1:]]))
    states = {c for c in gain if gain[c] > kinds[c] * 0.5 * math.log(of[()] + 1)}
    assert len(states) > 24_000
    states = {c[a:b] for c in states for a in range(len(c)) for b in range(a + 1, len(c) + 1)}
    for i, t in data[:40] + data[-3:]:
        s, want = symbols(t), 0.0
        for k in range(5, len(s)):
            p = (n[(), s[k]] + 0.5) / (of[()] + 0.5 * (119 + len(own)))
            for d in range(1, 6):
                c = tuple(s[k - d : k])
                p = (n[c, s[k]] + 2 * p) / (of[c] + 2) if c in states else p
            want += math.log10(p)
        assert abs(got[i] - want) < 1e-6 * abs(want), i


def test_toxicity(spark):
    rng = random.Random(2)
    syllables = "th er in on an re at st nd".split()
    rows, labels = [], []
    for i in range(300):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(10, 60))]
        if i % 4 == 0:
            words[rng.randrange(len(words))] = rng.choice(["idiot", "scum", "moron"])
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, int(i % 4 == 0)))
    d = spark.createDataFrame(rows + ODD, DOCS)
    got = toxicity.toxicity(d, spark.createDataFrame(labels + [(900, None), (None, 1)], "doc_id long, toxic int")).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 300]
    assert len(got) == d.count() and np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    none = toxicity.toxicity(d, spark.createDataFrame([], "doc_id long, toxic int")).agg(F.max("score")).first()[0]
    assert none == 0


def test_personal_data(spark, docs):
    import hashlib

    odd = ["a@b.c_d@e.f a@b é x@y.zz 1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4 +1 (555) 555-1234) +123 4111 1111 1111 1111", "9" * 3000 + " " + "1." * 2000 + "a@" * 2000 + "+1 " * 500, "call (555) 555-1234 or x (at) y.com"]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(odd, 5000)), "doc_id long, text string"))
    got = {r["doc_id"]: r for r in personal_data.personal_data(d).collect()}
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 12 <= len(digits) <= 19 and sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, digits[::-1]))) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    for i, t in texts(d):
        spans = sorted((m.start(), n, m.end(), k) for n, (k, p) in enumerate(plain.items()) for m in re.finditer(p, t) if good(k, m.group()))
        joined = ",".join(f"{k}:{a}:{e}" for a, _, e, k in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(got[i]["spans"].split(","))


def test_addresses_with_leading_zeros(spark):
    """Parts are bounded by their value alone; no rows and clashing columns are nothing special."""
    odd = ["0" * 27 + "1.2.3.4", "0" * 52 + ".0.0.0", "01.2.3.4", "00256.1.1.1", "1.2.3." + "0" * 400 + "255", "1.2.3." + "0" * 400 + "256", "1.02.3.4444"]
    d = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("kind", "start", "end", "base", "spans", "n_ip", "m", "votes")})
    got = {r["doc_id"]: (r["n_ip"], r["spans"].split(",")[0]) for r in personal_data.personal_data(d).collect()}
    assert [got[i][0] for i in range(len(odd))] == [1, 1, 1, 0, 1, 0, 0]
    assert got[0][1] == f"ip:0:{len(odd[0])}" and got[4][1] == f"ip:0:{len(odd[4])}"
    assert personal_data.personal_data(d.limit(0)).count() == 0


def test_decontamination(spark, docs):
    q = "A train leaves Boston at 5 pm with 120 passengers and travels 300 km to Chicago while John eats 5 apples on the way home."
    b = spark.createDataFrame([(1, q), (2, None), (3, "short one here now")], "item_id long, text string")
    changed = q.replace("Boston", "Paris").replace("120", "77").replace(" 5 ", " 9 ")
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(5000, "xx " + q), (5001, changed), (5002, q.replace("5 apples", "6 apples")), (5003, "and SHORT one, here now! x")], "doc_id long, text string"))
    got = {r["doc_id"]: r["items"] for r in decontamination.contamination(d, b).collect() if r["contaminated"]}
    assert got == {5000: "1", 5001: "1", 5003: "3"}
    assert decontamination.contamination(d, b.limit(0)).where("contaminated").count() == 0


def test_mixing(spark, docs):
    got = mixing.selection(docs.drop("tokens"), ratio=1.3).collect()
    leaf = lambda r: (r["domain"], r["lang"] or "none", r["source"] or "none")
    have, taken = Counter(), Counter()
    for r in got:
        have[leaf(r)] += r["n_tokens"]
        taken[leaf(r)] += r["tokens"]
    want = mixing.budgets(have, round(1.3 * sum(have.values())), {})
    assert len(got) == docs.count() and {k: v for k, v in want.items() if v} == {k: v for k, v in taken.items() if v}
    assert sum(taken.values()) == round(1.3 * sum(have.values()))
    assert mixing.budgets({("a", "x", "1"): 10, ("a", "x", "2"): 100, ("b", "y", "3"): 100}, 120, {("a",): 1, ("b",): 1, ("a", "x", "1"): 9, ("a", "x", "2"): 1}, 1) == {("a", "x", "1"): 10, ("a", "x", "2"): 50, ("b", "y", "3"): 60}
    assert mixing.mixed(docs).columns == docs.columns


def test_html(spark):
    page = '<html><body><div id="cookie-notice">We</div><header><h1>Site</h1></header><div class="menu"><ul><li>a</ul></div><main><header><h1>T &amp; U</h1></header><p>One <b>two<i> three</b> x<p>Four<ul><li>i1<li>i2</ul><section class="comments"><p>nice!</p></section><aside>x</aside></main><footer>f</footer><script>"<p>no</p>"'
    assert html_text.extract(page) == "T & U\nOne two three x\nFour\ni1\ni2"
    rows = [(i, f"http://h.example/{i}", f"<body><div><p>Every page says this</p></div><div><p>Text number {i}</p></div></body>") for i in range(12)] + [(99, None, None), (98, "bad", "")]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Text number 3" and got[99] == got[98] == ""


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16))
    x[100:160] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.nearest(d, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    found = []
    for i in range(0, 600, 20):
        score = x @ x[i]
        score[i] = -np.inf
        best = np.lexsort((np.arange(600), -score))[:20]
        found.append(len(set(best) & set(got[i])) / 20)
    assert len(got) == 30 and np.mean(found) >= 0.9 and all(len(v) == 20 for v in got.values())
    assert nearest.nearest(d.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "duplicates", "benchmark", "mixture", "tokens"]
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 50
