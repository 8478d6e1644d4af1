"""The audit against plain dictionaries with exact integers."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.llm import divergence

DOCS = "doc_id long, text string, lang string, source string"


def plain(rows, most):
    lower = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    count, docs, groups = Counter(), Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        groups.add((lang, source))
        count.update((lang, source, t) for t in found)
        docs.update((lang, t) for t in set(found))
    out = []
    for lang in {x for x, _ in groups}:
        kept = sorted(t for (x, t), n in docs.items() if x == lang and n >= 3)
        sources = [s for x, s in groups if x == lang]
        n = {s: {t: count[lang, s, t] for t in kept} for s in sources}
        n[None] = {t: sum(n[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for s, c in n.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            words = [(f(p[s][t], p[None][t]), t) for t in kept if n[s][t] and p[s][t] > p[None][t]]
            for part, each in (("pair", pairs), ("term", words)):
                each = sorted(each, key=lambda x: (-x[0], x[1].encode()))[: most if part == "term" else None]
                out += [(lang, s, part, t, v, k + 1) for k, (v, t) in enumerate(each)]
    return sorted(out)


def test_audit(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 11)
    monkeypatch.setattr(divergence, "TILE", 3)
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "CELLS", 100)
    rng = random.Random(7)
    words = [f"{a}{b}" for a in ("Wort", "été", "ab", "日本", "\U0001F600", "É") for b in "abcdefgh"]
    rows = [(i, " ".join(rng.choice(words[: 10 + 2 * (i % 20)]) + rng.choice([" ", "1", "-", "\n", "\x7f", "\0", "\x85"]) for _ in range(rng.randint(1, 60))), rng.choice(["de", "fr", None]), f"s{i % 9}") for i in range(150)]
    rows += [(None, None, None, None), (1, "", "de", None), (2, "a b c", "lone", "x"), (3, "...", "bare", "x"), (3, "...", "bare", "y"), (4, "unique words only", "few", "a"), (5, "other words here", "few", "b"), (6, "wort " * 400_000 + "q" * 100_000, "de", "s1")]
    rows += [(7, "tie one", "ties", f"t{k}") for k in range(7)] + [(8, "same same", "de", "s2")] * 5
    frame = spark.createDataFrame(rows, DOCS).repartition(3).withColumns({"term": F.lit("clash"), "n": F.lit(1), "docs": F.lit("x"), "value": F.lit(2)})
    got = sorted(map(tuple, divergence.audit(frame, 6).collect()))
    assert got == plain(rows, 6)
    assert divergence.audit(frame.limit(0)).count() == 0


def test_shares_are_exact():
    rng = random.Random(1)
    for _ in range(300):
        whole = rng.randint(1, 9 * 10**15)
        c = rng.randint(0, whole - 1)
        assert divergence.shares(np.array([[c]]), np.array([[whole]]))[0, 0] == 1 + 10**9 * (c + 1) // whole
    # The largest gaps stay within 64 bits.
    p, q = np.array([[10**9 + 1, 1]]), np.array([[1, 10**9 + 1]])
    assert divergence.pair_sums(p, q)[0, 0] == 10**18 + (10**18) // (10**9 + 1)


def test_a_task_sends_each_sum_once():
    """Terms that are read again are summed up before they are sent, also beyond 200,000 of them; what is held stays bounded."""
    letters = str.maketrans("0123456789", "abcdefghij")
    text = " ".join(str(k).translate(letters) for k in range(250_000)).encode()
    batch = lambda texts, lang="de": pa.RecordBatch.from_pydict({c: pa.array(v, pa.binary()) for c, v in (("text", texts), ("lang", [lang.encode()] * len(texts)), ("source", [b"s"] * len(texts)))})
    sent = [b for b in divergence.sums([batch([text]), batch([text, b"", b"a"])]) if b.num_rows]
    rows = pa.Table.from_batches(sent).to_pydict()
    assert len(rows["term"]) == len(set(rows["term"])) == 250_001
    found = dict(zip(rows["term"], zip(rows["n"], rows["docs"])))
    assert found[None] == (0, 4) and found["a"] == (3, 3) and found["b"] == (2, 2)
    small = [b.num_rows for b in divergence.sums([batch([b"one"] * (divergence.HELD + 5))])]
    assert small == [2, 2]
