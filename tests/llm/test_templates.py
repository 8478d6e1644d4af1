"""Benchmark decontamination against a plain version: canonical tokens by a scanner, all windows and shifts by dictionaries."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from quillspark.llm import decontamination as dc

ITEMS, DOCS = "item_id long, text string", "doc_id long, text string"


def scanned(text):
    """(word in lower case, number?, capitalised?, begins a sentence?) of each token."""
    low = lambda c: c.lower() if len(c.lower()) == 1 else c
    out, i, stop = [], 0, True
    while i < len(text):
        kind = str.isalpha if text[i].isalpha() else str.isdigit if text[i].isdigit() else None
        if kind is None:
            stop |= text[i] in ".!?\n|:;"
            i += 1
            continue
        j = i
        while j < len(text) and kind(text[j]):
            j += 1
        w = text[i:j]
        upper = lambda c: low(c) != c
        out.append(("".join(map(low, w)), kind is str.isdigit, kind is str.isalpha and len(w) > 1 and upper(w[0]) and not upper(w[1]), stop))
        i, stop = j, False
    return out


def canonical(text, reading):
    """[(token, slot or None)] of a reading."""
    tokens = scanned(text)
    if reading == 2:
        return [(w, None) for w, *_ in tokens]
    kinds = []
    for i, (w, number, capital, begins) in enumerate(tokens):
        unit = i > 0 and tokens[i - 1][1] and not number and w in dc.UNITS
        kinds.append("NUMBER" if number else "UNIT" if unit else "NAME" if capital and not begins and reading == 0 else None)
    out = []
    for i, ((w, *_), kind) in enumerate(zip(tokens, kinds)):
        if i and kind in ("NUMBER", "NAME") and kinds[i - 1] == kind:
            out[-1][1].append(w)
        else:
            out.append((kind or w, [w] if kind else None))
    return [(t, tuple(s) if s else None) for t, s in out]


def holds(doc, item, verbatim):
    short = len(canonical(item, 0)) < dc.SHORTEST
    for reading in (0, 1, 2):
        d, q = canonical(doc, reading), canonical(item, reading)
        if not q or reading < 2 and len(q) < dc.SHORTEST or reading == 2 and not (short or verbatim):
            continue
        size = min(len(q), dc.WINDOW)
        need = 1 if size < dc.WINDOW else max(1, min(len(q) - size + 1, (verbatim or dc.RUN if reading == 2 else dc.RUN) - dc.WINDOW + 1))
        shifts = defaultdict(set)
        for a in range(len(q) - size + 1):
            for b in range(len(d) - size + 1):
                if [t for t, _ in q[a : a + size]] == [t for t, _ in d[b : b + size]]:
                    shifts[b - a].add(a)
        for shift, places in shifts.items():
            pairs = {(q[a + k][1], d[a + shift + k][1]) for a in places for k in range(size) if q[a + k][1]}
            if len(places) >= need and len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}):
                return True
    return False


def test_against_all_windows(spark):
    rng = random.Random(9)
    words = "how many of the apples does pay for at each shop near".split()

    def made(n):
        out = []
        for _ in range(n):
            x = rng.random()
            out.append(str(rng.choice([3, 5, 12, 47])) + rng.choice(["", " km", " 7", " kg"]) if x < 0.15 else rng.choice(["Anna", "Bob Lee", "Paris", "Rome"]) if x < 0.3 else rng.choice(words) + rng.choice(["", "", "", ",", ".", "?"]))
        return " ".join(out)

    items = {i: made(rng.choice([2, 5, 9, 14, 22])) for i in range(24)} | {50: "2 + 2", 51: "What is 3 + 4?", 52: "!?", 53: ""}
    docs = {}
    for i in range(160):
        text = items[rng.randrange(24)].split()
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            if text:
                text[rng.randrange(len(text))] = made(1)
        lo = rng.choice([0, 0, 0, 3])
        docs[i] = f"{made(rng.choice([0, 6, 15]))} {' '.join(text[lo:])} {made(rng.choice([0, 6, 15]))}"
    docs |= {500: "It says what is 3 + 4 here", 501: "what is 4 + 3", 502: "", 503: "x 2 2 y", 504: "5 12 km", 505: "12 5 km"}
    b = spark.createDataFrame([*items.items(), (None, "how many of"), (60, None), (50, "2 + 2")], ITEMS).withColumn("row", F.lit("clash")).withColumn("size", F.lit(1))
    d = spark.createDataFrame([*docs.items(), (None, items[1]), (501, "what is 4 + 3"), (700, None)], DOCS).withColumn("items", F.lit("clash")).withColumn("at", F.lit(1))
    for verbatim in (None, dc.RUN):
        rows = dc.contamination(d, b, verbatim).collect()
        got = {r["doc_id"]: r["items"] for r in rows}
        assert len(rows) == len(docs) + 3
        want = {i: ",".join(str(k) for k, q in items.items() if holds(t, q, verbatim)) for i, t in docs.items()}
        assert got == want | {None: "", 700: ""} and len(set(want.values())) > 20
        kept = dc.clean(d, b, verbatim)
        assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {i for i, w in want.items() if not w} | {None, 700}
    assert dc.contamination(d.limit(0), b).count() == 0 and dc.contamination(d, b.limit(0)).where("contaminated").count() == 0


def test_verbatim_run_beside_an_edit(spark):
    q = "A train leaves Boston at 5 pm with 120 passengers and travels 300 km to Chicago while John eats 5 apples on the way home."
    b = spark.createDataFrame([(1, q)], ITEMS)
    d = spark.createDataFrame([(1, q.replace("5 apples", "6 apples")), (2, " ".join(q.split()[:10])), (3, "x " * 500_000 + q)], DOCS)
    assert {r["doc_id"]: r["contaminated"] for r in dc.contamination(d, b, dc.RUN).collect()} == {1: True, 2: False, 3: True}


def test_order_of_joined_numbers():
    slots = [tuple(s.tolist()) for _, s, _ in list(dc.readings(dc.Tokens(["5 12", "12 5"])))[:1]]
    assert slots[0][0] != slots[0][1]
