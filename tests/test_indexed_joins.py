"""Operators that meet by pointers, prefixes, rare tokens and grams, against plain versions on random and odd rows."""

import random
import re

from pyspark.sql import functions as F

from quillspark.operators import passages, ranking, substring
from quillspark.sources import pages


def plain_lines(segments, seconds):
    lines, began, parts = [], None, []
    for start, text in segments:
        began = start if began is None else began
        parts.append(text)
        if start - began >= seconds:
            lines.append((began, " ".join(parts)))
            began, parts = None, []
    return lines + ([(began, " ".join(parts))] if parts else [])


def test_timed_lines(spark):
    rng = random.Random(5)
    talks = {"steady": [(k * 2.5, f"w{k}") for k in range(400)], "one": [(7.0, "x")], "ties": [(0.0, "a"), (0.0, "b"), (30.0, "c"), (30.0, "d"), (59.99, "e"), (60.0, "f")], "back": [(0.0, "a"), (40.0, "b"), (5.0, "c"), (36.0, "d"), (50.0, "e")], "gaps": [(k * 100.0, f"g{k}") for k in range(20)]}
    talks["random"] = [(t, f"r{k}") for k, t in enumerate(sorted(rng.choice([rng.random() * 900, rng.randint(0, 900) * 1.0]) for _ in range(150)))]
    rows = [(name, k, start, text) for name, s in talks.items() for k, (start, text) in enumerate(s)] + [(None, 0, 1.0, "null key"), ("holes", 0, None, None), ("holes", 3, 31.0, "z")]
    talks |= {None: [(1.0, "null key")], "holes": [(0.0, ""), (31.0, "z")]}
    frame = spark.createDataFrame(rows, "talk string, pos int, start double, text string").repartition(4).withColumns({"line": F.lit("clash"), "at": F.lit("clash")})
    got = {}
    for r in passages.timed_lines(frame.where("talk is not null"), ["talk"]).orderBy("talk", "line").collect():
        got.setdefault(r["talk"], []).append((r["line"], r["start"], r["text"]))
    assert got == {n: [(k + 1, *x) for k, x in enumerate(plain_lines(s, 30))] for n, s in talks.items() if n is not None}
    whole = {r["talk"]: r["text"] for r in passages.timed_text(frame.where("talk in ('steady', 'ties')"), ["talk"], 200).collect()}
    array = spark.createDataFrame([(n, talks[n]) for n in ("steady", "ties")], "talk string, s array<struct<start:double,text:string>>")
    assert whole == {r[0]: r[1] for r in array.select("talk", passages.timestamped_text(F.col("s"), 200)).collect()}
    assert passages.timed_text(frame.limit(0), ["talk"]).count() == 0


def plain_allowed(rules, path):
    best = None
    for allow, pattern in rules:
        body, end = (pattern[:-1], r"\Z") if pattern.endswith("$") else (pattern, "")
        if re.match(".*".join(map(re.escape, body.split("*"))) + end, path) and (best is None or (len(pattern), allow) > best):
            best = (len(pattern), allow)
    return best is None or best[1]


def test_robots(spark):
    rng = random.Random(9)
    odd = ["/", "*", "$", "/a$b", "/a*b*c$", "/a/b", "/a/b$", "*/b$", "/*", "/a.b", "/a+b(c)", "/x" * 40, "/é", "**", "/a*$"]
    rules = {o: [(rng.random() < 0.5, rng.choice(odd) if rng.random() < 0.4 else "/" + "".join(rng.choice("ab*./") for _ in range(rng.randint(0, 5))) + rng.choice(["", "$"])) for _ in range(25)] for o in "uvw"}
    rules["ties"] = [(True, "/a*"), (False, "/a*"), (False, "/ab")]
    paths = [(o, p) for o in [*"uvw", "ties", "none"] for p in ["/", "", "/a$b", "/a/b", "/a.b", "/a+b(c)x", "/ab", "/a", "/x" * 41, "/é/2", *("/" + "".join(rng.choice("ab./") for _ in range(rng.randint(0, 7))) for _ in range(60))]]
    body = lambda o: "User-agent: *\n" + "\n".join(f"{'Allow' if a else 'Disallow'}: {p}" for a, p in rules[o])
    robots = spark.createDataFrame([(o, body(o)) for o in rules], "origin string, body string")
    urls = spark.createDataFrame(paths, "origin string, path string").withColumn("pattern", F.lit("clash"))
    got = pages.allowed_by_robots(urls, robots, "reader")
    assert got.count() == len(paths)
    assert {(r["origin"], r["path"]): r["allowed"] for r in got.collect()} == {(o, p): plain_allowed(rules.get(o, []), p) for o, p in paths}


def test_containment(spark):
    rng = random.Random(2)
    words = [f"word{k}k" for k in range(30)]
    texts = {i: rng.choices(words, range(30, 0, -1), k=rng.randint(0, 15)) for i in range(80)}
    terms = [(i, " ".join(rng.sample(words, rng.randint(1, 4)))) for i in range(60)] + [(90, "unheard word1k"), (91, "word2k word2k"), (92, "the"), (93, "!!"), (94, "")]
    sources = spark.createDataFrame([(1, i, " ".join(t)) for i, t in texts.items()] + [(1, 500, None), (1, 501, "the end"), (2, 502, "word1k")], "topic_id int, source_id int, text string")
    asked = spark.createDataFrame([(1, t, i) for i, t in terms] + [(2, "word1k", 0), (2, "word3k", 1), (3, "word1k", 0), (3, "none", 1)], "topic_id int, term string, ord int").withColumn("token", F.lit("clash"))
    got = {tuple(r) for r in ranking.containment(asked, sources, ["topic_id"]).select("topic_id", "ord", "source_id").collect()}
    want = {(1, i, s) for i, t in terms for s, have in texts.items() if re.findall("[a-z0-9]+", t) and set(t.split()) <= set(have)} | {(1, 92, 501), (2, 0, 502)}
    assert got == want
    cover = {(r["topic_id"], r["ord"]): r["coverage"] for r in ranking.term_coverage(asked, sources, ["topic_id"]).collect()}
    assert cover[2, 0] == 1 and (2, 1) not in cover and cover[3, 0] == cover[3, 1] == 0 and all(cover.get((1, i), 0) == sum(x[:2] == (1, i) for x in want) for i, _ in terms)


def test_substrings(spark):
    rng = random.Random(3)
    texts = {i: "".join(rng.choice("abC é") for _ in range(rng.randint(0, 12))) for i in range(150)} | {900: "", 901: "İß", 902: "abababababab"}
    needles = ["", " ", "a", "B", "ab", "aba", "abab", "cé", "zzz", " é c ", "ababababababab", "bc a"]
    rows = spark.createDataFrame([*texts.items(), (903, None)], "id int, title string").withColumns({"gram": F.lit("clash"), "search_id": F.lit(1), "needle": F.lit("x")})
    searches = spark.createDataFrame(list(enumerate(needles)) + [(50, None)], "search_id int, needle string")
    index = substring.grams(rows, ["id"], "title")
    got = sorted(map(tuple, substring.find(searches, rows, index, ["id"], "title").select("search_id", "id").collect()))
    fold = lambda t: t.lower().replace("i̇", "i̇")
    want = [(k, i) for k, n in [*enumerate(needles), (50, "")] for i, t in [*texts.items(), (903, "")] if fold(n).strip(" ") in fold(t)]
    assert got == sorted(want)
    assert substring.find(searches.limit(0), rows, index, ["id"], "title").count() == 0
