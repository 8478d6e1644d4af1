"""Queries against DuckDB on the smallest tables, golden vectors, and sequential versions of the folds."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark import queries as q
from quillspark.config import PROFILES, merged
from quillspark.operators import citations, dedup, ranking
from quillspark.operators.passages import split_passages, timestamped_text
from quillspark.plans.render import markdown_to_html
from quillspark.sources import pages, payloads
from quillspark.sources.store import latest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "documents pages benchmark labels conversations events".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame, columns):
    return sorted(repr(tuple(None if x is None or x != x else int(x) if isinstance(x, float) and x == int(x) else x for x in r)) for r in frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_oracle(spark, duck, name):
    got, want = q.QUERIES[name](spark, SF).toPandas(), duck.sql(q.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.SQL)))
def test_runs(spark, name):
    assert q.QUERIES[name](spark, SF).count() >= 0


def test_split_passages():
    assert split_passages("aaaa bbbb\n\n== H ==\n\ncccc dddd eeee", 20, 5) == ["aaaa bbbb\n== H ==", "cccc dddd eeee"]
    assert split_passages("one two. three four. five six seven", 22, 5) == ["one two. three four.", "five six seven"]
    assert split_passages("aaa bbb\n\nccc ddd", 8, 10) == []
    assert split_passages("short", 20, 10) == ["short"]


def test_windows(spark):
    s = [(0.0, "a"), (10.0, "b"), (30.0, "c"), (31.0, "d"), (65.0, "e"), (3700.0, "f")]
    df = spark.createDataFrame([(s,)], "s array<struct<start:double,text:string>>")
    assert df.select(timestamped_text(F.col("s"))).first()[0] == "[0:00] a b c\n[0:31] d e\n[1:01:40] f"


def test_greedy_dedup(spark):
    random.seed(3)
    data = [(1, i, f"https://e.org/{random.randint(0, 12)}", f"title {random.randint(0, 12)}") for i in range(60)] + [(2, 0, "https://a/1", "x"), (2, 1, "https://a/2", "x"), (2, 2, "https://a/2", "y")]
    got = {tuple(r) for r in dedup.greedy_two_key(spark.createDataFrame(data, "topic_id int, ord bigint, url string, title string"), ["topic_id"]).select("topic_id", "ord").collect()}
    want, seen = set(), set()
    for t, o, u, title in data:
        if (t, u) not in seen and (t, title) not in seen:
            seen |= {(t, u), (t, title)}
            want.add((t, o))
    assert got == want and {(2, 0), (2, 2)} <= got


def test_budget(spark):
    data = [(1, 1, 0, "x" * 50, 4.0), (1, 1, 1, "x" * 80, 3.0), (1, 2, 0, "x" * 30, 2.0), (1, 1, 2, "x" * 10, 1.0)]
    df = spark.createDataFrame(data, "g int, source_id bigint, idx int, text string, score double")
    assert [len(r["text"]) for r in ranking.budgeted_passages(df, ["g"], 3, 2, 100).collect()] == [50, 30, 10]


def test_budget_walks_to_the_end(spark):
    """Against the sequential walk: one source fills the first 400 places, and what still fits stands far behind."""
    rng = random.Random(6)
    data = [(1, 1, i, "x" * 40, 9.0) for i in range(450)] + [(1, 2, 0, "x" * 50, 2.0), (1, 3, 0, "x" * 20, 1.0)]
    data += [(2, s, i, "x" * rng.randint(20, 140), rng.choice([0.0, rng.random()])) for s in range(90) for i in range(12)] + [(3, 1, 1, "x" * 500, 0.0), (3, 1, 0, "x" * 500, 0.0)]
    df = spark.createDataFrame(data, "g int, source_id bigint, idx int, text string, score double")
    for k, per_source, most in ((5, 2, 150), (40, 3, 1000), (3, 1, 20), (12, 2, 90)):
        want = set()
        for g in (1, 2, 3):
            chosen = []
            for p in sorted((p for p in data if p[0] == g), key=lambda p: (-p[4], p[1], p[2])):
                if len(chosen) == k or (p[4] <= 0 and chosen):
                    break
                if sum(c[1] == p[1] for c in chosen) < per_source and (not chosen or sum(len(c[3]) for c in chosen) + len(p[3]) <= most):
                    chosen.append(p)
            want |= {p[:3] for p in chosen}
        assert {tuple(r) for r in ranking.budgeted_passages(df, ["g"], k, per_source, most).select("g", "source_id", "idx").collect()} == want


def test_sentences_and_support(spark):
    df = spark.createDataFrame([("A b. C d [S1]! Dr. X 3.5 m[S2]. tail",)], "t string")
    assert df.select(citations.sentences(F.col("t"))).first()[0] == ["A b.", " C d [S1]!", " Dr.", " X 3.5 m[S2].", " tail"]
    sources = spark.createDataFrame([(0, 1, "Vaccines train immune cells to recognise viral proteins. In 1,796 trials were recorded."), (0, 2, "Bread dough rises slowly overnight.")], "r int, source_id bigint, text string")
    text = "Vaccines train immune cells to recognise proteins [S1]. Vaccines train immune cells to recognise proteins [S2]. Vaccines trained 1,796 immune cells recognising viral proteins [S1]. Vaccines trained 2,500 immune cells recognising viral proteins [S1]. Too short here [S1]."
    got = citations.support_check(spark.createDataFrame([(0, 0, text)], "r int, text_ord int, text string"), sources, ["r"]).orderBy("ord").collect()
    assert [r["flagged"] for r in got] == [False, True, False, True]
    assert got[3]["missing"] == ["2,500"] and got[1]["overlap"] == 0


def test_support_check_of_whole_documents(spark):
    """c07_support_check against plain Python, over every document and all of its text."""
    import re

    from quillspark.config import STOPWORDS

    def stem(t):
        if len(t) > 3:
            t = t[:-3] + "y" if t.endswith("ies") else t[:-2] if re.search("(sses|xes|zes|ches|shes)$", t) else t[:-1] if t.endswith("s") and not re.search("(ss|us|is)$", t) else t
        for end in ("ingly", "edly", "ing", "ed"):
            if t.endswith(end) and len(t) >= len(end) + 3:
                t = t[: -len(end)]
                break
        t = t[:-1] if len(t) > 3 and t.endswith("e") else t
        return t[:-1] if len(t) > 3 and t[-1] == t[-2] and t[-1] not in "lsz" else t

    def words(x, stop):
        found = [re.sub("^[-']+|[-']+$", "", w.lower()) for w in re.findall(r"[A-Za-z0-9][A-Za-z0-9'\-]*", x)]
        return [stem(w) for w in found if len(w) >= 2 and (stop or w not in STOPWORDS)]

    docs = {r["doc_id"]: r["text"].replace("\n", "\n\n") for r in spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").collect()}
    want = {}
    for i, text in docs.items():
        other = docs[i + 1 if i + 1 in docs else min(docs)]
        bag, body = set(words(other, True)), other.replace(",", "")
        cut = [x for line in text.split("\n") for x in re.findall(r"[^\n]+?[.!?]+(?=\s|\Z|\[)(?:\s*\[S\d+\])*|[^\n]+(?=\n|\Z)", line)]
        for x in cut:
            content = [w for w in words(x, False) if len(w) >= 4 and w not in STOPWORDS]
            if len(content) >= 5:
                overlap = sum(w in bag for w in content) / len(content)
                numbers = [n for n in re.findall(r"(?<![A-Za-z0-9_.])\d[\d,]*(?:\.\d+)?(?![A-Za-z0-9_])", x) if len(re.sub("[,.]", "", n)) >= 2]
                want.setdefault(i, []).append((x.strip(), round(overlap, 6), overlap < 0.35 or any(n.replace(",", "") not in body for n in numbers)))
    got = {}
    for r in q.QUERIES["c07_support_check"](spark, SF).orderBy("text_ord", "ord").collect():
        got.setdefault(r["text_ord"], []).append((r["sentence"].strip(), round(r["overlap"], 6), r["flagged"]))
    assert max(got) >= 50 and got == want


def test_payloads(spark):
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/1</id><title>T  x</title><summary>S</summary><published>2024-02-03T00:00:00Z</published><author><name>A</name></author><author><name>B</name></author></entry></feed>'
    r = payloads.arxiv(spark.createDataFrame([(1, atom)], "topic_id int, body string"), 5).first()
    assert (r["title"], r["url"], r["date"], r["authors"], r["trust"]) == ("T x", "https://arxiv.org/abs/1", "2024-02-03", "A, B", 0.7)
    work = '{"results":[{"title":"W","doi":"https://doi.org/1","publication_year":2020,"cited_by_count":5,"abstract_inverted_index":{"b":[1],"a":[0],"d":[3]},"authorships":[]}]}'
    assert payloads.openalex(spark.createDataFrame([(1, work)], "topic_id int, body string"), 3).first()["text"] == "a b d"
    rss = "<rss><item><title>News - Pub</title><link>https://n/1</link><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate><source>Pub</source><description>&lt;a&gt;News&lt;/a&gt; - more</description></item></rss>"
    n = payloads.google_news(spark.createDataFrame([(1, rss)], "topic_id int, body string"), 3).first()
    assert (n["title"], n["text"], n["date"]) == ("News", "more", "2024-01-02")
    g = payloads.gdelt(spark.createDataFrame([(1, 200, '{"articles":[{"url":"https://x.gov/a","title":"T","seendate":"20240105T101112Z"}]}'), (1, 429, "{}")], "topic_id int, status int, body string"), 3).collect()
    assert [(x["date"], x["trust"]) for x in g] == [("2024-01-05", 0.9)]
    med = "<PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>M</ArticleTitle><Abstract><AbstractText Label='AIMS'>a</AbstractText><AbstractText>b</AbstractText></Abstract><Journal><Title>J</Title><JournalIssue><PubDate><MedlineDate>2019 Jan</MedlineDate></PubDate></JournalIssue></Journal><AuthorList><Author><LastName>L</LastName><Initials>I</Initials></Author></AuthorList></Article></MedlineCitation></PubmedArticle>"
    m = payloads.pubmed(spark.createDataFrame([(1, med)], "topic_id int, body string")).first()
    assert (m["text"], m["date"], m["authors"], m["pmid"]) == ("Aims: a b", "2019", "L I", "7")
    t = spark.createDataFrame([('<t><text start="1.5" dur="2">a &amp;amp; b [music]</text><text start="4">c</text></t>',), ('<p t="2500">x</p>',)], "b string").select(payloads.transcript(F.col("b"))).collect()
    assert [[tuple(s) for s in r[0]] for r in t][1] == [(2.5, "x")] and t[0][0][1]["start"] == 4.0


def test_pages():
    page = "<html><head><meta property='og:title' content='OG'><title>T</title></head><body><nav><p>" + "n" * 50 + "</p></nav><main><h2>H</h2><p>" + "a" * 45 + "<p>" + "a" * 45 + "<p>short</main></body></html>"
    assert pages.extract_page(page) == ("OG", "", "== H ==\n\n" + "a" * 45)
    found = pages.parse_results('<div class="result result--ad"><a class="result__a" href="/ad">x</a></div><div class="result"><a class="result__a" href="/l/?uddg=https%3A%2F%2Fe.org%2Fp">T</a><a class="result__snippet">B</a></div>')
    assert found == [("https://e.org/p", "T", "B")]
    data = 'var ytInitialData = {"a":[{"videoRenderer":{"videoId":"v","title":{"runs":[{"text":"A {b}"}]},"viewCountText":{"simpleText":"1,234 views"}}}]};'
    assert [(v["video_id"], v["title"], v["views"]) for v in pages.parse_videos(data)] == [("v", "A {b}", 1234)]
    assert markdown_to_html("# A\n\n- **b** <x>\n\ntext [1]").startswith("<h1>A</h1>\n<ul><li><strong>b</strong> &lt;x&gt;</li></ul>")


def test_config_and_store(spark):
    assert [p.model_calls() for p in PROFILES.values()] == [7, 13, 15]
    assert merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("j", 1, "c")], "k string, t int, v string")
    assert sorted(map(tuple, latest(df, ["k"], "t").collect())) == [("j", 1, "c"), ("k", 2, "b")]


def test_stream(spark, tmp_path):
    from quillspark.streaming.cache import keep_latest

    src = str(tmp_path / "in")
    spark.createDataFrame([("a", "2024-01-01 00:00:00", 1), ("a", "2024-01-02 00:00:00", 2)], "ns string, t string, v int").selectExpr("ns", "to_timestamp(t) t", "v").write.parquet(src)
    keep_latest(spark.readStream.schema("ns string, t timestamp, v int").parquet(src), str(tmp_path / "out"), str(tmp_path / "cp"), ["ns"], "t").awaitTermination()
    assert [r["v"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [2]


def test_passages_hold_the_line_feed():
    """The line feed between two blocks counts: 450 and 450 with it are 901, one too many."""
    assert [len(p) for p in split_passages("a" * 449 + "\n\n" + "b" * 450, 900)] == [900]
    assert [len(p) for p in split_passages("a" * 450 + "\n\n" + "b" * 450, 900)] == [450, 450]
    rng = random.Random(8)
    for _ in range(300):
        blocks = ["x" * rng.randint(1, 60) for _ in range(rng.randint(1, 12))]
        assert all(len(p) <= 70 for p in split_passages("\n\n".join(blocks), 70, 1))


def plain_greedy(data):
    """data: (topic, ord, keys)."""
    gone, seen = set(), set()
    for topic, at, keys in sorted(data):
        keys = {(topic, k) for k in keys}
        if seen & keys:
            gone.add((topic, at))
        else:
            seen |= keys
    return gone


@pytest.mark.parametrize("walk", [0, 7, 10**6])
def test_dedup_in_turns(spark, walk):
    """Against the walk: random rows, a chain that settles one link a turn, a title that a third of the rows share, and rows whose only key is shared."""
    rng = random.Random(walk)
    data = [(1, i, [f"u{rng.randint(0, 90)}", f"t{rng.randint(0, 90)}"]) for i in range(200)] + [(2, i, [f"k{i}", f"k{i + 1}"]) for i in range(12)]
    data += [(3, i, [f"u{i // 2}", "t:" if i % 3 == 0 else f"t{i % 50}"]) for i in range(150)] + [(4, i, ["same"]) for i in range(30)] + [(5, 0, ["alone"]), (6, -4, ["a", "b"]), (6, 2**40, ["b", "c"]), (6, 2**41, ["c"])]
    df = spark.createDataFrame(data, "topic_id int, ord bigint, keys array<string>").repartition(3)
    got = [tuple(r) for r in dedup.first_independent(df, ["topic_id"], "ord", F.col("keys"), walk).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_greedy(data)


def test_dedup_of_odd_rows(spark):
    """No address: the title stands for it. Titles without letters share a key. No rows, no result."""
    data = [(1, 0, None, "A b"), (1, 1, "", "a B"), (1, 2, "https://e.org/1", "!!"), (1, 3, "https://e.org/2", "??"), (1, 4, None, None), (1, 5, "https://www.e.org/1/", "other")]
    df = spark.createDataFrame(data, "topic_id int, ord bigint, url string, title string").withColumn("_key", F.lit("clash"))
    kept = dedup.greedy_two_key(df, ["topic_id"])
    assert sorted(r["ord"] for r in kept.collect()) == [0, 2] and kept.columns == df.columns
    assert dedup.greedy_two_key(df.limit(0), ["topic_id"]).count() == 0


def test_support_check_of_several_sources(spark):
    """Words count by occurrence and may come from any source cited; numbers by substring, commas aside; unknown ids and short sentences go."""
    sources = spark.createDataFrame([(0, 1, "Alpha rivers carry gravel; 12,345 tons and 3.14159 more. Code x1796y."), (0, 2, "Beta glaciers grind stone."), (0, 3, None), (1, 1, "Other report.")], "r int, source_id int, text string")
    texts = [
        "Rivers carry gravel while glaciers grind stone [S1][S2].", "Rivers carry gravel while glaciers grind stone [S1].", "Rivers rivers rivers carry marble granite basalt [S1, S9].",
        "Rivers carried gravel stones totalling 2,345 or 796 or 3.14 or 99 tons [S1][S2].", "Nothing known regarding several different words [S3].", "Unknown source with several content words [S9].", "Rivers carry gravel [S1].", "Numbers 1,0 and 7 and 77.7 and 88 and 66 and 55 and 44 with several measured content words [S2]"]
    got = {r["text_ord"]: r for r in citations.support_check(spark.createDataFrame([(0, k, t) for k, t in enumerate(texts)], "r int, text_ord int, text string"), sources, ["r"]).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 7]
    assert got[0]["overlap"] == 1 and list(got[0]["ids"]) == [1, 2] and abs(got[1]["overlap"] - 3 / 6) < 1e-9 and abs(got[2]["overlap"] - 4 / 7) < 1e-9 and list(got[2]["ids"]) == [1]
    assert list(got[3]["missing"]) == ["99"] and got[4]["overlap"] == 0 and list(got[7]["missing"]) == ["1,0", "77.7", "88", "66"]
    assert citations.support_check(spark.createDataFrame([], "r int, text_ord int, text string"), sources, ["r"]).count() == 0


def test_clean_body(spark):
    valid = F.array(F.lit(1).cast("long"))
    clean = lambda t: spark.createDataFrame([(t,)], "t string").select(citations.clean_body(F.col("t"), valid)).first()[0]
    assert clean("# Head\nClaim [S99] stays [S1] .\n #1 cause is heat [S1]\n####### seven\n###### six\n  ## two") == "Claim stays [S1].\n #1 cause is heat [S1]\n####### seven"
