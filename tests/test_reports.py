"""Replies are cleaned before they are shown; whole reports, their HTML and their sources."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.config import PROFILES
from quillspark.plans import briefing, render, report
from quillspark.plans.render import markdown_to_html


@pytest.fixture(scope="module")
def made(spark):
    topics = spark.createDataFrame([(1, "It's <new>", "2024-05-01", "beginner", "standard"), (2, "Bare", "2024-05-02", "expert", "deep")], "topic_id int, topic string, generated string, level string, depth string")
    kinds = "topic_id int, id int, title string, publisher string, date string, authors string, kind string, provider string, url string, trust double, text string, ord int"
    text = "Rivers carry gravel downstream during spring floods every year."
    sources = spark.createDataFrame([(1, k, f"T{k}", "P", "2020", "A", "web", "Web", f"https://e.org/{k}", 0.7, text, k) for k in (1, 2, 3)] + [(2, 1, "Only", "", "", "", "news", "X", "https://n/1", 0.2, None, 1)], kinds)
    bodies = spark.createDataFrame([(1, 0, "overview", "What", "Rivers carry gravel downstream during spring floods [S3]. Glaciers never carry marble northwards [S3]."), (1, 1, "how", "How", "It's so [S1]."), (1, 2, "news", "News", None)], "topic_id int, ord int, key string, title string, body string")
    replies = spark.createDataFrame([(1, "glossary", "Gravel :: stones [S2] [S9]\nb :: c [S3]"), (1, "quiz", "Q:: a? || A:: b [S1]"), (1, "next", "NEXT:: N | w")], "topic_id int, step string, text string")
    videos = spark.createDataFrame([(1, 0, "V", "https://v/1", "C", 65, "", 10, "vid", "transcript", "Told [S1].", [(5, "k")])], "topic_id int, ord int, title string, url string, publisher string, seconds bigint, date string, views bigint, video_id string, basis string, summary string, points array<struct<second:bigint,text:string>>")
    models = spark.createDataFrame([(1, 0, "m1"), (1, 1, "m2")], "topic_id int, ord int, model string")
    warnings = spark.createDataFrame([(2, 0, "one failed")], "topic_id int, ord int, warning string")
    return sources, report.assemble(topics, sources, bodies, replies, videos, models, warnings)


def test_assembled(made):
    one, two = made[1].orderBy("topic_id").collect()
    assert [tuple(g) for g in one["glossary"]] == [("Gravel", "stones [1]"), ("b", "c [2]")]
    assert [s["body"] for s in one["sections"]] == ["Rivers carry gravel downstream during spring floods [2]. Glaciers never carry marble northwards [2].", "It's so [3]."]
    assert [(r["n"], r["source"]["title"]) for r in one["refs"]] == [(1, "T2"), (2, "T3"), (3, "T1")] and list(one["consulted"]) == []
    assert one["videos"][0]["summary"] == "Told [3]." and tuple(one["quiz"][0]) == ("a?", "b") and one["mode"] == "llm" and list(one["models"]) == ["m1", "m2"]
    assert len(one["verification"]) == 2 and one["verification"][0].startswith("1 of 2 cited sentences") and "Glaciers never carry marble northwards" in one["verification"][1]
    assert two["mode"] == "extractive" and list(two["warnings"]) == ["one failed"] and [c["title"] for c in two["consulted"]] == ["Only"] and all(len(two[c]) == 0 for c in ("glossary", "sections", "videos", "quiz", "next", "refs", "models", "verification"))


def test_markdown_and_html(made):
    text = {r["topic_id"]: r["m"] for r in made[1].select("topic_id", render.markdown().alias("m")).collect()}
    assert "## Key terms" in text[1] and "1. **T2**" in text[1] and "*No sources were cited.*" in text[2] and "- *Run note:* one failed" in text[2]
    body = render.html_body(made[1], ["topic_id"]).join(made[1].select("topic_id", "topic"), "topic_id")
    page = {r["topic_id"]: r["h"] for r in body.select("topic_id", render.document(F.col("topic"), F.col("html")).alias("h")).collect()}
    assert "<title>It&#39;s &lt;new&gt; – learning briefing</title>" in page[1] and "<h1>It&#39;s &lt;new&gt;</h1>" in page[1] and "It&#39;s so" in page[1] and "&#x27;" not in page[1]
    assert all(f"<li>{n}</li>" in page[2] for n in render.HTML_NOTES)
    assert markdown_to_html("it's \"x\" & `a'b` **c'd**") == "<p>it&#39;s &quot;x&quot; &amp; <code>a&#39;b</code> <strong>c&#39;d</strong></p>"


def test_sources_document(spark, made):
    topics = spark.createDataFrame([(1, "A", "2024-05-01"), (2, "B", "2024-05-02"), (3, "none", "2024-05-03")], "topic_id int, topic string, generated string")
    numbers = spark.createDataFrame([(1, 3, 1), (1, 1, 2)], "topic_id int, id int, n int")
    got = {r["topic_id"]: json.loads(r["json"]) for r in report.sources_document(topics, made[0], numbers).collect()}
    assert [(s["n"], s["cited"], s["title"], s["retrieved"], s["reliability_heuristic"]) for s in got[1]["sources"]] == [(1, True, "T3", "2024-05-01", "medium"), (2, True, "T1", "2024-05-01", "medium"), (None, False, "T2", "2024-05-01", "medium")]
    assert got[2]["generated"] == "2024-05-02" and got[3] == {"topic": "none", "generated": "2024-05-03", "sources": []}


def test_replies_are_cleaned(spark):
    chosen = spark.createDataFrame([(1, s, 4, 0, "Some passage of the source.", 2.0) for s in ("a", "b", "c")], "topic_id int, section string, source_id bigint, idx int, text string, score double")
    replies = spark.createDataFrame([(1, "a", "# Head\nClaim [S99] holds [S4, S7]."), (1, "b", "## Only a heading"), (1, "c", None)], "topic_id int, section string, text string")
    got = {r["section"]: r["body"] for r in briefing.write(chosen, replies).collect()}
    assert got["a"] == "Claim holds [S4]." and "Some passage of the source. [S4]" in got["b"] and got["b"] == got["c"]


def test_a_glossary_is_cut_to_the_profile(spark):
    replies = spark.createDataFrame([(1, "glossary", "\n".join(f"t{k} :: d [S1]" for k in range(60)))], "topic_id int, step string, text string")
    sources = spark.createDataFrame([(1, 1)], "topic_id int, id int")
    assert report.glossary(replies, sources, PROFILES["standard"]).count() == PROFILES["standard"].glossary_terms
