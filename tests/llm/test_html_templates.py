"""Site templates found by counts alone, marks that empty no page, and both ways for template hashes to reach pages."""

import random
import re
from collections import Counter

from quillspark.llm import html_text

COLUMNS = "page_id long, url string, html string"


def site(host, n, seed):
    """Pages without article, main, telling tags or names: a block that every page has, one of a section, one on two pages, and own text."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        own = " ".join(rng.choice("abcdefghij") * rng.randint(2, 9) for _ in range(30))
        parts = [f"<div class=x{rng.randrange(9)}><p>Every page of {host} has this</p><p>and this.</p></div>"]
        parts += ["<div><span>Only a section has this</span></div>"] * (i % 3 == 0) + ["<div><p>Said on two pages</p></div>"] * (i < 2)
        parts += [f"<div><h2>Title {i}</h2><p>{own}</p><ul><li>one {i}</li><li>two {i}</li></ul></div>", "<div><p>Made by us</p></div>"]
        out.append((f"http://{host}/{i}", "<html><body>" + "".join(parts) + "</body></html>", own))
    return out


def test_counts_alone(spark):
    rows = [(f"{h}", *p) for h, n, s in (("big.example", 60, 1), ("small.example", 4, 2), ("two.example", 2, 3)) for p in site(h, n, s)]
    pages = spark.createDataFrame([(i, r[1], r[2]) for i, r in enumerate(rows)], COLUMNS).selectExpr("*", "'clash' AS text", "1 AS host", "2 AS doc")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(pages).collect()}
    removed = Counter()
    for i, (host, url, page, own) in enumerate(rows):
        n = int(url.rsplit("/", 1)[1])
        kept = got[i].split("\n")
        everything = html_text.extract(page).split("\n")
        removed[host] += len(everything) - len(kept)
        assert own in kept and f"Title {n}" in kept and f"two {n}" in kept and ("Said on two pages" in kept) == (n < 2)
        if host != "two.example":
            assert "Made by us" not in kept and not any("Every page" in k or k == "and this." for k in kept)
    # Of each page of the large host three blocks, and the section's of every third; two pages are too few to tell.
    assert removed == {"big.example": 3 * 60 + 20, "small.example": 3 * 4, "two.example": 0}
    joined = {r["page_id"]: r["text"] for r in html_text.main_text(pages, sent=0).collect()}
    assert joined == got


def test_brute_force_counts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = html_text._subtrees(pages.select("html", html_text._host(pages["url"]).alias("host"), pages["page_id"].alias("doc")))
    got = {tuple(r) for r in html_text.templates(rows).collect()}
    different, count = {}, Counter()
    for r in pages.collect():
        host = re.match(r"[a-z]+://([^/?#:]*)", r["url"].lower()).group(1)
        page, hashes = html_text.subtrees(r["html"] or "")
        different.setdefault(host, {}).setdefault(page, []).append(hashes)
    want = set()
    for host, found in different.items():
        count = Counter(h for hashes in found.values() for h in min(hashes))
        want |= {(host, h) for h, n in count.items() if n >= 50 or n >= 5 and n >= 0.1 * len(found) or n >= 3 and n >= 0.5 * len(found)}
    assert got == want


def test_names_empty_no_page():
    text = "A long paragraph of the article that must stay. " * 3
    assert html_text.extract(f'<body><div class="layout no-sidebar"><p>{text}</p></div></body>') == text.strip()
    article = f'<article><div class="side-by-side"><p>{text}</p></div><p class="share-price">12.50</p><section id="discussion"><p>Discussed.</p></section><div class="widget"><p>{text * 9}</p></div></article>'
    assert html_text.extract(article) == "\n".join((text.strip(), "12.50", "Discussed.", (text * 9).strip()))
    small = f'<article><p>{text}</p><div class="Sidebar wide"><p>aside</p></div><section id="comments"><p>nice!</p></section><div hidden>no</div><div role="navigation">x</div></article>'
    assert html_text.extract(small) == text.strip()


def test_article_keeps_shared_paragraphs(spark):
    """Articles may share paragraphs and list items; small boxes that all of them have are the site's."""
    rows = [(i, f"http://news.example/{i}", f"<nav>{i}</nav><article><h1>Title {i}</h1><p>A paragraph that all articles share, word for word.</p><p>{'own ' * 30}{i}</p><div><b>Follow us</b><p>Now!</p></div></article>") for i in range(20)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got[4] == f"Title 4\nA paragraph that all articles share, word for word.\n{'own ' * 30}4"


def test_odd_rows(spark):
    page = "<body><div><p>One  two\n three &amp; four</p></div></body>"
    rows = [(1, "http://a.example/", page), (1, "http://a.example/", page), (2, None, page), (3, "no address", None), (4, "http://a.example/x", ""), (None, "http://a.example/y", "<p>a<p>b"), (5, "http://long.example/", "<p>" + "word " * 400_000), (6, "http://deep.example/", "<div>" * 5000 + "deep")]
    got = html_text.main_text(spark.createDataFrame(rows, COLUMNS)).collect()
    by = {r["page_id"]: (r["text"], r["n_chars"]) for r in got}
    assert len(got) == len(rows) and by[1] == by[2] == ("One two three & four", 20) and by[3] == by[4] == ("", 0) and by[None][0] == "a\nb" and by[5][1] == 5 * 400_000 - 1 and by[6][0] == "deep"
    assert html_text.main_text(spark.createDataFrame([], COLUMNS)).count() == 0
