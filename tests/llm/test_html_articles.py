"""What an article keeps and loses: names by their parts, shared passages, boxes at its end, and the choice of what is the article."""

from quillspark.llm import html_text

COLUMNS = "page_id long, url string, html string"
TEXT = "A long paragraph of the article that must stay, whatever else the page says. " * 3


def test_parts_of_names():
    for name in ("user-comments", "advert-box", "ad_slot", "CommentList", "site-nav", "cookie-bar", "left-sidebar"):
        page = f'<article><p>{TEXT}</p><div class="{name}"><p>Great post, thanks!</p></div></article>'
        assert html_text.extract(page) == TEXT.strip(), name
    for name in ("no-sidebar", "readings", "header-note", "commentary", "badge", "navy", "with-ads-free-text"):
        page = f'<article><p>{TEXT}</p><div class="{name}"><p>Stays here.</p></div></article>'
        assert html_text.extract(page) == f"{TEXT.strip()}\nStays here.", name


def test_shared_passages_stay(spark):
    """Half of a host's articles quote the same lines, and some share a box of data; links and boxes at the end that recur are the site's."""
    quote, data = "<div><blockquote>To be or not to be, that is the question.</blockquote></div>", "<div><p>Common ground of several articles.</p></div>"
    more = "<div><a href='/a'>Read also: another story</a> <a href='/b'>One more</a></div>"
    page = lambda i: f"<article><h1>T{i}</h1>{more}<p>{'own ' * 40}{i}</p>{data if i % 2 else ''}<p>then {i}</p>{quote if i < 10 else ''}<div><b>Follow us</b><p>Now!</p></div></article>"
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame([(i, f"http://n.example/{i}", page(i)) for i in range(20)], COLUMNS)).collect()}
    for i, text in got.items():
        want = [f"T{i}", "own " * 40 + str(i), *(["Common ground of several articles."] if i % 2 else []), f"then {i}", *(["To be or not to be, that is the question."] if i < 10 else [])]
        assert text == "\n".join(want)


def test_a_small_article_is_not_the_page():
    """An element named article that holds next to nothing of what is left is a teaser."""
    page = f"<body><article><p>Teaser.</p></article><div><p>{TEXT * 3}</p></div></body>"
    assert html_text.extract(page) == f"Teaser.\n{(TEXT * 3).strip()}"
    assert html_text.extract(f"<body><div><p>Outside.</p></div><article><p>{TEXT}</p></article></body>") == TEXT.strip()


def test_templates_are_found_without_the_article_tag(spark):
    """Pages of plain divs: only counting can tell the site's parts from the text."""
    page = lambda i: f"<body><div><div><p>Welcome to our site</p><p>Since 1990</p></div><div><p>{'own ' * 50}{i}</p><p>second {i}</p></div><div><p>All rights reserved by us</p></div></div></body>"
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame([(i, f"http://d.example/{i}", page(i)) for i in range(12)], COLUMNS)).collect()}
    assert all(text == f"{'own ' * 50}{i}\nsecond {i}" for i, text in got.items())
