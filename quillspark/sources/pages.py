"""HTML pages: text of snippets, main text of articles, search results, videos in page data, robots rules."""

from __future__ import annotations

import html
import json
import re
from html.parser import HTMLParser
from urllib.parse import parse_qs, urljoin, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements whose text isn't the article's, and elements that never hold others.
_SKIPPED = frozenset("script style nav footer header aside form noscript svg iframe button select".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = {"h1", "h2", "h3", "h4", "p", "li"}
_S = T.StringType()
PAGE = T.StructType([T.StructField(n, _S) for n in ("title", "date", "text")])
RESULTS = T.ArrayType(T.StructType([T.StructField(n, _S) for n in ("href", "title", "body")]))
VIDEOS = T.ArrayType(T.StructType([T.StructField(n, T.LongType() if n == "views" else _S) for n in ("video_id", "title", "channel", "length", "published", "views", "text")]))


def _squash(text: str) -> str:
    return " ".join(text.split())


class _Reader(HTMLParser):
    """One pass: title and date candidates, and the blocks of the article, main and body parts."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.title, self.time, self.in_title = "", "", False
        self.stack: list[str] = []
        self.open: list[tuple[str, list[str], tuple[str, ...]]] = []
        self.blocks: list[tuple[str, str, tuple[str, ...]]] = []
        self.seen_roots: set[str] = set()

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            self.meta.setdefault(a.get("property") or a.get("name") or a.get("itemprop") or "", a.get("content", ""))
        elif tag == "time" and not self.time:
            self.time = a.get("datetime", "")
        elif tag == "title":
            self.in_title = not self.title
        if tag in _VOID:
            self._text(" ") if tag == "br" else None
            return
        if tag in _BLOCKS or tag in ("ul", "ol", "div", "table", "section", "article"):
            self._close({"p"})
        if tag == "li":
            self._close({"li"})
        self.stack.append(tag)
        self.seen_roots |= {tag} & {"article", "main"}
        if tag in _BLOCKS and not _SKIPPED & set(self.stack):
            self.open.append((tag, [], tuple(t for t in ("article", "main") if t in self.stack)))

    def _close(self, tags: set[str]) -> None:
        while self.open and self.open[-1][0] in tags and self.stack and tags & set(self.stack):
            tag = self.open[-1][0]
            while self.stack and self.stack.pop() != tag:
                pass
            self._end_block()

    def _end_block(self) -> None:
        tag, parts, roots = self.open.pop()
        self.blocks.append((tag, _squash("".join(parts)), roots))

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in self.stack:
            while self.stack:
                last = self.stack.pop()
                if self.open and self.open[-1][0] == last:
                    self._end_block()
                if last == tag:
                    break

    def _text(self, data: str) -> None:
        for _, parts, _ in self.open:
            parts.append(data)

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not _SKIPPED & set(self.stack):
            self._text(data)


def extract_page(page: str | None, least: int = 40) -> tuple[str, str, str]:
    """(title, date, text): headings as ``== x ==``, paragraphs and list items of 40 characters or more, each once."""
    r = _Reader()
    r.feed(page or "")
    r.close()
    while r.open:
        r._end_block()
    title = _squash(r.meta.get("og:title") or r.title)
    date = next((r.meta[k] for k in ("article:published_time", "date", "datePublished") if r.meta.get(k)), r.time)
    root = next((t for t in ("article", "main") if t in r.seen_roots), None)
    out: list[str] = []
    for tag, text, roots in r.blocks:
        if root is not None and root not in roots:
            continue
        if tag[0] == "h":
            if text:
                out.append(f"== {text} ==")
        elif len(text) >= least and text not in out:
            out.append(text)
    return title, date, "\n\n".join(out)


@F.arrow_udf(PAGE)
def page_text(pages: pa.Array) -> pa.Array:
    """A batch's pages become strings of Python one by one, not all beside their texts."""
    return pa.array((dict(zip(("title", "date", "text"), extract_page(p.as_py()))) for p in pages), pa.struct([(n, pa.string()) for n in ("title", "date", "text")]))


@F.pandas_udf(_S)
def _html_to_text(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else _squash(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", v)))))


def html_to_text(value: Column) -> Column:
    """Text of an HTML snippet in one line."""
    return _html_to_text(value)


def search_target(href: str, base: str) -> str:
    """What a result's link leads to: the address in its redirect parameter, if it has one."""
    url = urljoin(base, html.unescape(href))
    return parse_qs(urlsplit(url).query).get("uddg", [url])[0]


def parse_results(page: str | None, base: str = "https://duckduckgo.com") -> list[tuple[str, str, str]]:
    """(href, title, body) of the results in a search page, without advertisements."""
    out = []
    for block in re.split(r'(?=<div[^>]*class="[^"]*\bresult\b)', page or "")[1:]:
        head = re.match(r'<div[^>]*class="([^"]*)"', block)
        link = re.search(r'<a[^>]*class="[^"]*result__a[^"]*"[^>]*href="([^"]*)"[^>]*>(.*?)</a>', block, re.S)
        if link is None or "result--ad" in head.group(1):
            continue
        body = re.search(r'class="[^"]*result__snippet[^"]*"[^>]*>(.*?)</a>', block, re.S)
        text = lambda x: _squash(html.unescape(re.sub(r"<[^>]*>", "", x)))
        out.append((search_target(link.group(1), base), text(link.group(2)), text(body.group(1)) if body else ""))
    return out


def parse_lite(page: str | None, base: str = "https://duckduckgo.com") -> list[tuple[str, str, str]]:
    """(href, title, body) of the plain search page: links, each with the snippet that stands before the next link."""
    parts = re.split(r"(?=<a\b[^>]*\bresult-link\b)", page or "")[1:]
    text = lambda x: _squash(html.unescape(re.sub(r"<[^>]*>", "", x)))
    out = []
    for part in parts:
        href = re.search(r"""href=["']([^"']*)["']""", part)
        name = re.match(r"(?s)<a\b[^>]*>(.*?)</a>", part)
        body = re.search(r"""(?s)class=["'][^"']*result-snippet[^"']*["'][^>]*>(.*?)</td>""", part)
        if href and name:
            out.append((search_target(href[1], base), text(name[1]), text(body[1]) if body else ""))
    return out


@F.pandas_udf(RESULTS)
def lite_results(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: [{"href": h, "title": t, "body": b} for h, t, b in parse_lite(p)])


def asks_for_captcha(page: Column) -> Column:
    return page.rlike("(?i)anomaly|captcha|unusual traffic")


@F.pandas_udf(RESULTS)
def search_results(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: [{"href": h, "title": t, "body": b} for h, t, b in parse_results(p)])


def json_after(text: str, marker: str) -> dict | None:
    """The JSON object after a marker in a page."""
    at = text.find(marker)
    at = text.find("{", at) if at >= 0 else -1
    try:
        return json.JSONDecoder().raw_decode(text, at)[0] if at >= 0 else None
    except ValueError:
        return None


def _runs(x) -> str:
    x = x or {}
    return x.get("simpleText") or "".join(r.get("text", "") for r in x.get("runs", []))


def parse_videos(page: str | None) -> list[dict]:
    """Videos anywhere in the data of a results page, each id once."""
    found: dict[str, dict] = {}
    todo = [json_after(page or "", "ytInitialData")]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            v = x.get("videoRenderer")
            if isinstance(v, dict) and v.get("videoId") and _runs(v.get("title")):
                views = re.sub(r"\D", "", _runs(v.get("viewCountText")))
                found.setdefault(v["videoId"], {"video_id": v["videoId"], "title": _runs(v.get("title")), "channel": _runs(v.get("ownerText")), "length": _runs(v.get("lengthText")), "published": _runs(v.get("publishedTimeText")), "views": int(views or 0), "text": "".join(_runs(s.get("snippetText")) for s in v.get("detailedMetadataSnippets", []))})
            todo += reversed(list(x.values()))
        elif isinstance(x, list):
            todo += reversed(x)
    return list(found.values())


@F.pandas_udf(VIDEOS)
def videos(pages: pd.Series) -> pd.Series:
    return pages.map(parse_videos)


def robots_lines(robots: DataFrame) -> DataFrame:
    """origin, pos, field, value, part: the field lines of robots.txt bodies (origin, body); a part begins with the first of adjacent agent lines. 0: before any."""
    line = r"^([A-Za-z-]+)\s*:\s*(.*)$"
    raw = robots.select("origin", F.posexplode(F.split(F.coalesce("body", F.lit("")), r"\r?\n")).alias("pos", "raw")).withColumn("raw", F.trim(F.regexp_replace("raw", "#.*", ""))).where(F.col("raw").rlike(line))
    fields = raw.select("origin", "pos", F.lower(F.regexp_extract("raw", line, 1)).alias("field"), F.trim(F.regexp_extract("raw", line, 2)).alias("value"))
    w = Window.partitionBy("origin").orderBy("pos")  # a file's lines
    begins = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(w), F.lit("")) != "user-agent")
    return fields.withColumn("_b", begins.cast("int")).withColumn("part", F.sum("_b").over(w)).drop("_b")


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """origin, allow, pattern: the rules for an agent, of the first part that names it, else of the first for ``*``. A part without rules allows all."""
    lines = robots_lines(robots)
    at = lambda name: F.min(F.when(F.lower("value") == name, F.col("part")))
    mine = lines.where("field = 'user-agent'").groupBy("origin").agg(F.coalesce(at(agent.lower()), at("*")).alias("part")).where("part is not null")
    rules = lines.where("field in ('allow', 'disallow') and value <> '' and part > 0").select("origin", "part", (F.col("field") == "allow").alias("allow"), F.col("value").alias("pattern"))
    return rules.join(mine, ["origin", "part"]).drop("part")


def pattern_regex(pattern: Column) -> Column:
    """Regular expression of a robots pattern: ``*`` stands for anything, a last ``$`` for the end, and it matches from the start."""
    quoted = F.regexp_replace(F.regexp_replace(pattern, r"\$\z", ""), r"([\\^$.|?+()\[\]{}])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(quoted, r"\*", ".*"), F.when(pattern.endswith("$"), r"\z").otherwise(""))


def allowed_by_robots(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """urls (origin, path) with allowed: the longest rule for the agent; ties allow, as do missing rules.

    A rule can only match paths that begin with its literal part, what stands before the first ``*`` or a last ``$``. Each path is cut to the lengths
    that literal parts of its origin have, and meets rules by equality with these prefixes; only then are wildcards looked at. So rules
    and paths of an origin never form a product, but for rules that begin with a wildcard.
    """
    literal = F.regexp_extract(F.regexp_replace("pattern", r"\$\z", ""), r"^[^*]*", 0)
    rules = robots_rules(robots, agent).distinct().withColumns({"_prefix": literal, "_wild": F.col("pattern").contains("*") | F.col("pattern").endswith("$")})
    lengths = rules.groupBy("origin").agg(F.collect_set(F.length("_prefix")).alias("_lengths"))  # as many as a path has characters, at most
    asked = urls.select("origin", "path").distinct().join(lengths, "origin")
    cut = asked.select("origin", "path", F.explode(F.filter("_lengths", lambda n: n <= F.length("path"))).alias("_n")).withColumn("_prefix", F.expr("left(path, _n)"))
    met = cut.join(rules, ["origin", "_prefix"]).where(~F.col("_wild") | F.rlike("path", pattern_regex(F.col("pattern"))))
    best = met.groupBy("origin", "path").agg(F.max_by("allow", F.struct(F.length("pattern"), "allow")).alias("allow"))
    return urls.join(best, ["origin", "path"], "left").withColumn("allowed", F.coalesce("allow", F.lit(True))).drop("allow")


def page_gate(pages: DataFrame, url: str = "url", robots: DataFrame | None = None, agent: str = "*") -> DataFrame:
    """Pages worth reading by their address alone: public hosts, no binary files, and none that robots rules (origin, body) refuse. Done before any page is parsed."""
    from ..functions.urls import is_binary, is_private_host, origin, path_query

    able = pages.where(~is_private_host(F.col(url)) & ~is_binary(F.col(url)))
    if robots is None:
        return able
    asked = able.select(F.col(url), origin(F.col(url)).alias("origin"), path_query(F.col(url)).alias("path")).distinct()
    return able.join(allowed_by_robots(asked, robots, agent).where("not allowed").select(url), url, "left_anti")


def readable(pages: DataFrame, url: str = "url", robots: DataFrame | None = None, agent: str = "*", most: int = 20_000) -> DataFrame:
    """Captured pages (url, html) that pass the gate and aren't dead, with title, date and text cut to the fixed size of pages."""
    from ..functions.safety import looks_dead

    parsed = page_gate(pages, url, robots, agent).withColumn("_p", page_text(F.col("html")))
    text = F.substring(F.trim("_p.text"), 1, most)
    return parsed.withColumns({"title": F.col("_p.title"), "date": F.col("_p.date"), "text": text}).drop("_p").where(~looks_dead(F.col("text")))
