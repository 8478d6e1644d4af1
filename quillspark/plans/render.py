"""Final reports and their forms: Markdown, HTML, flash cards, sources as JSON."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.media import fmt_duration, fmt_timestamp, video_url
from ..functions.text import esc, kind_label, reliability_label, slugify
from ..functions.urls import safe_url
from ..operators.citations import apply_mapping, renumber


def finalize(texts: DataFrame, sources: DataFrame, report: list[str], order: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts with numbers for ids, refs: report, n and the source, consulted: the sources not cited)."""
    numbers = renumber(texts, report, order)
    mapping = numbers.groupBy(*report).agg(F.map_from_entries(F.collect_list(F.struct("id", "n"))).alias("_m"))
    empty = F.create_map().cast("map<bigint,int>")
    done = texts.join(mapping, report, "left").withColumn("text", apply_mapping(F.col("text"), F.coalesce("_m", empty))).drop("_m")
    refs = sources.join(numbers, [*report, "id"])
    consulted = sources.join(numbers, [*report, "id"], "left_anti")
    return done, refs, consulted


def video_meta(publisher: Column, seconds: Column, date: Column, views: Column) -> Column:
    return F.concat_ws(" · ", F.nullif(publisher, F.lit("")), fmt_duration(seconds), F.nullif(date, F.lit("")), F.when(views > 0, F.concat(F.format_number(views, 0), F.lit(" views"))))


def ref_line(n: Column, s: Column) -> Column:
    """One line of Markdown for a source (a struct); n may be null."""
    nz = lambda c: F.nullif(F.coalesce(s[c], F.lit("")), F.lit(""))
    where = F.nullif(F.concat_ws(", ", nz("publisher"), nz("date")), F.lit(""))
    bits = F.concat_ws(" ", F.concat(F.lit("**"), s["title"], F.lit("**")), F.concat(F.lit("— "), where), F.concat(F.lit("("), nz("authors"), F.lit(")")))
    label = kind_label(s["kind"])
    kind = F.when(s["provider"].isin("", "Web"), label).otherwise(F.concat(label, F.lit(", via "), s["provider"]))
    link = safe_url(s["url"])
    return F.concat(F.coalesce(F.concat(n.cast("string"), F.lit(". ")), F.lit("- ")), bits, F.lit(". *"), kind, F.lit("; reliability (heuristic): "), reliability_label(s["trust"]), F.lit(".*"), F.when(link == "", "").otherwise(F.concat(F.lit(" <"), link, F.lit(">"))))


SOURCE = "struct<title:string,publisher:string,date:string,authors:string,kind:string,provider:string,url:string,trust:double>"
#: A whole report, a row each: what markdown() and html_body() read.
REPORT = (
    "topic string, generated string, level string, depth string, mode string, tldr string, glossary array<struct<term:string,definition:string>>, sections array<struct<key:string,title:string,body:string>>, "
    "videos array<struct<title:string,url:string,publisher:string,seconds:bigint,date:string,views:bigint,video_id:string,basis:string,summary:string,points:array<struct<second:bigint,text:string>>>>, "
    f"quiz array<struct<question:string,answer:string>>, next array<struct<topic:string,why:string>>, refs array<struct<n:int,source:{SOURCE}>>, consulted array<{SOURCE}>, "
    "models array<string>, verification array<string>, warnings array<string>")
# The wording of reports.
BASIS = {"transcript": "summary from the video's transcript", "description": "summary based on the video description only; transcript not available"}
MODES = {"llm": "Written by a language model from the retrieved sources only.", "extractive": "Assembled as sourced excerpts, without a language model (none was available)."}
NOTES = [
    "Every claim should carry a numbered citation. Citations to sources that were not provided are removed automatically. Source reliability labels are a rough domain-based heuristic, not a fact-check.",
    "Paper entries are abstracts, not full texts. News entries are headlines and snippets.",
    "Verify anything important against the linked sources before relying on it."]

HTML_NOTES = [
    "Every claim should carry a numbered citation; citations to sources that were not provided are removed automatically. Reliability labels are a rough domain-based heuristic, not a fact-check.",
    "Paper entries are abstracts, news entries are headlines and snippets. Verify anything important against the linked sources."]


def _cat(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _chosen(words: dict[str, str], key: Column, other: str) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in words.items() for x in kv))[key], F.lit(words[other]))


def _part(head: str, lines: Column, always: bool = False) -> Column:
    """A heading and lines, with a blank line after each; nothing if there are no lines."""
    made = F.concat(F.array(F.lit(head), F.lit("")), lines, F.array(F.lit("")))
    return made if always else F.when(F.size(lines) > 0, made).otherwise(F.array().cast("array<string>"))


def _video_lines(v: Column) -> Column:
    title = F.translate(v["title"], "[]", "()")
    about = _cat("*", video_meta(v["publisher"], F.coalesce(v["seconds"], F.lit(0)), v["date"], v["views"]), " · ", _chosen(BASIS, v["basis"], "description"), "*")
    stamp = lambda p: F.when(F.coalesce(v["video_id"], F.lit("")) == "", fmt_timestamp(p["second"])).otherwise(_cat("[", fmt_timestamp(p["second"]), "](", safe_url(video_url(v["video_id"], p["second"])), ")"))
    moments = F.transform(v["points"], lambda p: _cat("- ", stamp(p), " ", p["text"]))
    return F.concat(F.array(_cat("### [", title, "](", safe_url(v["url"]), ")"), about, F.lit(""), v["summary"], F.lit("")), _part("Key moments:", moments))


def markdown() -> Column:
    """The Markdown of a report, of the columns of REPORT: everything that it has, in the fixed order of parts."""
    c = F.col
    head = F.array(_cat("# ", c("topic")), F.lit(""), _cat("*Learning briefing · ", c("generated"), " · ", c("level"), " level · ", c("depth"), " depth · ", F.size("refs").cast("string"), " sources cited*"), F.lit(""))
    short = F.transform(F.split(_cat("**TL;DR** ", c("tldr")), "\n"), lambda x: F.when(F.trim(x) == "", ">").otherwise(_cat("> ", x)))
    none = F.array().cast("array<string>")
    models = F.when(F.size("models") > 0, _cat(" Models: ", F.array_join("models", ", "), ".")).otherwise("")
    about = F.concat(
        F.array(_cat("- ", _chosen(MODES, c("mode"), "extractive"), models), *(F.lit(f"- {n}") for n in NOTES)),
        F.transform("verification", lambda x: _cat("- **Check:** ", x)), F.transform("warnings", lambda x: _cat("- *Run note:* ", x)))
    cited = F.when(F.size("refs") > 0, F.transform("refs", lambda r: ref_line(r["n"], r["source"]))).otherwise(F.array(F.lit("*No sources were cited.*")))
    quiz = F.flatten(F.transform("quiz", lambda q, i: F.array(_cat((i + 1).cast("string"), ". ", q["question"]), _cat("   <details><summary>Answer</summary>", esc(q["answer"]), "</details>"), F.lit(""))))
    parts = [
        head, F.when(F.coalesce("tldr", F.lit("")) == "", none).otherwise(F.concat(short, F.array(F.lit("")))),
        _part("## Key terms", F.transform("glossary", lambda g: _cat("- **", g["term"], "**: ", g["definition"]))),
        F.flatten(F.transform("sections", lambda s: F.array(_cat("## ", s["title"]), F.lit(""), s["body"], F.lit("")))),
        F.when(F.size("videos") > 0, F.concat(F.array(F.lit("## Videos to watch"), F.lit("")), F.flatten(F.transform("videos", _video_lines)))).otherwise(none),
        F.when(F.size("quiz") > 0, F.concat(F.array(F.lit("## Test yourself"), F.lit("")), quiz)).otherwise(none),
        _part("## Where to go next", F.transform("next", lambda t: _cat("- **", t["topic"], "**: ", t["why"]))),
        _part("## References", cited, always=True),
        _part("### Also consulted (retrieved but not cited in the text)", F.transform("consulted", lambda s: ref_line(F.lit(None), s))),
        _part("## About this briefing", about)]
    return _cat(F.regexp_replace(F.array_join(F.concat(*parts), "\n"), r"(?U)\s+\z", ""), "\n")


def anki(reports: DataFrame, cards: DataFrame, report: list[str]) -> DataFrame:
    """report, tsv: cards (report, part, ord, front, back), the terms' first."""
    clean = lambda c: F.replace(F.replace(F.regexp_replace(c, r"\s*\[\d+\]", ""), F.lit("\t"), F.lit(" ")), F.lit("\n"), F.lit("<br>"))
    rows = cards.join(reports.select(*report, slugify(F.col("topic"), 30).alias("tag")), report)
    line = F.concat_ws("\t", F.when(F.col("part") == 0, esc(F.col("front"))).otherwise(esc(clean(F.col("front")))), esc(clean(F.col("back"))), "tag")
    body = rows.groupBy(*report).agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "ord", line.alias("line")))), lambda r: r["line"]).alias("_l"))
    head = F.array(F.lit("#separator:tab"), F.lit("#html:true"), F.lit("#tags column:3"))
    return reports.select(*report).join(body, report, "left").select(*report, F.concat(F.array_join(F.concat(head, F.coalesce("_l", F.array().cast("array<string>"))), "\n"), F.lit("\n")).alias("tsv"))


def sources_json(sources: DataFrame, numbers: DataFrame, report: list[str]) -> DataFrame:
    """A row for each source with its number (null if not cited), cited ones first by number, others in input order."""
    from pyspark.sql import Window

    rows = sources.join(numbers, [*report, "id"], "left")
    w = Window.partitionBy(*report).orderBy(F.col("n").isNull(), "n", "ord")
    fields = ["n", "cited", "title", "url", "publisher", "provider", "kind", "date", "authors", "reliability_heuristic"]
    rows = rows.withColumns({"cited": F.col("n").isNotNull(), "reliability_heuristic": reliability_label(F.col("trust")), "place": F.row_number().over(w)})
    fields += ["retrieved"] if "retrieved" in rows.columns else []
    return rows.select(*report, "place", *fields, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


# Fixed value: the small part of Markdown that is understood.
_MARKS = re.compile(r"`(?P<code>[^`]+)`|\[(?P<name>[^\]]+)\]\((?P<link>https?://[^)\s\"']+)\)|\*\*(?P<bold>.+?)\*\*|(?<![*\w])\*(?!\s)(?P<slant>.+?)(?<!\s)\*(?![*\w])|\[(?P<cite>\d+)\]")


def _esc(text: str) -> str:
    """As esc() of a column."""
    return html.escape(text).replace("&#x27;", "&#39;")


def _inline(text: str, refs) -> str:
    """Escaped text with code, links, bold, italics and citations; ``[n]`` without a source stays as it is."""
    out, at = [], 0
    for m in _MARKS.finditer(text):
        out.append(_esc(text[at:m.start()]))
        at = m.end()
        if m["code"] is not None:
            out.append(f"<code>{_esc(m['code'])}</code>")
        elif m["link"]:
            out.append(f'<a href="{_esc(m["link"])}" target="_blank" rel="noopener noreferrer">{_inline(m["name"], refs)}</a>')
        elif m["bold"]:
            out.append(f"<strong>{_inline(m['bold'], refs)}</strong>")
        elif m["slant"]:
            out.append(f"<em>{_inline(m['slant'], refs)}</em>")
        else:
            out.append(f'<a class="cite" href="#ref-{m["cite"]}">[{m["cite"]}]</a>' if int(m["cite"]) in refs else m.group())
    return "".join(out) + _esc(text[at:])


def markdown_to_html(text: str | None, refs=None) -> str:
    """Headings, lists, quotes and paragraphs of a small part of Markdown, all else escaped."""
    out, items, kind, para = [], [], None, []
    refs = refs or {}

    def close() -> None:
        nonlocal items, kind, para
        if para:
            out.append(f"<p>{_inline(' '.join(para), refs)}</p>")
        if items:
            out.append(f"<{kind}>" + "".join(f"<li>{_inline(i, refs)}</li>" for i in items) + f"</{kind}>")
        items, kind, para = [], None, []

    for line in (text or "").split("\n"):
        if m := re.match(r"(#{1,6})\s+(.*)", line):
            close()
            out.append(f"<h{len(m[1])}>{_inline(m[2], refs)}</h{len(m[1])}>")
        elif m := re.match(r"\s*([-*]|\d+[.)])\s+(.*)", line):
            now = "ul" if m[1] in "-*" else "ol"
            if kind != now:
                close()
                kind = now
            items.append(m[2])
        elif m := re.match(r">\s?(.*)", line):
            close()
            out.append(f"<blockquote>{_inline(m[1], refs)}</blockquote>")
        elif not line.strip():
            close()
        else:
            if items:
                close()
            para.append(line.strip())
    close()
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def html_of(texts: pd.Series) -> pd.Series:
    return texts.map(markdown_to_html)


@F.pandas_udf(T.StringType())
def _html_parts(bodies: pd.Series, refs: pd.Series) -> pd.Series:
    return pd.Series([markdown_to_html(b, set() if r is None else {int(x) for x in r}) for b, r in zip(bodies, refs)])


@F.pandas_udf(T.StringType())
def _html_line(texts: pd.Series, refs: pd.Series) -> pd.Series:
    return pd.Series([_inline((t or "").replace("\n", " "), set() if r is None else {int(x) for x in r}) for t, r in zip(texts, refs)])


_AWAY = ' target="_blank" rel="noopener noreferrer"'


def _item(n: Column | None, s: Column) -> Column:
    """A source as an item of a list."""
    nz = lambda c: F.nullif(F.coalesce(s[c], F.lit("")), F.lit(""))
    where = F.nullif(F.concat_ws(", ", nz("publisher"), nz("date")), F.lit(""))
    via = F.when(s["provider"].isin("", "Web"), "").otherwise(_cat(" via ", esc(s["provider"])))
    bits = F.concat_ws(
        " ", _cat('<a href="', esc(safe_url(s["url"])), f'"{_AWAY}><strong>', esc(s["title"]), "</strong></a>"), _cat("— ", esc(where)), _cat("(", esc(nz("authors")), ")"),
        _cat('<span class="small">', esc(kind_label(s["kind"])), via, "; reliability (heuristic): ", reliability_label(s["trust"]), "</span>"))
    return _cat("<li>" if n is None else _cat('<li id="ref-', n.cast("string"), '">'), bits, "</li>")


def _tagged(head: str, open_: str, items: Column, close: str) -> Column:
    return F.when(F.size(items) > 0, _cat(head, open_, F.array_join(items, ""), close)).otherwise("")


def html_body(reports: DataFrame, key: list[str]) -> DataFrame:
    """key, html: the escaped body of each report (the columns of REPORT). Only texts with Markdown go through Python: one row for each of them."""
    numbers = F.transform("refs", lambda r: r["n"])
    cells = F.concat(
        F.array(F.struct(F.lit(0).alias("part"), F.lit(0).alias("ord"), F.coalesce("tldr", F.lit("")).alias("text"))), F.transform("glossary", lambda g, i: F.struct(F.lit(1).alias("part"), i.alias("ord"), g["definition"].alias("text"))),
        F.transform("sections", lambda s, i: F.struct(F.lit(2).alias("part"), i.alias("ord"), s["body"].alias("text"))), F.transform("videos", lambda v, i: F.struct(F.lit(3).alias("part"), i.alias("ord"), v["summary"].alias("text"))))
    told = reports.select(*key, numbers.alias("_n"), F.explode(cells).alias("x")).select(*key, "x.part", "x.ord", F.when(F.col("x.part") == 2, _html_parts("x.text", "_n")).otherwise(_html_line("x.text", "_n")).alias("html"))
    met = told.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct((F.col("part") * 1_000_000 + F.col("ord")).alias("at"), "html"))).alias("_h"))
    made = lambda part, i: F.element_at("_h", F.lit(part * 1_000_000) + i)
    c = F.col

    def video(v: Column, i: Column) -> Column:
        link = lambda url, text: _cat('<a href="', esc(safe_url(url)), f'"{_AWAY}>', text, "</a>")
        stamp = lambda p: F.when(F.coalesce(v["video_id"], F.lit("")) == "", fmt_timestamp(p["second"])).otherwise(link(video_url(v["video_id"], p["second"]), fmt_timestamp(p["second"])))
        about = _cat(video_meta(v["publisher"], F.coalesce(v["seconds"], F.lit(0)), v["date"], v["views"]), " · ", _chosen(BASIS, v["basis"], "description"))
        points = _tagged("<p class='small'>Key moments</p>", "<ul>", F.transform(v["points"], lambda p: _cat("<li>", stamp(p), " ", esc(p["text"]), "</li>")), "</ul>")
        return _cat('<div class="video"><h3>', link(v["url"], esc(v["title"])), '</h3><p class="small">', esc(about), "</p><p>", made(3, i), "</p>", points, "</div>")

    models = F.when(F.size("models") > 0, F.array(_cat("Models: ", F.array_join("models", ", ")))).otherwise(F.array().cast("array<string>"))
    notes = F.concat(F.array(*map(F.lit, HTML_NOTES)), models, F.transform("verification", lambda x: _cat("Check: ", x)), F.transform("warnings", lambda x: _cat("Run note: ", x)))
    body = _cat(
        "<h1>", esc(c("topic")), '</h1><p class="meta">Learning briefing · ', esc(c("generated")), " · ", esc(c("level")), " level · ", esc(c("depth")), " depth · ", F.size("refs").cast("string"), " sources cited</p>",
        F.when(F.coalesce("tldr", F.lit("")) == "", "").otherwise(_cat('<div class="tldr"><strong>TL;DR</strong> ', made(0, F.lit(0)), "</div>")),
        _tagged('<h2 id="sec-terms">Key terms</h2>', '<dl class="terms">', F.transform("glossary", lambda g, i: _cat("<dt>", esc(g["term"]), "</dt><dd>", made(1, i), "</dd>")), "</dl>"),
        F.array_join(F.transform("sections", lambda s, i: _cat('<h2 id="sec-', esc(s["key"]), '">', esc(s["title"]), "</h2>", made(2, i))), ""),
        _tagged('<h2 id="sec-videos">Videos to watch</h2>', "", F.transform("videos", video), ""),
        _tagged('<h2 id="sec-quiz">Test yourself</h2>', "<ol>", F.transform("quiz", lambda q: _cat("<li>", esc(q["question"]), "<details><summary>Answer</summary>", esc(q["answer"]), "</details></li>")), "</ol>"),
        _tagged('<h2 id="sec-next">Where to go next</h2>', '<ul class="next">', F.transform("next", lambda t: _cat("<li><strong>", esc(t["topic"]), "</strong>: ", esc(t["why"]), "</li>")), "</ul>"),
        "<h2 id=\"sec-refs\">References</h2><ol class='refs'>", F.array_join(F.transform("refs", lambda r: _item(r["n"], r["source"])), ""), "</ol>",
        _tagged("<h3>Also consulted (retrieved but not cited)</h3>", "<ul class='refs'>", F.transform("consulted", lambda s: _item(None, s)), "</ul>"),
        "<h2 id=\"sec-about\">About this briefing</h2><ul class='small'>", F.array_join(F.transform(notes, lambda n: _cat("<li>", esc(n), "</li>")), ""), "</ul>")
    return reports.join(met, key).select(*key, body.alias("html"))


# Fixed value: what follows the topic in a document's title.
TITLE_END = " – learning briefing"


def document(title: Column, body: Column, style: str = "body{max-width:46rem;margin:auto;padding:2rem;font:17px/1.6 serif}") -> Column:
    """A document of its own around an HTML body."""
    return _cat('<!doctype html><html lang="en"><head><meta charset="utf-8"><meta name="viewport" content="width=device-width,initial-scale=1"><title>', esc(title), f"{TITLE_END}</title><style>{style}</style></head><body><main>", body, "</main></body></html>")
