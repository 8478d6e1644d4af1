"""Parsers of captured payloads: rows (topic_id, body) in, Sources out. No payload throws; what doesn't parse gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.media import parse_date
from ..functions.text import authors_line, clean_wiki_extract, keyword_terms, squash
from ..functions.urls import with_trust
from .pages import html_to_text

# Publishers where a payload names none.
PREPRINTS, NEWS = "arXiv (preprint, not peer-reviewed)", "Google News"
SOURCE = ["topic_id", "pos", "kind", "provider", "title", "url", "text", "date", "authors", "publisher"]


def http_key(method: str, url: Column, body: Column | None = None) -> Column:
    return F.concat(F.lit(method + " "), url, F.lit("") if body is None else F.coalesce(F.concat(F.lit(" "), body), F.lit("")))


def responses(payloads: DataFrame, max_bytes: int = 2_000_000) -> DataFrame:
    """Captured answers that succeeded, cut to a size."""
    return payloads.where(F.col("status").between(200, 299)).withColumn("body", F.substring("body", 1, max_bytes))


def _sources(rows: DataFrame, kind: str, provider: str, **columns: Column) -> DataFrame:
    blank = F.lit("")
    return rows.select(
        "topic_id", F.col("pos").cast("long").alias("pos"), F.lit(kind).alias("kind"), F.lit(provider).alias("provider"),
        *(F.coalesce(columns.get(c, blank), blank).alias(c) for c in SOURCE[4:]), *(v.alias(k) for k, v in columns.items() if k not in SOURCE))


def _trusted(sources: DataFrame, least: float = 0.0) -> DataFrame:
    found = with_trust(sources, "url").drop("host", "blocked")
    return found.withColumn("trust", F.greatest(F.lit(least), "trust"))


def _first(rows: DataFrame, most: int) -> DataFrame:
    """The first accepted rows of each topic, with their places among these."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("topic_id").orderBy("pos")) - 1).where(F.col("pos") < most)


#: Fixed value: of a plan's queries the encyclopedia is asked the first ones.
WIKI_QUERIES = 2


def wikipedia(payloads: DataFrame, most: int) -> DataFrame:
    """Articles of extract answers (topic_id, ord, body, and query_ord where known), without empty and disambiguation pages and those of later queries."""
    schema = "struct<query:struct<pages:map<string,struct<pageid:long,title:string,fullurl:string,extract:string,touched:string>>>>"
    payloads = payloads.where(F.col("query_ord") < WIKI_QUERIES) if "query_ord" in payloads.columns else payloads
    pages = payloads.select("topic_id", "ord", F.explode(F.from_json("body", schema)["query"]["pages"]).alias("k", "p"))
    text = clean_wiki_extract(F.col("p.extract"))
    good = pages.withColumn("text", text).where((F.col("text") != "") & ~F.lower(F.substring("text", 1, 250)).contains("may refer to"))
    from ..operators.dedup import first_of_each

    first = first_of_each(good, ["topic_id", "p.title"], ["ord", "k"])
    placed = first.withColumn("pos", F.row_number().over(Window.partitionBy("topic_id").orderBy("ord", "k"))).where(F.col("pos") <= most)
    url = F.coalesce("p.fullurl", F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.replace("p.title", F.lit(" "), F.lit("_"))))
    return _trusted(_sources(placed, "encyclopedia", "Wikipedia", title=F.col("p.title"), url=url, text=F.col("text"), date=F.substring(F.coalesce("p.touched", F.lit("")), 1, 10), publisher=F.lit("Wikipedia")))


def arxiv_query(topic: Column) -> Column:
    return F.array_join(F.transform(keyword_terms(topic, 5), lambda t: F.concat(F.lit("all:"), t)), " AND ")


def arxiv(payloads: DataFrame, most: int) -> DataFrame:
    def at(x: str, name: str) -> Column:
        return squash(F.xpath_string(F.col("e"), F.lit(f"/e/*[local-name()='{name}']")))

    entries = payloads.select("topic_id", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?s)<entry[^>]*>(.*?)</entry>"), F.lit(1))).alias("pos", "e")).withColumn("e", F.concat(F.lit("<e>"), "e", F.lit("</e>")))
    entries = entries.withColumns({"title": at("e", "title"), "summary": at("e", "summary"), "id": F.regexp_replace(at("e", "id"), "^http:", "https:"), "published": at("e", "published"), "names": F.xpath("e", F.lit("/e/*[local-name()='author']/*[local-name()='name']/text()"))})
    good = _first(entries.where("title <> '' and summary <> '' and id <> ''"), most)
    return _trusted(_sources(good, "academic", "arXiv", title=F.col("title"), url=F.col("id"), text=F.col("summary"), date=F.substring("published", 1, 10), authors=authors_line(F.col("names")), publisher=F.lit(PREPRINTS), preprint=F.lit(True)))


def abstract_from_index(index: Column) -> Column:
    """Text of an inverted index (word -> places): of words at one place the later, places without a word left out."""
    flat = F.flatten(F.transform(F.map_entries(index), lambda e, i: F.transform(e["value"], lambda p: F.struct(p.alias("p"), i.alias("i"), e["key"].alias("w")))))
    ordered = F.array_sort(flat)
    last = F.filter(ordered, lambda x, i: (i == F.size(ordered) - 1) | (F.get(ordered, i + 1)["p"] != x["p"]))
    return F.array_join(F.transform(last, lambda x: x["w"]), " ")


def openalex(payloads: DataFrame, most: int) -> DataFrame:
    schema = (
        "struct<results:array<struct<title:string,doi:string,id:string,publication_year:int,cited_by_count:long,type:string,abstract_inverted_index:map<string,array<int>>,"
        "primary_location:struct<landing_page_url:string,source:struct<display_name:string>>,authorships:array<struct<author:struct<display_name:string>>>>>>")
    works = payloads.select("topic_id", F.posexplode(F.from_json("body", schema)["results"]).alias("pos", "w"))
    nz = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    rows = works.select(
        "topic_id", "pos", F.col("w.title").alias("title"), F.coalesce(nz("w.doi"), nz("w.primary_location.landing_page_url"), nz("w.id")).alias("url"), abstract_from_index(F.col("w.abstract_inverted_index")).alias("text"),
        F.col("w.publication_year").cast("string").alias("date"), F.transform("w.authorships", lambda a: a["author"]["display_name"]).alias("names"), F.col("w.primary_location.source.display_name").alias("publisher"), F.col("w.cited_by_count").alias("cited_by"), F.col("w.type").alias("type"))
    good = rows.where("coalesce(title, '') <> '' and coalesce(text, '') <> '' and url is not null")
    best = good.withColumn("_r", F.row_number().over(Window.partitionBy("topic_id").orderBy(F.coalesce("cited_by", F.lit(0)).desc(), "pos"))).where(F.col("_r") <= most).withColumn("pos", F.col("_r"))
    made = _sources(best, "academic", "OpenAlex", title=F.col("title"), url=F.col("url"), text=F.col("text"), date=F.col("date"), authors=authors_line(F.col("names")), publisher=F.col("publisher"), cited_by=F.coalesce("cited_by", F.lit(0)), type=F.col("type"))
    return _trusted(made, 0.8)


def pubmed(payloads: DataFrame) -> DataFrame:
    articles = payloads.select("topic_id", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?s)<PubmedArticle[ >].*?</PubmedArticle>"), F.lit(0))).alias("pos", "x"))
    schema = (
        "struct<MedlineCitation:struct<PMID:struct<_VALUE:string>,Article:struct<ArticleTitle:string,Abstract:struct<AbstractText:array<struct<_VALUE:string,_Label:string>>>,"
        "Journal:struct<Title:string,JournalIssue:struct<PubDate:struct<Year:string,MedlineDate:string>>>,AuthorList:struct<Author:array<struct<LastName:string,Initials:string>>>>>>")
    a = articles.select("topic_id", "pos", F.from_xml("x", schema)["MedlineCitation"].alias("m"), F.xpath_string("x", F.lit("/PubmedArticle/MedlineCitation/PMID")).alias("pmid"))
    part = lambda t: F.concat(F.when(F.coalesce(t["_Label"], F.lit("")) != "", F.concat(F.initcap(F.lower(t["_Label"])), F.lit(": "))).otherwise(""), squash(F.coalesce(t["_VALUE"], F.lit(""))))
    rows = a.select(
        "topic_id", "pos", "pmid", F.col("m.Article.ArticleTitle").alias("title"), F.array_join(F.transform("m.Article.Abstract.AbstractText", part), " ").alias("text"),
        F.coalesce("m.Article.Journal.JournalIssue.PubDate.Year", F.substring("m.Article.Journal.JournalIssue.PubDate.MedlineDate", 1, 4)).alias("date"), F.col("m.Article.Journal.Title").alias("publisher"),
        F.transform("m.Article.AuthorList.Author", lambda p: F.trim(F.concat_ws(" ", p["LastName"], p["Initials"]))).alias("names"))
    good = rows.where("pmid <> '' and coalesce(title, '') <> '' and coalesce(text, '') <> ''")
    return _trusted(_sources(good, "academic", "PubMed", title=F.col("title"), url=F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), "pmid", F.lit("/")), text=F.col("text"), date=F.col("date"), authors=authors_line(F.col("names")), publisher=F.col("publisher"), pmid=F.col("pmid")))


def google_news(payloads: DataFrame, most: int) -> DataFrame:
    items = payloads.select("topic_id", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?s)<item>.*?</item>"), F.lit(0))).alias("pos", "x"))
    at = lambda n: F.coalesce(F.xpath_string("x", F.lit(f"/item/{n}")), F.lit(""))
    rows = items.select("topic_id", "pos", at("title").alias("full"), at("link").alias("url"), at("pubDate").alias("pub"), at("source").alias("publisher"), html_to_text(at("description")).alias("snippet"))
    rows = rows.withColumn("publisher", F.when(F.col("publisher") == "", NEWS).otherwise(F.col("publisher")))
    named = (F.col("publisher") != NEWS) & F.col("full").endswith(F.concat(F.lit(" - "), "publisher"))
    rows = rows.withColumn("title", F.when(named, F.trim(F.expr("substring(full, 1, length(full) - length(publisher) - 3)"))).otherwise(F.col("full")))
    dashes = r"^[\s\u2013\u2014-]+|[\s\u2013\u2014-]+\z"
    rest = F.when(F.col("snippet").startswith(F.col("title")), F.regexp_replace(F.expr("substring(snippet, length(title) + 1)"), dashes, "")).otherwise(F.col("snippet"))
    text = F.when(rest.isin("") | (rest == F.col("publisher")), F.col("title")).otherwise(rest)
    good = _first(rows.where("full <> '' and url <> ''"), most)
    return _sources(good, "news", NEWS, title=F.col("title"), url=F.col("url"), text=text, date=parse_date(F.col("pub")), publisher=F.col("publisher")).withColumn("trust", F.lit(0.6))


def gdelt(payloads: DataFrame, most: int) -> DataFrame:
    """An answer that there were too many requests (429) is empty, not an error."""
    schema = "struct<articles:array<struct<url:string,title:string,seendate:string,domain:string>>>"
    rows = payloads.where("status <> 429").select("topic_id", F.posexplode(F.from_json("body", schema)["articles"]).alias("pos", "a")).where("coalesce(a.url, '') <> '' and coalesce(a.title, '') <> ''").where(F.col("pos") < most)
    made = _sources(rows, "news", "GDELT", title=squash(F.col("a.title")), url=F.col("a.url"), text=squash(F.col("a.title")), date=parse_date(F.col("a.seendate")), publisher=F.coalesce("a.domain", F.lit("GDELT")))
    return _trusted(made, 0.5)


def transcript(body: Column) -> Column:
    """array of struct(start, text) of caption XML, in seconds or in milliseconds."""
    seconds = F.transform(F.regexp_extract_all(body, F.lit(r"(?s)<text[^>]*\bstart=\"[^\"]*\"[^>]*>.*?</text>"), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, r"\bstart=\"([^\"]*)\"", 1).try_cast("double").alias("start"), x.alias("x")))
    millis = F.transform(F.regexp_extract_all(body, F.lit(r"(?s)<p[^>]*\bt=\"[^\"]*\"[^>]*>.*?</p>"), F.lit(0)), lambda x: F.struct((F.regexp_extract(x, r"\bt=\"([^\"]*)\"", 1).try_cast("double") / 1000).alias("start"), x.alias("x")))
    rows = F.transform(F.when(F.size(seconds) > 0, seconds).otherwise(millis), lambda r: F.struct(r["start"].alias("start"), squash(F.regexp_replace(html_unescape(F.regexp_replace(r["x"], "<[^>]*>", " ")), r"\[[^\]]{0,20}\]", " ")).alias("text")))
    return F.filter(rows, lambda r: r["start"].isNotNull() & (r["text"] != ""))


def html_unescape(text: Column) -> Column:
    for sign, raw in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(sign), F.lit(raw))
    return text


def caption_track(tracks: Column) -> Column:
    """Of struct(lang, kind, url) the English track that a person wrote, else an English one, else the first."""
    english = F.filter(tracks, lambda t: F.lower(t["lang"]).startswith("en"))
    written = F.filter(english, lambda t: F.coalesce(t["kind"], F.lit("")) != "asr")
    return F.coalesce(F.get(written, F.lit(0)), F.get(english, F.lit(0)), F.get(tracks, F.lit(0)))


#: The router among hosted models that picks a free one, and how many random articles are tried.
ROUTER, RANDOM_TRIES = ("openrouter/free", "OpenRouter free-model router"), 12


def hosted_models(payloads: DataFrame, listing: list[str]) -> DataFrame:
    """listing, ord, id, label, free, context: the models of each answer (listing, body), free ones first; the router leads where an answer doesn't have it.

    A model is free by its name or if both its prices are given as zero.
    """
    schema = "struct<data:array<struct<id:string,name:string,context_length:bigint,pricing:struct<prompt:string,completion:string>>>>"
    answers = payloads.select(*listing, F.from_json("body", schema)["data"].alias("_all"))
    rows = answers.select(*listing, F.explode("_all").alias("m"))
    zero = (F.col("m.pricing.prompt").try_cast("double") == 0) & (F.col("m.pricing.completion").try_cast("double") == 0)
    named = rows.select(*listing, F.lit(1).alias("_last"), F.col("m.id").alias("id"), F.coalesce(F.nullif("m.name", F.lit("")), "m.id").alias("label"), (F.col("m.id").endswith(":free") | F.coalesce(zero, F.lit(False))).alias("free"), F.coalesce("m.context_length", F.lit(0)).cast("long").alias("context"))
    without = answers.where(F.col("_all").isNull() | ~F.exists("_all", lambda m: F.coalesce(m["id"] == ROUTER[0], F.lit(False))))
    led = without.select(*listing, F.lit(0).alias("_last"), F.lit(ROUTER[0]).alias("id"), F.lit(ROUTER[1]).alias("label"), F.lit(True).alias("free"), F.lit(0).cast("long").alias("context"))
    order = Window.partitionBy(*listing).orderBy("_last", F.desc("free"), "id")
    return named.unionByName(led).withColumn("ord", F.row_number().over(order) - 1).select(*listing, "ord", "id", "label", "free", "context")


def local_models(payloads: DataFrame, listing: list[str]) -> DataFrame:
    """listing, ord, id, label, free, detail: models that a local server names, in its order, with size and quantisation; of a plain list all but embedders."""
    schema = "struct<models:array<struct<name:string,details:struct<parameter_size:string,quantization_level:string>>>,data:array<struct<id:string>>>"
    read = payloads.select(*listing, F.from_json("body", schema).alias("a"))
    nz = lambda c: F.nullif(c, F.lit(""))
    tags = F.transform("a.models", lambda m: F.struct(m["name"].alias("id"), F.concat_ws(" · ", nz(m["details"]["parameter_size"]), nz(m["details"]["quantization_level"])).alias("detail")))
    plain = F.transform(F.filter("a.data", lambda m: ~m["id"].rlike("(?i)embed")), lambda m: F.struct(m["id"].alias("id"), F.lit("").alias("detail")))
    return read.select(*listing, F.posexplode(F.coalesce(tags, plain)).alias("ord", "m")).select(*listing, "ord", "m.id", F.col("m.id").alias("label"), F.lit(True).alias("free"), "m.detail")


def topic_candidates(payloads: DataFrame, day: list[str]) -> DataFrame:
    """day, priority, ord, title, why: the featured article of a day's feed (day, body), then the first article of each anniversary."""
    schema = "struct<tfa:struct<title:string>,onthisday:array<struct<year:int,pages:array<struct<title:string>>>>>"
    f = payloads.select(*day, F.from_json("body", schema).alias("f"))
    spaced = lambda t: F.replace(t, F.lit("_"), F.lit(" "))
    first = f.select(*day, F.lit(1).alias("priority"), F.lit(0).alias("ord"), spaced(F.col("f.tfa.title")).alias("title"), F.lit("Wikipedia's featured article today").alias("why"))
    days = f.select(*day, F.lit(2).alias("priority"), F.posexplode("f.onthisday").alias("ord", "e")).select(
        *day, "priority", "ord", spaced(F.get("e.pages", F.lit(0))["title"]).alias("title"), F.concat(F.lit("on this day ("), F.coalesce(F.col("e.year").cast("string"), F.lit("?")), F.lit(")")).alias("why"))
    return first.unionByName(days).where("coalesce(title, '') <> ''")


def article_summary(body: Column) -> Column:
    """struct(title, extract, type) of a summary's answer."""
    return F.from_json(body, "struct<title:string,extract:string,type:string>")


def topic_feed(feed: DataFrame, summaries: DataFrame, randoms: DataFrame, day: list[str]) -> DataFrame:
    """day, priority, ord, topic, extract, kind, why: the candidates of a day for which there is a summary, in the order in which they are tried.

    feed: day, body; summaries: title, body of the articles asked for; randoms: day, attempt (from 0), body, of which the first RANDOM_TRIES count.
    """
    told = summaries.select("title", article_summary(F.col("body")).alias("s"))
    named = topic_candidates(feed, day).join(told, "title").select(*day, "priority", "ord", F.coalesce(F.nullif("s.title", F.lit("")), "title").alias("topic"), "s.extract", F.col("s.type").alias("kind"), "why")
    some = randoms.where(F.col("attempt") < RANDOM_TRIES).select(*day, F.lit(3).alias("priority"), F.col("attempt").cast("int").alias("ord"), article_summary(F.col("body")).alias("s"))
    drawn = some.select(*day, "priority", "ord", F.coalesce("s.title", F.lit("")).alias("topic"), "s.extract", F.col("s.type").alias("kind"), F.lit("random Wikipedia article").alias("why"))
    return named.unionByName(drawn)
