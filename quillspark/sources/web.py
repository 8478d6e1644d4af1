"""Web gather: search results of a topic's queries to ranked addresses, and their captured pages to sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safety import is_explicit_snippet
from ..functions.text import term_hits
from ..functions.urls import canonical_url, with_trust
from ..operators.dedup import first_of_each
from .pages import asks_for_captcha, lite_results, readable, search_results

# Fixed value: results that count of each query.
RESULTS_A_QUERY = 8


def results(main: DataFrame, lite: DataFrame, most: int = RESULTS_A_QUERY) -> DataFrame:
    """topic_id, query_ord, pos, href, title, body: rows of the search page, or of the plain one where the former has none or asks for a captcha.

    main and lite are captured pages: topic_id, query_ord, html, null if fetching failed.
    """
    key = ["topic_id", "query_ord"]
    found = main.select(*key, search_results(F.col("html")).alias("_rows")).join(lite.select(*key, lite_results(F.col("html")).alias("_lite")), key, "full")
    chosen = F.when(F.size("_rows") > 0, F.col("_rows")).otherwise(F.col("_lite"))
    return found.select(*key, F.posexplode(chosen).alias("pos", "r")).where(F.col("pos") < most).select(*key, "pos", "r.*")


def failures(main: DataFrame, lite: DataFrame) -> DataFrame:
    """topic_id, query_ord: queries that neither page answers, the former failing or asking for a captcha."""
    key = ["topic_id", "query_ord"]
    bad = main.where(F.col("html").isNull() | (asks_for_captcha(F.col("html")) & (F.size(search_results(F.col("html"))) == 0))).select(*key)
    return bad.join(lite.where("html is not null").select(*key), key, "left_anti")


def candidates(rows: DataFrame, topics: DataFrame, n: int, trust: DataFrame | None = None, per_query: int = RESULTS_A_QUERY) -> DataFrame:
    """topic_id, url, canonical, title, score, place: the best 2 n addresses of each topic.

    rows: as results returns them; topics: topic_id, terms, allowed (explicit results may stay). Of the results for one canonical address the
    first counts, in the order of queries.
    """
    named = rows.where(F.col("pos") < per_query).withColumn("url", F.trim(F.coalesce("href", F.lit("")))).where(F.col("url").rlike("(?i)^https?:"))
    clean = named.join(topics, "topic_id").where(F.col("allowed") | ~is_explicit_snippet(F.col("title"), F.col("body")))
    kept = with_trust(clean, "url", trust).where("not blocked").withColumn("canonical", canonical_url(F.col("url")))
    first = first_of_each(kept, ["topic_id", "canonical"], ["query_ord", "pos"])
    share = term_hits(F.col("terms"), F.concat_ws(" ", "title", "body")) / F.greatest(F.lit(1), F.size("terms"))
    scored = first.withColumn("score", 0.5 * F.col("trust") + 0.5 * share)
    w = Window.partitionBy("topic_id").orderBy(F.desc("score"), "query_ord", "pos")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= 2 * n).select("topic_id", "url", "canonical", "title", "host", "trust", "score", "place")


def gather(chosen: DataFrame, pages: DataFrame, n: int, robots: DataFrame | None = None, agent: str = "*") -> DataFrame:
    """Sources of kind web: of the chosen addresses the n that can be read and are trusted most. pages: captured, url and html."""
    read = readable(pages.join(chosen.select("url").distinct(), "url", "left_semi").select("url", "html"), "url", robots, agent)
    met = chosen.withColumnRenamed("title", "_named").join(read.drop("html"), "url")
    w = Window.partitionBy("topic_id").orderBy(F.desc("trust"), "place")
    best = met.withColumn("pos", F.row_number().over(w) - 1).where(F.col("pos") < n)
    nz = lambda c: F.nullif(F.col(c), F.lit(""))
    return best.select(
        "topic_id", F.col("pos").cast("long").alias("pos"), F.lit("web").alias("kind"), F.lit("Web").alias("provider"), F.coalesce(nz("title"), nz("_named"), "url").alias("title"), "url", "text",
        F.substring(F.coalesce("date", F.lit("")), 1, 10).alias("date"), F.lit("").alias("authors"), F.col("host").alias("publisher"), "trust")
