"""The briefing dataflow for many topics at once: gather, rank, retrieve for every section, write extracts, check them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONTEXT_CHARS, PER_SOURCE, PROFILES, SECTIONS, Profile
from ..functions.safety import explicit_hits, is_explicit_source, is_relevant
from ..functions.text import excerpt, kind_label
from ..operators.citations import clean_body, support_check, verification
from ..operators.dedup import first_of_each, greedy_two_key
from ..operators.passages import passages
from ..operators.protocols import parse_video
from ..operators.ranking import bm25, budgeted_passages, dense_ids, extractive, relevance, source_rank, term_coverage, top_per_kind
from ..sources.shared import kept as kept_

TOPIC = ["topic_id"]


def allowed(topic: Column) -> Column:
    """Whether a topic is explicit itself, so that explicit sources may stay."""
    return explicit_hits(topic) > 0


def gather(sources: DataFrame, topics: DataFrame, this_year: int, profile: Profile = PROFILES["standard"]) -> DataFrame:
    """Ranked sources with ids. sources: of every provider, with ord; topics: topic_id, topic, terms.

    Explicit sources go (unless the topic itself is), then irrelevant ones, then repeats; the rest is ranked and cut per kind. The result is
    small, some rows of each kind, and is read by every later step, so it is written once.

    Texts are filtered and scored in one reading, which leaves what repeats and ranks go by; those of the sources chosen are read again.
    """
    topics = F.broadcast(topics.select(*TOPIC, "terms", allowed(F.col("topic")).alias("_allowed")))  # a line for each briefing; not a product that reads the texts again for each part of topics
    row = F.xxhash64("ord", "kind", "title", "url", "text")
    rows = sources.join(topics, TOPIC)
    clean = rows.where(F.col("_allowed") | ~is_explicit_source(F.col("title"), F.col("text"), F.col("publisher"))).where(is_relevant(F.col("kind"), F.col("terms"), F.col("title"), F.col("text")))
    scored = clean.withColumn("relevance", relevance(F.col("terms"), F.col("title"), F.col("text")))
    ranked = scored.withColumn("rank", source_rank(F.col("trust"), F.col("relevance"), F.col("date"), F.col("cited_by"), this_year))
    able = kept_(ranked.select(*TOPIC, "ord", "kind", "title", "url", "relevance", "rank", row.alias("_row")), "able")
    chosen = kept_(dense_ids(top_per_kind(greedy_two_key(able, TOPIC), profile.caps(), TOPIC), TOPIC).select(*TOPIC, "_row", "relevance", "rank", "place", "id"), "chosen", [able])
    told = F.broadcast(chosen.select(*TOPIC, "_row").distinct())  # some rows of each kind
    texts = sources.withColumn("_row", row).join(told, [*TOPIC, "_row"], "left_semi").dropDuplicates([*TOPIC, "_row"])
    return kept_(texts.join(chosen, [*TOPIC, "_row"]).select(*sources.columns, "relevance", "rank", "place", "id"), "sources")


def removed_sources(sources: DataFrame, topics: DataFrame) -> DataFrame:
    """topic_id, removed, warning: how many sources the filter of explicit ones takes out, for topics where it takes any."""
    rows = sources.join(F.broadcast(topics.select(*TOPIC, allowed(F.col("topic")).alias("_allowed"))), TOPIC)
    n = rows.groupBy(*TOPIC).agg(F.count_if(~F.col("_allowed") & is_explicit_source(F.col("title"), F.col("text"), F.col("publisher"))).alias("removed"))
    return n.where("removed > 0").withColumn("warning", F.concat(F.col("removed").cast("string"), F.lit(" source(s) removed by the adult-content filter")))


def section_table(spark, names=tuple(SECTIONS)) -> DataFrame:
    rows = [(i, n, *SECTIONS[n]) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "ord int, section string, title string, hint string, kinds array<string>")


def feasible(sections: DataFrame, sources: DataFrame) -> DataFrame:
    """topic_id and the sections for which the topic has a source of an allowed kind."""
    allowed = sections.select("ord", "section", "title", "hint", F.explode("kinds").alias("kind"))
    found = sources.select(*TOPIC, "kind").distinct().join(F.broadcast(allowed), "kind")  # eight sections
    return found.select(*TOPIC, "ord", "section", "title", "hint").distinct()


def retrieve(sources: DataFrame, topics: DataFrame, sections: DataFrame, profile: Profile = PROFILES["standard"], max_chars: int = CONTEXT_CHARS["hosted"]) -> DataFrame:
    """topic_id, section, source_id, idx, text, score: the passages of each section.

    Texts are split once. Sections differ by their pools of kinds and their hints; all go through one BM25 job.
    """
    pools = feasible(sections, sources)
    kinds = sections.select("section", F.explode("kinds").alias("kind"))
    pooled = split_sources(sources).join(F.broadcast(kinds), "kind").join(pools.select(*TOPIC, "section"), [*TOPIC, "section"], "left_semi")  # eight sections
    queries = pools.join(topics.select(*TOPIC, "topic"), TOPIC).select(*TOPIC, "section", F.concat_ws(" ", "topic", "hint").alias("query"))
    return _best(pooled, queries, [*TOPIC, "section"], profile.passages, max_chars)


def split_sources(sources: DataFrame) -> DataFrame:
    """topic_id, source_id, kind, idx, text: passages, written once."""
    return kept_(passages(sources.select(*TOPIC, F.col("id").cast("long").alias("source_id"), "kind", "text"), [*TOPIC, "source_id", "kind"]), "passages")


def _best(pooled: DataFrame, queries: DataFrame, pool: list[str], k: int, max_chars: int) -> DataFrame:
    keys = [*pool, "source_id", "idx"]
    hits = bm25(pooled, queries, keys, pool, [])
    scored = pooled.select(*keys, "text").join(hits, keys, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return budgeted_passages(scored, pool, k, PER_SOURCE, max_chars, pooled)


def glossary_terms(sources: DataFrame, terms: DataFrame, profile: Profile = PROFILES["standard"]) -> DataFrame:
    """topic_id, term, ord, coverage, place: the planned terms (topic_id, term, ord) that most sources cover, half as many again as the glossary holds."""
    once = first_of_each(terms, [*TOPIC, F.lower("term")], ["ord"])
    covered = term_coverage(once.select(*TOPIC, "term", "ord"), sources.select(*TOPIC, F.col("id").alias("source_id"), "text"), TOPIC)
    w = Window.partitionBy(*TOPIC).orderBy(F.desc("coverage"), "ord")
    return covered.withColumn("place", F.row_number().over(w)).where(F.col("place") <= profile.glossary_terms * 3 // 2)


def glossary_passages(sources: DataFrame, topics: DataFrame, terms: DataFrame, profile: Profile = PROFILES["standard"], max_chars: int = CONTEXT_CHARS["hosted"]) -> DataFrame:
    """topic_id, source_id, idx, text, score: passages for the glossary, of all kinds of sources."""
    ranked = glossary_terms(sources, terms, profile)
    listed = ranked.groupBy(*TOPIC).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda t: t["term"]), " ").alias("_terms"))
    queries = topics.select(*TOPIC, "topic").join(listed, TOPIC, "left").select(*TOPIC, F.concat_ws(" ", "topic", F.lit("definition meaning"), "_terms").alias("query"))
    return _best(split_sources(sources), queries, TOPIC, profile.passages + 2, max_chars)


def video_entries(videos: DataFrame, replies: DataFrame, profile: Profile = PROFILES["standard"], untold: Column | str = "No description available.") -> DataFrame:
    """topic_id, id, summary, points, basis. videos: topic_id, id, place, text, duration, has_transcript; replies: topic_id, id, reply.

    A reply counts for the first places of a topic, where there is a transcript and the reply has a summary; else the description's start is told, or
    untold where there is none.
    """
    met = videos.join(replies.select(*TOPIC, "id", "reply"), [*TOPIC, "id"], "left").withColumn("_v", parse_video(F.col("reply"), F.coalesce("duration", F.lit(0))))
    told = (F.col("place") <= profile.transcripts) & F.col("has_transcript") & F.col("reply").isNotNull() & (F.col("_v.summary") != "")
    about = F.when(F.col("text").rlike(r"(?U)\S"), excerpt(F.col("text"), 280)).otherwise(F.lit(untold))
    tag = F.concat(F.lit(" [S"), F.col("id").cast("string"), F.lit("]"))
    return met.select(
        *TOPIC, "id", F.concat(F.when(told, F.col("_v.summary")).otherwise(about), tag).alias("summary"), F.when(told, F.col("_v.points")).otherwise(F.slice("_v.points", 1, 0)).alias("points"),
        F.when(told, "transcript").otherwise("description").alias("basis"))


def evidence(chosen: DataFrame, sources: DataFrame) -> DataFrame:
    """topic_id, section, evidence: passages under a header of each source."""
    s = sources.select(*TOPIC, F.col("id").cast("long").alias("source_id"), "title", "provider", "kind", "date")
    head = F.concat(F.lit("[S"), F.col("source_id").cast("string"), F.lit("] "), "title", F.lit(" ("), F.concat_ws(", ", F.nullif("provider", F.lit("")), kind_label(F.col("kind")), F.nullif("date", F.lit(""))), F.lit(")"))
    rows = chosen.join(s, [*TOPIC, "source_id"]).groupBy(*TOPIC, "section", "source_id", head.alias("head")).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda p: F.concat(F.lit("  "), p["text"])).alias("parts"))
    block = F.concat_ws("\n", "head", F.array_join("parts", "\n"))
    return rows.groupBy(*TOPIC, "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_id", block.alias("b")))), lambda x: x["b"]), "\n").alias("evidence"))


def write(chosen: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """topic_id, section, body: what is left of a captured reply without headings and tags of sources that weren't its evidence; else the extractive body."""
    own = extractive(chosen, [*TOPIC, "section"]).withColumn("body", F.concat(F.lit("*Extracts from the sources, without a model.*\n\n"), "body"))
    if replies is None:
        return own
    valid = chosen.groupBy(*TOPIC, "section").agg(F.collect_set(F.col("source_id").cast("long")).alias("_valid"))  # a section has as many passages as its budget
    told = replies.where("coalesce(text, '') <> ''").join(valid, [*TOPIC, "section"]).select(*TOPIC, "section", F.nullif(clean_body(F.col("text"), F.col("_valid")), F.lit("")).alias("_reply"))
    return own.join(told, [*TOPIC, "section"], "left").select(*TOPIC, "section", F.coalesce("_reply", "body").alias("body"))


def check(bodies: DataFrame, sources: DataFrame) -> DataFrame:
    """Counts and lines of the support check of all sections of each topic."""
    order = section_table(bodies.sparkSession).select("section", F.col("ord").alias("text_ord"))
    texts = bodies.join(F.broadcast(order), "section").select(*TOPIC, "text_ord", F.col("body").alias("text"))
    return verification(support_check(texts, sources.select(*TOPIC, F.col("id").alias("source_id"), "text"), TOPIC), TOPIC)


def document_sources(docs: DataFrame, topic_id: int = 0) -> DataFrame:
    """The table of documents as sources of one topic: kinds, dates and citations follow from doc_id."""
    kinds = F.array(*(F.lit(k) for k in ("encyclopedia", "web", "academic", "news")))
    i = F.col("doc_id")
    return docs.where("text is not null").select(
        F.lit(topic_id).cast("long").alias("topic_id"), i.alias("ord"), F.element_at(kinds, (F.pmod(i, F.lit(4)) + 1).cast("int")).alias("kind"), F.lit("Corpus").alias("provider"),
        F.substring(F.element_at(F.split("text", "\n"), 1), 1, 60).alias("title"), F.concat(F.lit("https://"), "source", F.lit(".example.org/"), i.cast("string")).alias("url"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"),
        F.concat((2015 + F.pmod(i, F.lit(10))).cast("string"), F.lit("-01-01")).alias("date"), F.lit("").alias("authors"), F.col("source").alias("publisher"), F.lit(0.5).alias("trust"), F.pmod(i, F.lit(100)).alias("cited_by"))


