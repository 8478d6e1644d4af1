"""Whole reports: from topics, numbered sources, section bodies, replies and videos to one row of REPORT for each topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PROFILES, Profile
from ..operators.citations import support_check, verification
from ..operators.protocols import parse_glossary, parse_next, parse_quiz
from ..sources.shared import kept
from .briefing import TOPIC
from .render import REPORT, SOURCE, finalize

GLOSSARY, SECTIONS, VIDEOS = 0, 1, 2  # in the order in which citations are numbered


def _nested(rows: DataFrame, name: str, fields: list[str], order: str = "ord") -> DataFrame:
    """topic_id, name: the rows of a topic as an array of structs, in order."""
    entry = F.struct(F.col(order).cast("long").alias("_o"), F.struct(*fields).alias("_x"))
    return rows.groupBy(*TOPIC).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["_x"]).alias(name))


def _reply(replies: DataFrame, step: str) -> DataFrame:
    return replies.where(F.col("step") == step).select(*TOPIC, F.col("text").alias("_reply"))


def _valid(sources: DataFrame) -> DataFrame:
    return sources.groupBy(*TOPIC).agg(F.collect_set(F.col("id").cast("long")).alias("_valid"))  # a topic has as many sources as its caps leave it


def glossary(replies: DataFrame, sources: DataFrame, profile: Profile) -> DataFrame:
    """topic_id, ord, term, definition: of the reply to the step glossary, citations of other ids removed."""
    told = _reply(replies, "glossary").join(_valid(sources), TOPIC)
    terms = F.slice(parse_glossary(F.col("_reply"), F.col("_valid")), 1, profile.glossary_terms)
    return told.select(*TOPIC, F.posexplode(terms).alias("ord", "g")).select(*TOPIC, "ord", "g.term", "g.definition")


def assemble(topics: DataFrame, sources: DataFrame, bodies: DataFrame, replies: DataFrame, videos: DataFrame | None = None, models: DataFrame | None = None, warnings: DataFrame | None = None, profile: Profile = PROFILES["standard"]) -> DataFrame:
    """topic_id and the columns of REPORT, a row for each of topics (topic_id, topic, generated, level, depth).

    sources: topic_id, id and what a reference tells. bodies: topic_id, ord, key, title, body, with tags of sources, as write() gives them. replies: topic_id,
    step (glossary, quiz, next), text. videos: topic_id, ord and the fields of a video of REPORT, summary with tags. models: topic_id, ord, model.
    warnings: topic_id, ord, warning.

    Citations are numbered over glossary, sections and videos, in that order, and checked over sections and glossary before that. Every part is
    nested by topic and joined to it; a topic without a part has an empty one.
    """
    spark = topics.sparkSession
    terms = kept(glossary(replies, sources, profile), "glossary")
    bodies = kept(bodies.where("coalesce(body, '') <> ''").select(*TOPIC, "ord", "key", "title", "body"), "bodies")
    text = lambda frame, part, column: frame.select(*TOPIC, F.lit(part).alias("part"), F.col("ord").cast("long").alias("ord"), F.col(column).alias("text"))
    texts = text(terms, GLOSSARY, "definition").unionByName(text(bodies, SECTIONS, "body"))
    if videos is not None:
        texts = texts.unionByName(text(videos, VIDEOS, "summary"))
    done, refs, consulted = finalize(texts, sources, TOPIC, ["part", "ord"])
    done = kept(done, "numbered")
    of = lambda part: done.where(F.col("part") == part).select(*TOPIC, "ord", F.col("text").alias("_text"))
    put = lambda frame, part, column: frame.withColumn("ord", F.col("ord").cast("long")).join(of(part), [*TOPIC, "ord"]).withColumn(column, F.col("_text"))
    about = lambda frame: frame.withColumn("source", F.struct(*(c.split(":")[0] for c in SOURCE[7:-1].split(","))))

    # The check reads a report's sections first, then its glossary.
    checked = support_check(
        text(bodies, 0, "body").unionByName(text(terms, 1, "definition")).select(*TOPIC, (F.col("part") * (1 << 32) + F.col("ord")).alias("text_ord"), "text"),
        sources.select(*TOPIC, F.col("id").alias("source_id"), "text"), TOPIC)
    lines = verification(kept(checked, "checked"), TOPIC).select(*TOPIC, F.concat(F.array("summary"), "lines").alias("verification"))

    parts = {
        "glossary": _nested(put(terms, GLOSSARY, "definition"), "glossary", ["term", "definition"]), "sections": _nested(put(bodies, SECTIONS, "body"), "sections", ["key", "title", "body"]),
        "quiz": _reply(replies, "quiz").select(*TOPIC, F.slice(parse_quiz(F.col("_reply")), 1, profile.quiz_questions).alias("quiz")), "next": _reply(replies, "next").select(*TOPIC, parse_next(F.col("_reply")).alias("next")),
        "refs": _nested(about(refs).withColumn("n", F.col("n").cast("int")), "refs", ["n", "source"], "n"), "consulted": about(consulted).groupBy(*TOPIC).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("id").cast("long").alias("id"), "source"))), lambda e: e["source"]).alias("consulted")),
        "verification": lines}
    if videos is not None:
        fields = ["title", "url", "publisher", "seconds", "date", "views", "video_id", "basis", "summary", "points"]
        parts["videos"] = _nested(put(videos, VIDEOS, "summary"), "videos", fields)
    for name, rows, column in (("models", models, "model"), ("warnings", warnings, "warning")):
        if rows is not None:
            parts[name] = rows.groupBy(*TOPIC).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", column))), lambda e: e[column]).alias(name))
    out = topics.select(*TOPIC, "topic", "generated", "level", "depth")
    for rows in parts.values():
        out = out.join(rows, TOPIC, "left")
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], REPORT).schema}
    made = lambda name: F.coalesce(F.col(name), F.array()).cast(kinds[name]) if name in out.columns else F.array().cast(kinds[name])
    fixed = {"mode": _mode(out), "tldr": F.lit("")}
    return out.select(*TOPIC, *(fixed.get(n, F.col(n) if n in ("topic", "generated", "level", "depth") else made(n)).alias(n) for n in kinds))


def _mode(out: DataFrame) -> Column:
    return F.when(F.size("models") > 0, "llm").otherwise("extractive") if "models" in out.columns else F.lit("extractive")


def sources_document(reports: DataFrame, sources: DataFrame, numbers: DataFrame) -> DataFrame:
    """topic_id, json: {topic, generated, sources} of each report (topic_id, topic, generated), the sources as sources_json() has them."""
    from .render import sources_json

    each = sources_json(sources.join(reports.select(*TOPIC, F.col("generated").alias("retrieved")), TOPIC), numbers, TOPIC)
    fields = ["n", "cited", "title", "url", "publisher", "provider", "kind", "date", "authors", "reliability_heuristic", "retrieved"]
    nested = _nested(each, "sources", fields, "place")
    told = reports.join(nested, TOPIC, "left").select(*TOPIC, "topic", "generated", F.coalesce("sources", F.array()).alias("sources"))
    return told.select(*TOPIC, F.to_json(F.struct("topic", "generated", "sources"), {"ignoreNullFields": "false"}).alias("json"))
