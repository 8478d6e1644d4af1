"""Line protocols of model replies, as Columns over the whole reply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import PLAN_QUESTIONS, PLAN_TEMPLATES
from .citations import clean_body

_ENDS = r"(?U)^\s+|\s+\z"
_BULLET = r"^\s*(?:[-*\d.)]+\s*)?"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def distinct_by_lower(values: Column) -> Column:
    """The first of values that differ in case only."""
    return F.filter(values, lambda x, i: F.array_position(F.transform(values, F.lower), F.lower(x)) == i + 1)


def parse_plan(text: Column, part: str) -> Column:
    """part: QUERY, QUESTION or TERM. The values of its lines, without quotes, up to 200 characters."""
    line = rf"(?i)^\s*(?:[-*\d.)]+\s*)?\**{part}\**\s*:\s*(.+?)\s*\z"
    found = F.transform(F.filter(_lines(text), lambda x: x.rlike(line)), lambda x: F.regexp_replace(F.regexp_extract(x, line, 1), "^[\"'`*]+|[\"'`*]+\\z", ""))
    return distinct_by_lower(F.filter(found, lambda v: (v != "") & (F.length(v) <= 200)))


def fallback_queries(topic: Column, n: int) -> Column:
    return F.slice(F.array(topic, *(F.concat(topic, F.lit(f" {t}")) for t in PLAN_TEMPLATES)), 1, n)


def fallback_questions(topic: Column) -> Column:
    return F.array(*(F.replace(F.lit(q), F.lit("{}"), topic) for q in PLAN_QUESTIONS))


def build_plan(topic: Column, reply: Column, n: int) -> Column:
    """struct(queries, questions, terms, source): the reply's plan if it has queries, the topic first; else the fallback."""
    queries, questions = parse_plan(reply, "QUERY"), parse_plan(reply, "QUESTION")
    own = F.coalesce(F.size(queries) > 0, F.lit(False))
    return F.struct(
        F.when(own, F.slice(distinct_by_lower(F.concat(F.array(topic), queries)), 1, n)).otherwise(fallback_queries(topic, n)).alias("queries"),
        F.when(own & (F.size(questions) > 0), questions).otherwise(fallback_questions(topic)).alias("questions"),
        F.when(own, parse_plan(reply, "TERM")).otherwise(F.array().cast("array<string>")).alias("terms"), F.when(own, "llm").otherwise("fallback").alias("source"))


def parse_glossary(text: Column, valid: Column) -> Column:
    """array of struct(term, definition)."""
    line = r"^\s*(?:[-*•]+|\d+[.)])?\s*\**\s*(.+?)\s*\**\s*::\s*(.+)\z"
    rows = F.transform(F.filter(_lines(text), lambda x: x.rlike(line)), lambda x: F.struct(F.regexp_replace(F.regexp_extract(x, line, 1), r"^[*_` ]+|[*_` ]+\z", "").alias("term"), clean_body(F.regexp_extract(x, line, 2), valid).alias("definition")))
    good = F.filter(rows, lambda r: (r["term"] != "") & (r["definition"] != "") & (F.length(r["term"]) <= 80))
    names = lambda a: F.transform(a, lambda r: F.lower(r["term"]))
    return F.filter(good, lambda r, i: F.array_position(names(good), F.lower(r["term"])) == i + 1)


def parse_quiz(text: Column) -> Column:
    """array of struct(question, answer), from one line or from a question and the answer after it."""
    both, asked, told = r"(?i)^Q\s*::\s*(.+?)\s*\|\|\s*A\s*::\s*(.+)\z", r"(?i)^Q\s*::\s*(.+)\z", r"(?i)^A\s*::\s*(.+)\z"
    rows = F.transform(_lines(text), lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, _ENDS, ""), r"^[-*0-9.) ]+", ""), _ENDS, ""))
    untagged = lambda x: F.regexp_replace(F.regexp_replace(x, r"\[S\d+\]", ""), _ENDS, "")
    pair = lambda q, a: F.array(F.struct(F.regexp_replace(q, _ENDS, "").alias("question"), untagged(a).alias("answer")))
    kind = "struct<pending:string,out:array<struct<question:string,answer:string>>>"
    none = F.lit(None).cast("string")
    begin = F.struct(none.alias("pending"), F.array().cast("array<struct<question:string,answer:string>>").alias("out")).cast(kind)

    def step(a: Column, x: Column) -> Column:
        whole = F.struct(none.alias("pending"), F.concat(a["out"], pair(F.regexp_extract(x, both, 1), F.regexp_extract(x, both, 2))).alias("out"))
        wait = F.struct(F.regexp_replace(F.regexp_extract(x, asked, 1), _ENDS, "").alias("pending"), a["out"].alias("out"))
        answer = F.struct(none.alias("pending"), F.concat(a["out"], pair(a["pending"], F.regexp_extract(x, told, 1))).alias("out"))
        return F.when(x.rlike(both), whole).when(x.rlike(asked), wait).when(x.rlike(told) & a["pending"].isNotNull(), answer).otherwise(a).cast(kind)

    return F.aggregate(rows, begin, step, lambda a: a["out"])


def parse_next(text: Column) -> Column:
    """array of struct(topic, why), six at most."""
    line = rf"(?i){_BULLET}NEXT\s*::\s*(.+?)\s*[|—–-]\s*(.+)\z"
    rows = F.transform(F.filter(_lines(text), lambda x: x.rlike(line)), lambda x: F.struct(F.regexp_replace(F.regexp_extract(x, line, 1), r"^[*_` ]+|[*_` ]+\z", "").alias("topic"), F.regexp_replace(F.regexp_extract(x, line, 2), _ENDS, "").alias("why")))
    return F.slice(rows, 1, 6)


def parse_video(text: Column, duration: Column) -> Column:
    """struct(summary, points): the last summary, and six points at most that lie within the video."""
    from ..functions.media import parse_timestamp

    summary, point = r"(?i)^\s*SUMMARY\s*::\s*(.+)\z", r"(?i)^\s*KEYPOINT\s*::\s*(\d+(?::\d{1,2}){1,2})\s*[|–—-]\s*(.+)\z"
    told = F.filter(_lines(text), lambda x: x.rlike(summary))
    rows = F.transform(F.filter(_lines(text), lambda x: x.rlike(point)), lambda x: F.struct(parse_timestamp(F.regexp_extract(x, point, 1)).alias("second"), F.regexp_replace(F.regexp_extract(x, point, 2), _ENDS, "").alias("text")))
    good = F.filter(rows, lambda r: r["second"].isNotNull() & ((duration <= 0) | (r["second"] <= duration)))
    return F.struct(F.when(F.size(told) > 0, F.regexp_replace(F.regexp_extract(F.element_at(told, -1), summary, 1), _ENDS, "")).otherwise("").alias("summary"), F.slice(good, 1, 6).alias("points"))
