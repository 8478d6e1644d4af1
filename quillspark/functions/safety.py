"""Predicates that keep explicit, dead and irrelevant sources out, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEAD_BELOW, DEAD_MARKERS, EXPLICIT_WORDS
from .text import term_hits

# Word edges are ASCII, as the lists are.
EXPLICIT = rf"(?i)(?<![A-Za-z0-9_])(?:{EXPLICIT_WORDS})(?![A-Za-z0-9_])"


def explicit_hits(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(EXPLICIT)), F.lit(0))


def is_explicit_snippet(title: Column, body: Column) -> Column:
    return explicit_hits(F.concat_ws(" ", title, body)) >= 1


def is_explicit_source(title: Column, text: Column, publisher: Column) -> Column:
    head = F.concat_ws(" ", F.substring(text, 1, 4000), F.coalesce(publisher, F.lit("")))
    # A text that is all head has its hits there.
    return (explicit_hits(title) >= 1) | (explicit_hits(head) >= 2) | ((F.length(text) > 4000) & (explicit_hits(text) >= 4))


def looks_dead(text: Column) -> Column:
    head = F.lower(F.substring(text, 1, 500))
    found = F.lit(False)
    for marker in DEAD_MARKERS:
        found = found | head.contains(marker)
    return (F.length(text) < DEAD_BELOW) | found


def is_relevant(kind: Column, terms: Column, title: Column, text: Column) -> Column:
    """Papers and news must meet the topic's terms; other kinds were searched for it."""
    return ~kind.isin("academic", "news") | (F.size(terms) == 0) | (term_hits(terms, title) >= 1) | (term_hits(terms, F.substring(text, 1, 1500)) >= 2)


def is_acceptable_topic(title: Column, extract: Column, kind: Column) -> Column:
    from ..config import BAD_TITLE

    return (title != "") & (kind != "disambiguation") & ~title.rlike(BAD_TITLE) & (F.length(F.coalesce(extract, F.lit(""))) >= 200)
