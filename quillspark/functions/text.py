"""Text functions as Columns: tokens, stems, terms, excerpts, identifiers."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import STOPWORDS

SPACE = r"(?U)\s+"
TOKEN = r"[A-Za-z0-9][A-Za-z0-9'\-]*"


def squash(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, SPACE, " "), r"^ | \z", "")


def _cut(t: Column, n: int) -> Column:
    return F.substring(t, F.lit(1), F.length(t) - n)


def _ends(t: Column, *ends: str) -> Column:
    out = t.endswith(ends[0])
    for end in ends[1:]:
        out = out | t.endswith(end)
    return out


def _bare(t: Column) -> Column:
    """A match of TOKEN in lower case, without the apostrophes and hyphens at its end; none begins with one."""
    return F.rtrim(F.lower(t), F.lit("'-"))


def _plural(t: Column) -> Column:
    return (
        F.when(F.length(t) <= 3, t)
        .when(t.endswith("ies"), F.concat(_cut(t, 3), F.lit("y")))
        .when(_ends(t, "sses", "xes", "zes", "ches", "shes"), _cut(t, 2))
        .when(t.endswith("s") & ~_ends(t, "ss", "us", "is"), _cut(t, 1))
        .otherwise(t))


def _participle(t: Column) -> Column:
    out = F.when(F.lit(False), t)
    for suffix in ("ingly", "edly", "ing", "ed"):
        out = out.when(t.endswith(suffix) & (F.length(t) >= len(suffix) + 3), _cut(t, len(suffix)))
    return out.otherwise(t)


def _final_e(t: Column) -> Column:
    return F.when((F.length(t) > 3) & t.endswith("e"), _cut(t, 1)).otherwise(t)


def _double(t: Column) -> Column:
    last = F.substring(t, -1, 1)
    return F.when((F.length(t) > 3) & (last == F.substring(t, -2, 1)) & ~last.isin("l", "s", "z"), _cut(t, 1)).otherwise(t)


def stem_all(words: Column) -> Column:
    """Stems of an array; each step is one pass, so that no expression is written out twice."""
    for step in (_plural, _participle, _final_e, _double):
        words = F.transform(words, step)
    return words


def stem(token: Column) -> Column:
    return F.element_at(stem_all(F.array(token)), 1)


def word_rows(rows: DataFrame, keys: list[str], text: str = "text", keep_stop: bool = False, name: str = "term", marked: bool = False, at: str | None = None) -> DataFrame:
    """keys, name: a row for each token of a text, as tokens() gives them in an array. marked: and one of the empty token, also for texts without any.

    at: a column for the token's place among the words of the text. A filter of the token, or an inner join by it, should stand above an aggregate that
    is written first: moved down by the planner, it would repeat the steps of stemming within each other.

    For what counts or joins tokens: words are stemmed as plain columns, in generated code, where functions of arrays are interpreted.
    """
    t = F.col(name)
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(0))
    found = F.concat(F.array(F.lit("")), found) if marked else found
    raw = rows.select(*keys, F.posexplode(found).alias(at, name) if at else F.explode(found).alias(name)).withColumn(name, _bare(t))
    raw = raw.where((F.length(t) >= 2) | (t == "") if marked else F.length(t) >= 2)
    raw = raw if keep_stop else raw.where(~_is_stop(t))
    for step in (_plural, _participle, _final_e, _double):
        raw = raw.withColumn(name, step(t))
    return raw


#: For bytes.translate: A-Z in lower case, other bytes of tokens as they are, the rest spaces. A run holds one token, or none: what is left without the
#: apostrophes and hyphens at its ends.
_RUNS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if re.match(rb"[a-z0-9'\-]", bytes([b])) else 0x20 for b in range(256))
#: Runs whose tokens a task remembers, letters of the longest of them, and rows that it sends at a time.
REMEMBERED, LONG, SENT = 200_000, 40, 100_000


def stemmed(t: str) -> str:
    """stem() of one token in lower case."""
    if len(t) > 3:
        if t.endswith("ies"):
            t = t[:-3] + "y"
        elif t.endswith(("sses", "xes", "zes", "ches", "shes")):
            t = t[:-2]
        elif t.endswith("s") and not t.endswith(("ss", "us", "is")):
            t = t[:-1]
    for suffix in ("ingly", "edly", "ing", "ed"):
        if t.endswith(suffix) and len(t) >= len(suffix) + 3:
            t = t[: -len(suffix)]
            break
    if len(t) > 3 and t.endswith("e"):
        t = t[:-1]
    return t[:-1] if len(t) > 3 and t[-1] == t[-2] and t[-1] not in "lsz" else t


def counted_words(rows: DataFrame, keys: list[str], text: str = "text", keep_stop: bool = False, name: str = "term", only: Callable[[str], bool] | None = None, least: int = 0) -> DataFrame:
    """keys, name, tf, len: a row for each different token of each row's text, with how often it has it, and a row of the empty token with tf 0.

    len: the tokens of the text. only: which tokens count, others being left out of len too. Texts of a smaller len than least have no rows.

    Tokens are those of word_rows(), counted where the text is read, so a token is shuffled once for each text; each run of letters is stemmed once
    for many texts.
    """
    stop = frozenset(() if keep_stop else STOPWORDS)

    def token(run: bytes) -> bytes | None:
        word = run.strip(b"'-").decode()
        if len(word) < 2 or word in stop:
            return None
        word = stemmed(word)
        return word.encode() if only is None or only(word) else None

    def count(batches):
        known: dict[bytes, bytes | None] = {}
        for batch in batches:
            column = batch.column(len(keys))
            at, terms, counts, lengths = [], [], [], []

            def out():
                own = batch.select(keys).take(pa.array(at, pa.int64())).columns
                return pa.RecordBatch.from_arrays([*own, pa.array(terms, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(lengths, pa.int64())], names=[*keys, name, "tf", "len"])

            for i in range(batch.num_rows):
                bag: dict[bytes, int] = {b"": 0}
                runs = (column[i].as_py() or b"").translate(_RUNS).split()
                # Short texts repeat few words.
                for run, n in Counter(runs).items() if len(runs) > 50 else zip(runs, repeat(1)):
                    try:
                        t = known[run]
                    except KeyError:
                        t = token(run)
                        if len(run) <= LONG:
                            if len(known) >= REMEMBERED:
                                known.clear()
                            known[run] = t
                    if t is not None:
                        bag[t] = bag.get(t, 0) + n
                total = sum(bag.values())
                if total < least:
                    continue
                at += [i] * len(bag)
                terms += bag
                counts += bag.values()
                lengths += [total] * len(bag)
                if len(at) > SENT:
                    yield out()
                    at, terms, counts, lengths = [], [], [], []
            yield out()

    read = rows.select(*keys, F.col(text).cast("binary").alias("_text"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keys).schema)
    return read.mapInArrow(count, f"{kinds}`{name}` string, tf bigint, len bigint")


def _is_stop(t: Column) -> Column:
    return t.isin(*STOPWORDS)


def words(text: Column, keep_stop: bool = False, least: int = 2) -> Column:
    raw = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), _bare)
    return F.filter(raw, lambda t: (F.length(t) >= least) & (F.lit(True) if keep_stop else ~_is_stop(t)))


def tokens(text: Column, keep_stop: bool = False) -> Column:
    """Stemmed ASCII words of two letters or more; stop words go before stemming unless kept."""
    return stem_all(words(text, keep_stop))


def keyword_terms(text: Column, limit: int = 8) -> Column:
    return F.slice(F.array_distinct(words(text, least=3)), 1, limit)


def _beginning(stems: Column) -> Column:
    """A pattern whose group 1 are the matches of TOKEN, two letters or more, that can have one of the stems.

    Endings are cut from words, and -ies becomes -y, so a word begins as its stem does, but for a last y. The signs of a stem have no other meaning in a
    pattern. A place is looked at further if its letter can begin a match; all flags are for ASCII.
    """
    stems = F.array_join(F.filter(stems, lambda t: t.rlike(r"^[a-z0-9][a-z0-9'\-]+\z")), "|")
    first, whole = F.regexp_replace(stems, r"(.)[^|]*(\||\z)", "$1"), F.regexp_replace(stems, r"y(?=\||\z)", "[iy]")
    return F.concat(F.lit(r"(?i)(?=['\-"), first, F.lit(r"])(?<![a-z0-9'\-])['\-]*+((?:"), whole, F.lit(r")[a-z0-9'\-]*)"))


def term_hits(terms: Column, text: Column) -> Column:
    """How many of the terms occur in the text, by stem.

    Only words that can have a term's stem are taken from the text. Arrays of one element hold what a lambda would work out anew for each term.
    """
    begun = lambda stems: F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), _beginning(stems), F.lit(1)), _bare)
    found = lambda stems: stem_all(F.array_distinct(F.filter(begun(stems), lambda w: F.length(w) >= 2)))
    hits = lambda stems: F.transform(F.array(found(stems)), lambda f: F.size(F.filter(stems, lambda t: F.array_contains(f, t))))
    return F.element_at(F.element_at(F.transform(F.array(stem_all(F.transform(terms, F.lower))), hits), 1), 1)


def excerpt(text: Column, limit: int = 320, least: int = 120) -> Column:
    t = squash(text)
    cut = F.length(F.regexp_extract(t, rf"(?s)^(.{{0,{limit}}}\. )", 1)) - 2
    return F.when(F.length(t) <= limit, t).when(cut > least, F.substring(t, F.lit(1), cut + 1)).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, limit), r"(?U)\s+\z", ""), F.lit("...")))


def slugify(text: Column, limit: int = 60) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), r"^-+|-+\z", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(slug, 1, limit), r"-+\z", ""), F.lit("")), F.lit("topic"))


def esc(text: Column) -> Column:
    for raw, sign in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(sign))
    return text


def clean_wiki_extract(text: Column, limit: int = 40_000) -> Column:
    from ..config import TAIL_HEADINGS

    t = F.regexp_replace(text, rf"(?ims)^=+\s*(?:{TAIL_HEADINGS})\s*=+\s*$.*", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+\z", "")
    return F.substring(t, 1, limit)


def clean_completion(text: Column) -> Column:
    """A model's reply without its thoughts, and out of a code fence that holds all of it."""
    t = F.regexp_replace(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""), r"(?U)^\s+|\s+\z", "")
    return F.regexp_replace(t, r"(?s)^```[a-zA-Z]*\n(.*?)\n?```\z", "$1")


def authors_line(names: Column) -> Column:
    kept = F.filter(names, lambda x: x.isNotNull() & (x != ""))
    return F.concat(F.array_join(F.slice(kept, 1, 3), ", "), F.when(F.size(kept) > 3, " et al.").otherwise(""))


def reliability_label(trust: Column) -> Column:
    return F.when(trust >= 0.8, "high").when(trust >= 0.6, "medium").otherwise("unverified")


def kind_label(kind: Column) -> Column:
    from ..config import KIND_LABELS

    return F.coalesce(F.create_map(*(F.lit(x) for kv in KIND_LABELS.items() for x in kv))[kind], kind)
