"""Personal data by weak supervision, in DataFrame functions only.

Base spans are the matches of four fixed patterns that pass their check. Wider patterns give further candidates: phones without ``+``, cards
with other separators, e-mail addresses that are spelt out. On every candidate labelers vote 1, -1 or 0: the strict pattern with its check
(regex), lists of domain ends, dialling codes and special networks (gazetteer), words before the span (context), what touches it (edges),
and its shape. Expectation-maximisation over the counts of vote patterns (Dawid and Skene, 1979; at most 3**5 patterns a kind, the only thing
that the driver sees) estimates how reliable each labeler is and how likely each pattern is personal data. The final classifier is naive
Bayes over features of the span, trained on all candidates with those probabilities as labels. Candidates that it accepts and that touch no
base span of their kind are added.

Positions: a pattern's matches and the pieces between them (split) alternate, so running sums of their lengths are the positions, in code
points. The patterns are written with possessive repeats and start only where a run starts, which gives the leftmost matches in linear time.
Running sums are taken in runs of RUN matches, so no array grows by one for each match of a text, and what stands beside a match is read from
the pieces beside it, not from the text's start. Matches that can't be of their kind by their number of digits are no candidates.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._io import written

KINDS = ("email", "ip", "card", "phone")
# Equal to the contract's patterns; see above.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\((?:at|AT)\)|\[(?:at|AT)\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\((?:dot|DOT)\)|\[(?:dot|DOT)\])\x20?[A-Za-z0-9-]++)++",
    "card": r"(?<![0-9.])[0-9]{4}(?:[./\x20-][0-9]{4}){2}[./\x20-][0-9]{1,7}(?![0-9.])",
    "phone": r"(?<![0-9+.(-])(?:\([0-9]{2,4}\)|00[0-9]{1,3}|0[0-9]{1,4})[\x20.-]?[0-9]{3,4}(?:[\x20.-][0-9]{2,4}){1,3}(?![0-9.])",
}
# Lists of the gazetteer.
DOMAIN_ENDS = "com org net edu gov int mil info biz io co uk de fr es it nl eu ch at us ca au jp"
DIALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 98"
CARD_STARTS = "34 37 40 41 42 43 44 45 46 47 48 49 51 52 53 54 55 60 62 65"
# Words before a span that speak for and against it.
FOR = {
    "email": r"(?i)(?:mail|contact|write|courriel|correo|kontakt)\W*\w{0,6}\W*$",
    "ip": r"(?i)(?:\bip|host|server|address|adresse|login|from)\W*\w{0,6}\W*$",
    "card": r"(?i)(?:card|visa|master|amex|credit|karte|carte|tarjeta)\W*\w{0,6}\W*$",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|cell|whatsapp|handy|telefon|appel|llam)\w*\W*\w{0,6}\W*$",
}
AGAINST = r"(?i)(?:token|version|isbn|issn|order|invoice|serial|sku|v|build|=|#|\$)\W*$"
VOTES = ("regex", "gazetteer", "context", "edges", "shape")
FEATURES = ("marks", "digits", "context", "edges", "gazetteer")
#: Values of a feature that the classifier knows of each kind; the others count together.
MOST_VALUES = 500
ACCEPT = 0.9
ROUNDS = 40
BEFORE = 30
#: Matches whose places are added up together.
RUN = 256


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.coalesce(c.try_cast("int"), F.lit(0)) * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"  # of any number of digits: leading zeros count for nothing
        return F.rlike(m, F.lit(rf"^{part}(?:\.{part}){{3}}$"))
    n = F.length(_digits(m))
    return {"email": F.lit(True), "card": n.between(12, 19) & luhn(_digits(m)), "phone": n.between(9, 15)}[kind]


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once: what a lambda mentions from outside is otherwise worked out anew for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _sums(numbers: Column) -> Column:
    """Of an array of numbers the sums of those before each, in runs of RUN: within a run, plus those of whole runs."""

    def plain(x: Column) -> Column:
        begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(x, begin, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    runs = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / RUN).cast("int")), lambda k: F.slice(x, k * RUN + 1, F.lit(RUN)))
    before = lambda rs: plain(F.transform(rs, lambda r: F.aggregate(r, F.lit(0).cast("long"), lambda a, n: a + n)))
    whole = lambda rs: F.flatten(F.zip_with(rs, before(rs), lambda r, b: F.transform(plain(r), lambda n: n + b)))
    return _let(numbers, lambda x: _let(runs(x), whole))


def matches(text: Column, pattern: str) -> Column:
    """Matches of a pattern: array of (m, at, before, after): places counted from 0 in code points, and what stands on either side.

    before: the piece before the match, with the match before that and its piece, BEFORE characters at most; after: two characters.
    """
    kind = "array<struct<m:string,at:bigint,before:string,after:string>>"
    near = lambda a, i: F.coalesce(F.get(a, i), F.lit(""))

    def one(p: Column, ends: Column, m: Column, i: Column) -> Column:
        gap = F.get(p["pieces"], i)
        older = F.when(F.length(gap) < BEFORE, F.concat(F.right(near(p["pieces"], i - 1), F.lit(BEFORE)), near(p["found"], i - 1))).otherwise("")
        later = F.left(near(p["pieces"], i + 1), F.lit(2))
        after = F.when(F.length(later) < 2, F.left(F.concat(later, near(p["found"], i + 1)), F.lit(2))).otherwise(later)
        return F.struct(m.alias("m"), (F.get(ends, i) + F.length(gap)).alias("at"), F.right(F.concat(older, gap), F.lit(BEFORE)).alias("before"), after.alias("after"))

    def described(p: Column) -> Column:
        lengths = F.transform(p["found"], lambda m, i: (F.length(m) + F.length(F.get(p["pieces"], i))).cast("long"))
        return _let(_sums(lengths), lambda ends: F.transform(p["found"], lambda m, i: one(p, ends, m, i)))

    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("pieces"))
    return F.when(F.rlike(text, F.lit(pattern)), _let(parts, described)).otherwise(F.array()).cast(kind)


def _any_of(x: Column, words: str) -> Column:
    return F.array_contains(F.array(*map(F.lit, words.split())), x)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, -1).when(yes, 1).otherwise(0)


def _possible(kind: str, m: Column) -> Column:
    """Whether a match has as many digits as its kind can have."""
    n = F.length(_digits(m))
    return {"email": F.lit(True), "ip": F.lit(True), "card": n.between(12, 19), "phone": n.between(7, 17)}[kind]


def _described(kind: str, x: Column, base: bool) -> Column:
    m, at, before, after = x["m"], x["at"], x["before"], x["after"]
    end = at + F.length(m)
    d = _digits(m)
    listed = {
        "email": _vote(_any_of(F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1)), DOMAIN_ENDS), F.rlike(m, F.lit(r"[0-9]$"))),
        "ip": _vote(F.lit(False), F.rlike(m, F.lit(r"^(?:0|127|22[4-9]|2[3-5][0-9])\."))),
        "card": _vote(_any_of(F.substring(d, 1, 2), CARD_STARTS), F.rlike(d, F.lit(r"^(?:[01]|(.)\1+$)"))),
        "phone": _vote(_any_of(F.substring(d, 1, 1), "1 7") | _any_of(F.substring(d, 1, 2), DIALLING_CODES), F.rlike(d, F.lit(r"(.)\1{6}"))),
    }[kind]
    context = _vote(F.rlike(before, F.lit(FOR[kind])), F.rlike(before, F.lit(AGAINST)))
    edges = _vote(F.rlike(before, F.lit(r"(?:^|[\s(\[<\"':;,])$")) & F.rlike(after, F.lit(r"^(?:$|[\s)\]>\"';,!?]|\.(?:\s|$))")), F.rlike(before, F.lit(r"[\p{L}0-9_]$")) | F.rlike(after, F.lit(r"^[\p{L}0-9_]")))
    fits = {"email": F.length(m) <= 254, "ip": F.length(m) <= 15, "card": F.length(d).isin(13, 14, 15, 16, 19), "phone": F.length(d).between(9, 13)}[kind]
    strict = valid(kind, m)
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), at.cast("long").alias("start"), end.cast("long").alias("end"), (strict if base else F.lit(False)).alias("base"), F.lit(base).alias("strict"),
        _vote(strict if base else F.lit(False), ~strict).alias("regex"), listed.alias("gazetteer"), context.alias("context"), edges.alias("edges"), F.when(fits, 1).otherwise(-1).alias("shape"),
        F.substring(F.regexp_replace(F.regexp_replace(m, r"[\p{L}0-9]+", ""), r"(.)\1+", "$1"), 1, 4).alias("marks"), F.least(F.length(d), F.lit(20)).alias("digits"))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and spans, an array of the described candidates."""
    text = F.coalesce("text", F.lit(""))

    def described(kind: str, pattern: str, base: bool) -> Column:
        return F.transform(F.filter(matches(text, pattern), lambda x: _possible(kind, x["m"])), lambda x: _described(kind, x, base))

    lists = [described(k, p, base) for group, base in ((STRICT, True), (WIDE, False)) for k, p in group.items()]
    return docs.select("doc_id", F.concat(*lists).alias("spans"))


def _reliabilities(patterns: dict[tuple[int, ...], int]) -> dict[tuple[int, ...], float]:
    """Probability of each vote pattern, by expectation-maximisation."""
    p = {v: 1 / (1 + math.exp(-1.5 * sum(v))) for v in patterns}
    for _ in range(ROUNDS):
        yes, no = sum(p[v] * n for v, n in patterns.items()), sum((1 - p[v]) * n for v, n in patterns.items())
        tables = []
        for j in range(len(VOTES)):
            tables.append({x: ((sum(p[v] * n for v, n in patterns.items() if v[j] == x) + 1) / (yes + 3), (sum((1 - p[v]) * n for v, n in patterns.items() if v[j] == x) + 1) / (no + 3)) for x in (-1, 0, 1)})
        odds = math.log((yes + 1) / (no + 1))
        p = {v: 1 / (1 + math.exp(-max(-30.0, min(30.0, odds + sum(math.log(a / b) for a, b in (t[x] for t, x in zip(tables, v))))))) for v in patterns}
    return p


def _feature_counts(learned: DataFrame, feature: str) -> list:
    """kind, value, yes, no of a feature: the MOST_VALUES commonest values of each kind, and a row of null value that counts its others."""
    counted = learned.groupBy("kind", F.col(feature).cast("string").alias("value")).agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc(F.col("yes") + F.col("no")), "value"))
    named = counted.withColumn("place", place).withColumn("value", F.when(F.col("place") <= MOST_VALUES, F.col("value")))
    return named.groupBy("kind", "value").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect()


def _accepted(spans: DataFrame) -> tuple[Column, Column]:
    """(probability by votes, log odds of the classifier) of the span s, as expressions over tables that the driver has estimated."""
    spark = spans.sparkSession
    every = spans.select(F.explode("spans").alias("s")).select("s.*")
    counted = every.groupBy("kind", *VOTES).count().collect()
    posterior = {}
    for kind in {r["kind"] for r in counted}:
        found = _reliabilities({tuple(r[v] for v in VOTES): r["count"] for r in counted if r["kind"] == kind})
        posterior |= {(kind, *v): p for v, p in found.items()}
    sent = spark.createDataFrame([(*k, p) for k, p in posterior.items()] or [(0, 0, 0, 0, 0, 0, 0.0)], ", ".join(f"{c} int" for c in ("kind", *VOTES)) + ", p double")
    learned = every.join(F.broadcast(sent), ["kind", *VOTES])
    tables = {}
    for f in FEATURES:
        rows = _feature_counts(learned, f)
        totals = {}
        for r in rows:
            a, b, c = totals.get(r["kind"], (0.0, 0.0, 1))
            totals[r["kind"]] = (a + r["yes"], b + r["no"], c + 1)
        tables[f] = {str(r["kind"]) if r["value"] is None else f"{r['kind']}:{r['value']}": math.log((r["yes"] + 1) / (totals[r["kind"]][0] + totals[r["kind"]][2])) - math.log((r["no"] + 1) / (totals[r["kind"]][1] + totals[r["kind"]][2])) for r in rows}
        prior = {str(k): math.log((a + 1) / (b + 1)) for k, (a, b, _) in totals.items()}

    def known(table: dict[str, float]) -> Column:
        return F.create_map(*(F.lit(x) for kv in table.items() for x in kv)) if table else F.create_map(F.lit(""), F.lit(0.0))

    votes = known({":".join(map(str, k)): p for k, p in posterior.items()})

    def by_votes(s: Column) -> Column:
        return F.coalesce(votes[F.concat_ws(":", s["kind"], *(s[v] for v in VOTES))], F.lit(0.0))

    def odds(s: Column) -> Column:
        parts = [F.coalesce(known(tables[f])[F.concat_ws(":", s["kind"], s[f].cast("string"))], known(tables[f])[s["kind"].cast("string")], F.lit(0.0)) for f in FEATURES]
        return sum(parts, F.coalesce(known(prior)[s["kind"].cast("string")], F.lit(0.0)))

    return by_votes, odds


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the base spans as kind:start:end), spans (all, as kind:start:end) and n_spans for each row of docs.

    docs: doc_id, text; other columns are ignored. A null text counts as empty: no spans, and the digest is that of the empty string. Rows
    that repeat or have no doc_id get a row each. Of equal starts the kinds come in the order of KINDS. An empty table gives no rows.
    """
    found = written(candidates(docs.select("doc_id", "text")), "spans")
    by_votes, odds = _accepted(found)
    base = F.filter("spans", lambda s: s["base"])
    apart = lambda s, of: ~F.exists(of, lambda b: (b["kind"] == s["kind"]) & (b["start"] < s["end"]) & (s["start"] < b["end"]))
    added = _let(base, lambda of: F.filter("spans", lambda s: ~s["base"] & (~s["strict"]) & (by_votes(s) >= 0.5) & (odds(s) >= math.log(ACCEPT / (1 - ACCEPT))) & apart(s, of)))
    out = found.select(
        "doc_id", *(_count(base, i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.concat(base, added)).alias("spans"))
    return out.withColumn("n_spans", F.when(F.col("spans") == "", 0).otherwise(F.regexp_count("spans", F.lit(",")) + 1).cast("long"))
