"""Citations: normalising, checking, renumbering, and lexical support of cited sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import counted_words
from ..sources.shared import kept

SUPPORT, LEAST_WORDS = 0.35, 5
_GROUP = r"(?i)[\[【［]\s*(S\d+(?:\s*[,;/&]\s*S\d+)*)\s*[\]】］]"
_NUMBER = r"(?<![A-Za-z0-9_.])\d[\d,]*(?:\.\d+)?(?![A-Za-z0-9_])"
_SENTENCE = r"[^\n]+?[.!?]+(?=\s|\z|\[)(?:\s*\[S\d+\])*|[^\n]+(?=\n|\z)"


def normalize(text: Column) -> Column:
    """Groups such as ``[S1, s2]``, in any of three kinds of brackets, as ``[S1][S2]``."""
    t = F.coalesce(text, F.lit(""))
    groups = F.array_distinct(F.regexp_extract_all(t, F.lit(_GROUP), F.lit(0)))
    single = lambda g: F.array_join(F.transform(F.regexp_extract_all(g, F.lit(r"(?i)S(\d+)"), F.lit(1)), lambda n: F.concat(F.lit("[S"), n, F.lit("]"))), "")
    return F.aggregate(groups, t, lambda a, g: F.replace(a, g, single(g)))


def find_ids(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[S(\d+)\]"), F.lit(1)), lambda x: x.cast("long"))


def strip_invalid(text: Column, valid: Column) -> Column:
    """struct(text, removed): without citations of ids that aren't valid, and how many there were."""
    t = normalize(text)
    ids = find_ids(t)
    bad = F.filter(ids, lambda i: ~F.array_contains(valid, i))
    left = F.aggregate(F.array_distinct(bad), t, lambda a, i: F.replace(a, F.concat(F.lit("[S"), i.cast("string"), F.lit("]")), F.lit("")))
    tidy = F.regexp_replace(F.regexp_replace(left, r"[ \t]+([.,;:!?])", "$1"), r"[ \t]{2,}", " ")
    return F.struct(tidy.alias("text"), F.size(bad).cast("long").alias("removed"))


def renumber(texts: DataFrame, report: list[str], order: list[str], text: str = "text") -> DataFrame:
    """report, id, n: the ids cited in a report's texts, numbered by first appearance."""
    cited = texts.select(*report, *order, F.posexplode(find_ids(F.col(text))).alias("_pos", "id"))
    first = cited.groupBy(*report, "id").agg(F.min(F.struct(*order, "_pos")).alias("_first"))
    return first.select(*report, "id", F.row_number().over(Window.partitionBy(*report).orderBy("_first")).alias("n"))


def apply_mapping(text: Column, mapping: Column) -> Column:
    """mapping: id -> number. Cited ids become their numbers, others go."""
    t = F.coalesce(text, F.lit(""))
    # Numbers are marked while ids are still being replaced.
    swapped = F.aggregate(F.map_entries(mapping), t, lambda a, e: F.replace(a, F.concat(F.lit("[S"), e["key"].cast("string"), F.lit("]")), F.concat(F.lit("["), e["value"].cast("string"), F.lit("]"))))
    return F.regexp_replace(swapped, r"\[S\d+\]", "")


def clean_body(text: Column, valid: Column) -> Column:
    """strip_invalid, without heading lines."""
    kept = F.filter(F.split(strip_invalid(text, valid)["text"], "\n"), lambda line: ~line.rlike(r"^\s*#{1,6}\s"))
    return F.regexp_replace(F.array_join(kept, "\n"), r"(?U)^\s+|\s+\z", "")


def sentences(text: Column) -> Column:
    """Sentences of each line, tags after the stop belonging to the sentence; a line's rest is one too."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_SENTENCE), F.lit(0))


def _runs(sources: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pair, run: the runs of digits and points of each text without its commas, by every two characters that stand together in them."""
    runs = F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.coalesce("text", F.lit("")), ",", ""), F.lit(r"[0-9.]{2,}"), F.lit(0)))
    each = sources.select(*keys, F.explode(runs).alias("run"))
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("run") - 1), lambda i: F.substring("run", i, 2)))
    return each.select(*keys, "run", F.explode(pairs).alias("pair"))


def missing_numbers(asked: DataFrame, sources: DataFrame, keys: list[str], row: list[str]) -> DataFrame:
    """row of those asked (row, keys, number) whose number is nowhere in the text of its source (keys, text), commas in either left out.

    A number lies within one run of digits and points. It meets the runs of its source that hold its first two characters, and only these.
    """
    bare = asked.withColumn("_n", F.regexp_replace("number", ",", "")).withColumn("pair", F.substring("_n", 1, 2))
    seen = bare.join(_runs(sources, keys), [*keys, "pair"]).where(F.col("run").contains(F.col("_n"))).select(*row).distinct()
    return asked.select(*row).distinct().join(seen, row, "left_anti")


def support_check(texts: DataFrame, sources: DataFrame, report: list[str]) -> DataFrame:
    """A row for each checked sentence: report, text_ord, ord, sentence, ids, overlap, missing (numbers), flagged.

    texts: report, text_ord, text. sources: report, source_id, text. Sentences without an id of a source, or with fewer than five content
    words, aren't checked.

    Sentences and sources meet as rows of single words, by (source, word), so no text or set of words is carried to a sentence, and what cites one
    source is spread over its words. Words are counted where their sentence or source is read, and short sentences go there. A sentence's row of the
    empty word meets that of each source it cites. Numbers meet runs of digits, those of checked sentences only. A sentence gets
    counts back.
    """
    key, of_source = [*report, "text_ord", "ord"], [*report, "source_id"]
    cut = texts.select(*report, "text_ord", F.posexplode(sentences(normalize(F.col("text")))).alias("ord", "raw"))
    plain = F.regexp_replace("raw", r"\[S\d+\]", "")
    numbers = F.filter(F.regexp_extract_all("plain", F.lit(_NUMBER), F.lit(0)), lambda x: F.length(F.regexp_replace(x, "[,.]", "")) >= 2)
    found = cut.select(*key, plain.alias("plain"), F.array_distinct(find_ids(F.col("raw"))).alias("cited")).where(F.size("cited") > 0)
    found = kept(found.withColumn("numbers", numbers), "found")
    texts_of = sources.select(*report, F.col("source_id").cast("long").alias("source_id"), "text")

    stop = frozenset(_stop())
    content = lambda t: len(t) >= 4 and t not in stop
    asked = counted_words(found, [*key, "cited"], "plain", name="word", only=content, least=LEAST_WORDS)
    asked = asked.select(*key, "word", "tf", "len", F.explode("cited").alias("source_id"))
    held = counted_words(texts_of, of_source, keep_stop=True, name="word", only=content).select(*of_source, "word")
    # A word counts once, however many of the sentence's sources have it; both steps go by one shuffle. A sentence has a bounded number of words.
    met = asked.join(held, [*of_source, "word"]).repartition(*key)
    met = met.groupBy(*key, "word").agg(F.max("tf").alias("tf"), F.max("len").alias("len"), F.collect_set(F.when(F.col("word") == "", F.col("source_id"))).alias("_known"))
    met = met.groupBy(*key).agg(F.sum("tf").alias("_hits"), F.max("len").alias("_words"), F.max(F.when(F.col("word") == "", F.col("_known"))).alias("_known"))
    valid = F.filter("cited", lambda i: F.array_contains("_known", i))
    checked = kept(found.drop("plain").join(met, key).select(*key, "numbers", valid.alias("ids"), (F.col("_hits") / F.col("_words")).alias("overlap")), "checked")

    told = checked.select(*key, "ids", F.posexplode("numbers").alias("_k", "number"))
    row = [*key, "_k"]
    some = told.select(*row, "number", F.explode("ids").alias("source_id"))
    # Missing is what none of the sentence's sources has: a number that one of them lacks counts once for each.
    lacking = missing_numbers(some, texts_of, of_source, [*row, "source_id"]).groupBy(*row).agg(F.count("*").alias("_lacking"))
    lost = told.join(lacking, row).where(F.col("_lacking") == F.size("ids")).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "number"))), lambda x: x["number"]).alias("_missing"))
    # Sentences themselves are shuffled here only.
    out = found.select(*key, "plain").join(checked.drop("numbers"), key).join(lost, key, "left")
    out = out.select(*key, F.regexp_replace("plain", r"(?U)^\s+|\s+\z", "").alias("sentence"), "ids", "overlap", F.slice(F.coalesce("_missing", F.array().cast("array<string>")), 1, 4).alias("missing"))
    return out.withColumn("flagged", (F.col("overlap") < SUPPORT) | (F.size("missing") > 0))


def _stop() -> list[str]:
    from ..config import STOPWORDS

    return STOPWORDS


def describe_flag() -> Column:
    """The line that tells why a checked sentence is flagged."""
    why = F.concat_ws(
        "; ", F.when(F.size("missing") > 0, F.concat(F.lit("number(s) not found in cited source: "), F.array_join("missing", ", "))),
        F.when(F.col("overlap") < SUPPORT, F.concat(F.lit("low word overlap with cited source ("), F.floor(F.col("overlap") * 100 + 0.5).cast("string"), F.lit("%)"))))
    short = F.when(F.length("sentence") <= 160, F.col("sentence")).otherwise(F.concat(F.substring("sentence", 1, 157), F.lit("...")))
    return F.concat(F.lit("“"), short, F.lit("” — "), why)


def verification(checked: DataFrame, report: list[str], most: int = 8) -> DataFrame:
    """report, checked, flagged, distinct_flagged, lines, summary: counts, the first flags of different sentences, and the line that tells the counts."""
    rows = checked.withColumn("text", describe_flag())
    counts = rows.groupBy(*report).agg(F.count("*").alias("checked"), F.sum(F.col("flagged").cast("long")).alias("flagged"), F.count_distinct(F.when(F.col("flagged"), F.col("sentence"))).alias("distinct_flagged"))
    flags = rows.where("flagged").groupBy(*report, "sentence").agg(F.min(F.struct("text_ord", "ord", "text")).alias("f"))
    w = Window.partitionBy(*report).orderBy("f")
    first = flags.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= most)
    lines = first.groupBy(*report).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.col("f.text").alias("text")))), lambda x: x["text"]).alias("lines"))
    return counts.join(lines, report, "left").withColumns({"lines": F.coalesce("lines", F.array().cast("array<string>")), "summary": counts_line()})


def counts_line() -> Column:
    # Fixed value: the wording.
    return F.format_string(
        "%d of %d cited sentences have strong word overlap with the source they cite; %d distinct sentence(s) are flagged below for you to check against the source.",
        F.col("checked") - F.col("flagged"), F.col("checked"), F.col("distinct_flagged"))
