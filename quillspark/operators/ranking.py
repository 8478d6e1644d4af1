"""Ranking: BM25 over pools, source rank, top-k per kind, dense ids, term coverage, videos, budgeted choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EDU_CHANNELS, KINDS
from ..functions.media import recency_bonus
from ..functions.text import term_hits, tokens, word_rows
from ..sources.shared import kept

K1, B = 1.5, 0.75


def term_counts(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, term, tf (count of the term)."""
    return word_rows(docs, keys, text).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, keys: list[str], pool: list[str], query_keys: list[str], text: str = "text") -> DataFrame:
    """Scores of the documents of a pool for its queries, those that match.

    docs: keys (with pool among them) and text; queries: pool, query_keys, query. Terms that no query of the pool has are counted together, before any
    shuffle, as the empty term, of which each document also has one occurrence too many. So a document has a row for each term asked for and one
    more, and its length is their sum. Statistics of pools and terms read the same exchange as the scores.
    """
    asked = queries.select(*pool, *query_keys, F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    wanted = asked.select(*pool, "term").unionByName(queries.select(*pool, F.lit("").alias("term"))).distinct().withColumn("_wanted", F.lit(True))
    pools = wanted.select(*pool, F.lit(True).alias("_asked")).distinct()
    held = word_rows(docs.join(pools, pool, "left_semi") if pool else docs, keys, text, marked=True).join(wanted, [*pool, "term"], "left")
    counted = held.groupBy(*keys, F.when(F.col("_wanted"), F.col("term")).otherwise("").alias("term")).agg(F.count("*").alias("tf"))
    tf = counted.withColumn("len", F.greatest(F.lit(1).cast("long"), F.sum("tf").over(Window.partitionBy(*keys)) - 1))
    by_term = tf.groupBy(*pool, "term").agg(F.sum(F.when(F.col("tf") > 0, 1)).alias("df"), F.avg(F.when(F.col("tf") > 0, F.col("len"))).alias("_mean"))
    whole = lambda c: F.max(F.when(F.col("term") == "", F.col(c)))
    sizes = (by_term.groupBy(*pool) if pool else by_term.groupBy()).agg(whole("df").alias("n"), whole("_mean").alias("avg_len"), F.max("df").alias("_df"))
    joined = tf.join(by_term.select(*pool, "term", "df", "_mean"), [*pool, "term"]).join(asked, [*pool, "term"])
    joined = joined.join(sizes, pool) if pool else joined.crossJoin(F.broadcast(sizes))  # sizes is one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return joined.groupBy(*keys, *query_keys).agg(F.sum(part).alias("score"))


def relevance(terms: Column, title: Column, text: Column) -> Column:
    return term_hits(terms, F.concat_ws(" ", title, F.substring(text, 1, 800))) / F.greatest(F.lit(1), F.size(terms))


def source_rank(trust: Column, relevance_: Column, date: Column, cited_by: Column, this_year: int) -> Column:
    return 0.45 * trust + 0.45 * relevance_ + recency_bonus(date, this_year) + F.log10(F.coalesce(cited_by, F.lit(0)) + 1) / 10


def kind_order(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int")


def top_per_kind(sources: DataFrame, caps: dict[str, int], topic: list[str], rank: str = "rank", order: str = "ord", rest: int = 99) -> DataFrame:
    """The best of each kind of a topic, with place; ties by order."""
    cap = F.lit(rest)
    for kind, n in caps.items():
        cap = F.when(F.col("kind") == kind, n).otherwise(cap)
    w = Window.partitionBy(*topic, "kind").orderBy(F.desc(rank), order)
    return sources.withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap)


def dense_ids(chosen: DataFrame, topic: list[str]) -> DataFrame:
    """id 1..n in each topic: by kind, then by place. A topic has as many rows as top_per_kind leaves it."""
    w = Window.partitionBy(*topic).orderBy(kind_order(F.col("kind")), "place")
    return chosen.withColumn("id", F.row_number().over(w))


def ids_after(videos: DataFrame, numbered: DataFrame, topic: list[str]) -> DataFrame:
    """Picked videos with ids that go on after those of a topic's sources."""
    last = numbered.groupBy(*topic).agg(F.max("id").alias("_last"))
    return videos.join(last, topic, "left").withColumn("id", F.coalesce("_last", F.lit(0)) + F.col("place")).drop("_last")


def containment(terms: DataFrame, sources: DataFrame, topic: list[str]) -> DataFrame:
    """topic, term, ord, source_id: the sources that hold all tokens of a term (topic, term, ord).

    Of the sources' tokens only those that some term has are kept. A term's rarest token proposes sources, and only these are asked for its others.
    """
    parts = terms.select(*topic, "term", "ord", F.array_distinct(tokens(F.col("term"), keep_stop=True)).alias("_p"))
    need = kept(parts.select(*topic, "term", "ord", F.size("_p").alias("need"), F.explode("_p").alias("token")), "need")
    every = sources.select(*topic, "source_id", F.explode(F.array_distinct(tokens(F.col("text"), keep_stop=True))).alias("token"))
    held = kept(every.join(need.select(*topic, "token").distinct(), [*topic, "token"], "left_semi"), "held")
    often = held.groupBy(*topic, "token").agg(F.count("*").alias("_df"))
    counted = need.join(often, [*topic, "token"], "left")
    rarest = counted.groupBy(*topic, "term", "ord", "need").agg(F.min_by("token", F.struct(F.coalesce("_df", F.lit(0)), "token")).alias("token"))
    proposed = rarest.join(held, [*topic, "token"])
    others = proposed.join(need.select(*topic, "term", "ord", F.col("token").alias("_other")), [*topic, "term", "ord"]).where("_other <> token")
    met = others.join(held.withColumnRenamed("token", "_other"), [*topic, "source_id", "_other"])
    full = met.groupBy(*topic, "term", "ord", "source_id", "need").agg(F.count("*").alias("_n")).where("_n = need - 1")
    alone = proposed.where("need = 1")
    return alone.select(*topic, "term", "ord", "source_id").unionByName(full.select(*topic, "term", "ord", "source_id"))


def term_coverage(terms: DataFrame, sources: DataFrame, topic: list[str]) -> DataFrame:
    """terms (topic, term, ord) with coverage: how many sources hold all tokens of the term. Terms of none go, unless all are."""
    terms = terms.where(F.size(tokens(F.col("term"), keep_stop=True)) > 0)
    counted = containment(terms, sources, topic).groupBy(*topic, "term", "ord").agg(F.count("*").alias("coverage"))
    out = terms.join(counted, [*topic, "term", "ord"], "left").withColumn("coverage", F.coalesce("coverage", F.lit(0)).cast("long"))
    any_ = counted.agg(F.max("coverage").alias("_any")) if not topic else counted.groupBy(*topic).agg(F.max("coverage").alias("_any"))
    out = out.join(any_, topic, "left") if topic else out.crossJoin(F.broadcast(any_))  # any_ is one row
    return out.where("coverage > 0 or _any is null").drop("_any")


def video_score(terms: Column, title: Column, text: Column, seconds: Column, views: Column, channel: Column, url: Column) -> Column:
    n = F.greatest(F.lit(1), F.size(terms))
    secs, name = F.coalesce(seconds, F.lit(0)), F.lower(F.coalesce(channel, F.lit("")))
    length = F.when(secs == 0, 0.0).when(secs < 120, -0.4).when(secs.between(300, 3600), 0.3).when(secs <= 5400, 0.1).otherwise(-0.2)
    known = F.exists(F.array(*map(F.lit, EDU_CHANNELS)), lambda c: name.contains(c))
    return (
        0.9 * term_hits(terms, title) / n + 0.3 * term_hits(terms, F.substring(text, 1, 400)) / n + length + F.least(F.lit(0.2), F.log10(F.coalesce(views, F.lit(0)) + 1) / 40)
        + F.when(known, 0.3).otherwise(0.0) - F.when(url.contains("/shorts/"), 0.5).otherwise(0.0))


def is_eligible_video(terms: Column, title: Column, text: Column, seconds: Column, url: Column) -> Column:
    secs = F.coalesce(seconds, F.lit(0))
    return (term_hits(terms, F.concat_ws(" ", title, F.substring(text, 1, 300))) > 0) & ~((secs > 0) & (secs < 90)) & ~url.contains("/shorts/")


def pick_videos(videos: DataFrame, topic: list[str], n: int) -> DataFrame:
    """Of scored, eligible videos (topic, score, publisher, ord) the best of each channel, then the n best."""
    a_channel = Window.partitionBy(*topic, F.lower("publisher")).orderBy(F.desc("score"), "ord")
    a_topic = Window.partitionBy(*topic).orderBy(F.desc("score"), "ord")
    first = videos.withColumn("_c", F.row_number().over(a_channel)).where("_c = 1").drop("_c")
    return first.withColumn("place", F.row_number().over(a_topic)).where(F.col("place") <= n).withColumn("relevance", F.round("score", 3))


def best_passages(scored: DataFrame, group: list[str], k: int, per_source: int) -> DataFrame:
    """The k best passages of a group with at most per_source of a source, without a budget of characters: two windows.

    Passages without a match come last, so a group without any match keeps one.
    """
    order = [F.desc("score"), "source_id", "idx"]
    capped = scored.withColumn("_s", F.row_number().over(Window.partitionBy(*group, "source_id").orderBy(*order))).where(F.col("_s") <= per_source)
    placed = capped.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return placed.where((F.col("place") <= k) & ((F.col("score") > 0) | (F.col("place") == 1))).drop("_s")


def budgeted_passages(scored: DataFrame, group: list[str], k: int, per_source: int, max_chars: int, texts: DataFrame | None = None) -> DataFrame:
    """As best_passages, but passages that would pass max_chars are left out and don't count; walked in order to the end.

    texts (group, source_id, idx, text) are read for the passages taken, by default from scored, which is then computed twice.

    The walk carries lengths only, and only of passages that it can take. A passage is rejected if an earlier one of its source, no longer than
    it, was rejected for its length, so per_source earlier ones of its source and length settle it. So do k * per_source earlier ones of
    its length that this leaves: k sources or more have each had one taken or are full. Lengths above max_chars, which only the first of
    all can have, are one class. This bounds the walk by max_chars, whatever the group's size.
    """
    best = [F.desc("score"), "source_id", "idx"]
    lengths = scored.select(*group, "source_id", "idx", "score", F.length("text").alias("_len")).withColumn("_class", F.least("_len", F.lit(max_chars + 1)))
    own = lengths.withColumn("_s", F.row_number().over(Window.partitionBy(*group, "_class", "source_id").orderBy(*best))).where(F.col("_s") <= per_source)
    able = own.withColumn("_c", F.row_number().over(Window.partitionBy(*group, "_class").orderBy(*best))).where(F.col("_c") <= k * per_source)
    rows = F.array_sort(F.collect_list(F.struct((-F.col("score").cast("double")).alias("worse"), F.col("source_id").cast("long").alias("source_id"), F.col("idx").cast("long").alias("idx"), F.col("_len").alias("len"))))
    kind = "struct<worse:double,source_id:bigint,idx:bigint,len:int>"
    state = F.struct(F.array().cast(f"array<{kind}>").alias("taken"), F.lit(0).cast("long").alias("chars"))

    def step(a: Column, x: Column) -> Column:
        of_source = F.size(F.filter(a["taken"], lambda t: t["source_id"] == x["source_id"]))
        fits = (F.size(a["taken"]) == 0) | (a["chars"] + x["len"] <= max_chars)
        take = (F.size(a["taken"]) < k) & (of_source < per_source) & fits & ((x["worse"] < 0) | (F.size(a["taken"]) == 0))
        return F.when(take, F.struct(F.concat(a["taken"], F.array(x)).alias("taken"), (a["chars"] + x["len"]).alias("chars"))).otherwise(a)

    taken = able.groupBy(*group).agg(rows.alias("_rows")).select(*group, F.explode(F.aggregate("_rows", state, step)["taken"]).alias("p")).select(*group, "p.source_id", "p.idx", (-F.col("p.worse")).alias("score"))
    typed = (scored if texts is None else texts).select(*group, F.col("source_id").cast("long").alias("source_id"), F.col("idx").cast("long").alias("idx"), "text")
    # At most k rows of each group; only their texts are read.
    return typed.join(taken, [*group, "source_id", "idx"]).select(*group, "source_id", F.col("idx").cast("int").alias("idx"), "text", "score")


def in_source_order(chosen: DataFrame, group: list[str]) -> DataFrame:
    """Chosen passages with at, their place in a group by source and index. A group has as many rows as were chosen for it."""
    return chosen.withColumn("at", F.row_number().over(Window.partitionBy(*group).orderBy("source_id", "idx")))


def extractive(passages: DataFrame, group: list[str], n: int = 4) -> DataFrame:
    """A body of the n best passages: excerpts with their source's tag, without a leading heading."""
    from ..functions.text import excerpt

    w = Window.partitionBy(*group).orderBy(F.desc("score"), "source_id", "idx")
    top = passages.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= n)
    line = F.concat(F.lit("- "), excerpt(F.regexp_replace("text", r"^=+ .*? =+\n", "")), F.lit(" [S"), F.col("source_id").cast("string"), F.lit("]"))
    rows = F.array_sort(F.collect_list(F.struct("_at", line.alias("line"))))
    return top.groupBy(*group).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("body"))

