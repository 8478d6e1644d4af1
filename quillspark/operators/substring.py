"""Searches for substrings, many in one job, over an index of grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept

#: So many ids at most, or about, stand in one row of equal texts or equal needles.
TOGETHER = 256
#: So many texts, and so many searches, of one gram meet in one group.
MET = 4096
#: So many pairs of texts and searches at most, or about, are left to one task.
PAIRS = 2**27


def folded(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def _cut(text: Column, n: int) -> Column:
    """The different grams of n characters."""
    places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, n)))


def _grams(t: Column) -> Column:
    return F.concat(F.array(F.lit("")), _cut(t, 1), _cut(t, 2), _cut(t, 3))


def grams(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, gram: the different grams of one to three characters of each folded text, and the empty one, which every text has."""
    return rows.select(*keys, F.explode(_grams(folded(F.col(text)))).alias("gram"))


def _together(rows: DataFrame, value: str, ids: list[str]) -> DataFrame:
    """value, _part, _ids: equal values in one row, or in a few of about TOGETHER ids each."""
    many = rows.groupBy(value).agg(F.count("*").alias("_n")).where(F.col("_n") > TOGETHER)  # a row for TOGETHER rows at most
    part = F.pmod(F.xxhash64(*ids), F.coalesce(F.ceil(F.col("_n") / TOGETHER), F.lit(1)))
    return rows.join(F.broadcast(many), value, "left").groupBy(value, part.alias("_part")).agg(F.collect_list(F.struct(*ids)).alias("_ids"))


def _groups(total: Column) -> Column:
    return F.ceil(total / MET).cast("long")


def find(searches: DataFrame, rows: DataFrame, index: DataFrame, keys: list[str], text: str) -> DataFrame:
    """search_id and keys of the rows (keys, text) that hold the needle of a search (search_id, needle), whatever the case; white space around it is ignored.

    index: grams() of rows, which may be kept; it tells the rarest gram of each needle. Only texts that have it are compared with the needle; a needle of
    one or two characters is a gram itself, and an empty one is in every text. A text travels once for each of its grams that is some needle's
    rarest, with the ids of all equal ones, so that what is found is not shuffled. Texts are titles or lines.
    """
    needle = F.trim(folded(F.col("needle")))
    # Equal texts are looked at once, as are equal needles; what is found is told to all of them where it is found.
    asked = kept(_together(searches.select("search_id", needle.alias("_needle")), "_needle", ["search_id"]).withColumnRenamed("_ids", "_searches"), "searches")
    texts = kept(_together(rows.select(*keys, folded(F.col(text)).alias("_text")), "_text", keys), "texts")
    of = F.when(F.length("_needle") < 3, F.array("_needle")).otherwise(_cut(F.col("_needle"), 3))
    wanted = asked.groupBy("_needle").agg(F.sum(F.size("_searches")).alias("_n")).select("_needle", "_n", F.explode(of).alias("gram"))
    often = index.groupBy("gram").agg(F.count("*").alias("_df"))
    rarest = F.min(F.struct(F.coalesce("_df", F.lit(0)).alias("_df"), "gram")).alias("_r")
    rare = kept(wanted.join(often, "gram", "left").groupBy("_needle", "_n").agg(rarest).select("_needle", "_n", "_r.*").where("_df > 0"), "rare")
    # The texts and the needles of a gram are dealt over as many groups each as their numbers need; each group of the ones meets each of the others.
    sums = rare.groupBy("gram").agg(F.first("_df").alias("_df"), F.sum("_n").alias("_n"))
    looked = kept(sums.select("gram", F.col("_df") * F.col("_n"), _groups(F.col("_df")).alias("_rows"), _groups(F.col("_n")).alias("_columns")).toDF("gram", "_pairs", "_rows", "_columns"), "looked")
    pairs = looked.agg(F.sum("_pairs")).first()[0] or 0
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // PAIRS))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    one = lambda n, value: F.pmod(F.xxhash64(value, "_part"), F.col(n))
    place = ["gram", "_row", "_column"]
    left = asked.join(rare.select("_needle", "gram"), "_needle").join(looked, "gram").select("gram", each("_rows").alias("_row"), one("_columns", "_needle").alias("_column"), "_needle", "_searches")
    held = texts.select("*", F.explode(_grams(F.col("_text"))).alias("gram")).join(looked, "gram")
    right = held.select("gram", one("_rows", "_text").alias("_row"), each("_columns").alias("_column"), "_text", "_ids")
    met = left.repartition(tasks, *place).join(right.repartition(tasks, *place), place).where(F.col("_text").contains(F.col("_needle")))
    found = kept(met.select("_searches", "_ids"), "found", [asked, rare, looked])
    return found.select(F.explode("_searches.search_id").alias("search_id"), "_ids").select("search_id", F.inline("_ids"))
