"""The topic of a day: interests first, then what a day's feeds offer, then standing topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.safety import is_acceptable_topic
from ..sources.store import first_unseen

# Standing topics, in their order, and how many random articles are tried.
EVERGREEN = [
    "How vaccines train the immune system", "The Fermi paradox", "How GPS works", "Plate tectonics", "CRISPR gene editing", "The Dunning-Kruger effect", "How noise-cancelling headphones work",
    "Game theory and the prisoner's dilemma", "The history of zero", "How the internet routes data", "Photosynthesis", "Black holes", "The placebo effect", "Public-key cryptography", "The Haber process",
    "How memory works in the brain", "The printing press", "Entropy", "Supply and demand", "The scientific method", "How batteries work", "The Cambrian explosion", "Bayes' theorem", "Quantum entanglement",
    "The Silk Road", "How airplanes fly", "Antibiotic resistance", "The Rosetta Stone", "Machine learning", "Coral reefs"]
RANDOM_TRIES = 12
OWN, FEATURED, THIS_DAY, RANDOM, STANDING = range(5)


def interests(text: Column) -> Column:
    """The lines of a text that aren't blank or remarks."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), F.trim), lambda x: (x != "") & ~x.startswith("#"))


def standing_topic(seen: DataFrame, day: str, topics: list[str] = EVERGREEN) -> DataFrame:
    """topic: of the standing topics that aren't seen, or of all if each is, the one whose turn it is on a day. The list is short and fixed."""
    spark = seen.sparkSession
    listed = spark.createDataFrame(list(enumerate(topics)), "ord int, topic string").withColumn("_k", F.lower("topic"))
    left = listed.join(seen.select(F.col("topic").alias("_k")), "_k", "left_anti").agg(F.array_sort(F.collect_list(F.struct("ord", "topic"))).alias("_l"))
    names = F.when(F.size("_l") > 0, F.transform("_l", lambda t: t["topic"])).otherwise(F.array(*map(F.lit, topics)))
    days = F.datediff(F.lit(day).cast("date"), F.lit("1970-01-01").cast("date"))
    return left.select(F.element_at(names, F.pmod(days, F.size(names)) + 1).alias("topic"))


def pick_topic(own: DataFrame, offered: DataFrame, seen: DataFrame, day: str) -> DataFrame:
    """topic, why: one row. own: ord, topic; offered: priority (FEATURED to RANDOM), ord, topic, extract, kind, why; seen: topic in lower case."""
    fit = offered.where(is_acceptable_topic(F.col("topic"), F.col("extract"), F.col("kind")) & ((F.col("priority") != RANDOM) | (F.col("ord") < RANDOM_TRIES)))
    mine = own.select(F.lit(OWN).alias("priority"), "ord", "topic", F.lit("next unseen topic from your interests").alias("why"))
    first = first_unseen(mine.unionByName(fit.select("priority", "ord", "topic", "why")), seen)
    last = standing_topic(seen, day).select(F.lit(STANDING).alias("priority"), F.lit(0).alias("ord"), "topic", F.lit("evergreen list (Wikipedia was unreachable)").alias("why"))
    return first.unionByName(last).orderBy("priority").limit(1).select("topic", "why")
