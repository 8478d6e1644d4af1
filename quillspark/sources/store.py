"""Captured payloads and the library of reports, as Parquet tables: upserts, reads with a time to live, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Hours that payloads of a namespace are good for; others DEFAULT_HOURS.
HOURS = {"news": 6, "web": 12, "video": 24, "llm": 720, "transcript": 720}
DEFAULT_HOURS, PRUNE_DAYS = 168, 30


def cache_key(ns: Column, key: Column) -> Column:
    return F.concat_ws(":", ns, F.sha2(key, 256))


def latest(rows: DataFrame, keys: list[str], at: str, *ties: str) -> DataFrame:
    """The latest row of each key. As a partial aggregate, so that a hot key is reduced before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    order = F.struct(F.col(at).alias("_at"), *(F.col(t).alias(f"_{i}") for i, t in enumerate(ties)))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(*rows.columns)


def upsert(table: DataFrame | None, rows: DataFrame, keys: list[str], at: str, *ties: str) -> DataFrame:
    return latest(rows if table is None else table.unionByName(rows), keys, at, *ties)


def ttl_hours(ns: Column, hours: dict[str, int] | None = None) -> Column:
    out = F.lit(DEFAULT_HOURS)
    for name, h in (HOURS if hours is None else hours).items():
        out = F.when(ns == name, h).otherwise(out)
    return out


def fresh(table: DataFrame, now: str, hours: dict[str, int] | None = None, ns: str = "ns", at: str = "t") -> DataFrame:
    """Entries that are still good at a time; the time to live is chosen when reading."""
    age = F.unix_micros(F.to_timestamp(F.lit(now))) - F.unix_micros(F.col(at).cast("timestamp"))
    return table.where(age <= ttl_hours(F.col(ns), hours).cast("long") * 3_600_000_000)


def pruned(table: DataFrame, now: str, days: int = PRUNE_DAYS, at: str = "t") -> DataFrame:
    return table.where(F.col(at).cast("timestamp") >= F.to_timestamp(F.lit(now)) - F.make_interval(days=F.lit(days)))


def delete(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return table.join(ids, key, "left_anti")


def listed(library: DataFrame, most: int | None = None) -> DataFrame:
    """Reports, newest first; missing dates count as the oldest."""
    out = library.orderBy(F.coalesce(F.unix_micros("created_at"), F.lit(0)).desc(), "id")
    return out if most is None else out.limit(most)


def studied(library: DataFrame) -> DataFrame:
    return library.select(F.lower("topic").alias("topic")).distinct()


def search(library: DataFrame, text: str) -> DataFrame:
    return library.where(F.lower("topic").contains(text.strip().lower()))


def write_library(library: DataFrame, path: str) -> None:
    library.write.mode("overwrite").parquet(path)


def export_json(library: DataFrame, path: str) -> None:
    library.write.mode("overwrite").json(path)


def file_name(date: Column, topic: Column) -> Column:
    from ..functions.text import slugify

    return F.concat_ws("-", date, slugify(topic))


def model_usage(calls: DataFrame) -> DataFrame:
    return calls.groupBy("model").agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "model")


def model_chain(chain: DataFrame, models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the chosen models with what is known of them, the models that aren't chosen)."""
    return chain.join(models, "id", "left").orderBy("ord"), models.join(chain, "id", "left_anti")


def first_unseen(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """The first candidate (priority, ord, topic) whose topic isn't in seen (lower case)."""
    left = candidates.withColumn("_k", F.lower("topic")).join(seen.select(F.col("topic").alias("_k")), "_k", "left_anti").drop("_k")
    return left.orderBy("priority", "ord").limit(1)


def ordinal_pick(topics: DataFrame, seen: DataFrame, day: str) -> DataFrame:
    """Of the unseen topics (ord, topic) the one whose turn it is: days since 1970 modulo their number."""
    left = topics.withColumn("_k", F.lower("topic")).join(seen.select(F.col("topic").alias("_k")), "_k", "left_anti").drop("_k")
    # The list of standing topics is short and fixed.
    listed_ = left.agg(F.array_sort(F.collect_list(F.struct("ord", "topic"))).alias("l"))
    turn = F.pmod(F.datediff(F.lit(day).cast("date"), F.lit("1970-01-01").cast("date")), F.size("l"))
    return listed_.where(F.size("l") > 0).select(F.element_at("l", turn + 1)["topic"].alias("topic"))


def summary(sources: DataFrame, refs: DataFrame, report: list[str]) -> DataFrame:
    """report, cited, total: how many sources a report cites and has."""
    total = sources.groupBy(*report).agg(F.count("*").alias("total"))
    return total.join(refs.groupBy(*report).agg(F.count("*").alias("cited")), report, "left").select(*report, F.coalesce("cited", F.lit(0)).cast("long").alias("cited"), "total")
