"""Bounded, deterministic samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def checksum_rest(divisor: int):
    """crc32 of doc_id as text, modulo divisor."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor))


def balanced(rows: DataFrame, label: str, most: int) -> DataFrame:
    """Of each label at most ``most`` (doc_id, label, place) rows, those of the smallest hash of doc_id.

    A label's rows are first thinned by the leading zeros of the hash, as far as ``most`` are left by their counts (64 a label), so of a
    label of any size some 2 * most light rows are ordered. Rows that share a hash are all kept by that step.
    """
    h = F.xxhash64("doc_id").bitwiseAND((1 << 63) - 1)
    keyed = rows.select("doc_id", label).withColumn("_h", h).withColumn("_zeros", F.lit(63) - F.length(F.regexp_replace(F.bin("_h"), "^0$", "")))
    sizes = keyed.groupBy(label, "_zeros").count()
    from_top = F.sum("count").over(Window.partitionBy(label).orderBy(F.desc("_zeros")))
    least = sizes.withColumn("_n", from_top).groupBy(label).agg(F.coalesce(F.max(F.when(F.col("_n") >= most, F.col("_zeros"))), F.lit(0)).alias("_least"))
    thin = keyed.join(F.broadcast(least), label).where("_zeros >= _least")  # a row for each label
    w = Window.partitionBy(label).orderBy("_h", "doc_id")
    return thin.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("doc_id", label, "place")
