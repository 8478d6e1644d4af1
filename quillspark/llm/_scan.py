"""Running sums over groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._io import written

#: Rows in all that are ordered group by group; more are dealt out by ranges.
SMALL = 10_000


def running(rows: DataFrame, group: list[str], order: list[Column], small: int = SMALL, **sums: str) -> DataFrame:
    """rows with, for each name, the sum of a column over the rows of its group that come before in order.

    More than ``small`` rows are dealt out by ranges of (group, order), so a group may fill many tasks; only sums of each range and group meet.
    order must tell the rows of a group apart: rows of equal order are taken in any order.
    """
    spark = rows.sparkSession
    held = written(rows, "rows")
    if held.count() <= small:
        earlier = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return held.withColumns({name: F.coalesce(F.sum(c).over(earlier), F.lit(0)) for name, c in sums.items()})
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = written(held.repartitionByRange(ranges, *group, *order).withColumn("_range", F.spark_partition_id()), "ranges", [held])
    each = placed.groupBy(*group, "_range").agg(*(F.sum(c).alias(f"_{name}") for name, c in sums.items()))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = each.select(*group, "_range", *(F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}") for name in sums))
    inside = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    told = placed.join(before, [*group, "_range"])
    return told.withColumns({name: F.col(f"_{name}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for name, c in sums.items()}).drop("_range", *(f"_{name}" for name in sums))
