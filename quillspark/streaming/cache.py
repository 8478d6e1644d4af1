"""A payload table kept up to date from a stream of captured answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import latest


def keep_latest(stream: DataFrame, path: str, checkpoint: str, keys: list[str], at: str, delay: str = "1 hour") -> StreamingQuery:
    """Appends each micro-batch's latest row of each key; a reader takes the latest over all (sources.store.latest).

    A batch that is replayed overwrites its own folder, so that each batch is in the table once.
    """

    def put(batch: DataFrame, number: int) -> None:
        latest(batch, keys, at).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.withWatermark(at, delay).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(stream: DataFrame, at: str, key: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Captured answers of each namespace and window; late ones up to ``delay`` count."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, width), key).agg(F.count("*").alias("n"))
