"""The payload cache as a kept table: batches by bucket of the key and day, committed by manifests, compacted and pruned.

data/version=v/bucket=b/day=d: the rows of one batch. manifests/n.json: the versions that make up the table, in order; the largest complete number counts.
A batch is written whole before its manifest is created, and a manifest is only created if none has its number. So a writer that dies before
committing leaves the table as it was, a reader sees whole batches only, and of two writers one must begin anew. What no manifest names is
swept away by vacuum().
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import DEFAULT_HOURS, HOURS, PRUNE_DAYS, fresh, latest

BUCKETS = 64


class Conflict(Exception):
    """Another writer has committed first."""


@dataclass
class CacheTable:
    """columns: the schema of rows, among them ns, key and t (a timestamp), as DDL."""

    spark: SparkSession
    path: str
    columns: str
    buckets: int = BUCKETS

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _bucket(self, ns: Column, key: Column) -> Column:
        return F.pmod(F.xxhash64(ns, key), F.lit(self.buckets)).cast("int")

    def _manifest(self) -> tuple[int, list[str]]:
        """Number and versions of the newest manifest that is complete."""
        fs, where = self._fs(f"{self.path}/manifests")
        if not fs.exists(where):
            return 0, []
        numbers = sorted((int(s.getPath().getName()[:-5]) for s in fs.listStatus(where) if s.getPath().getName().endswith(".json")), reverse=True)
        for n in numbers:
            lines = [r[0] for r in self.spark.read.text(f"{self.path}/manifests/{n:08d}.json").collect()]
            try:
                return n, json.loads("".join(lines))["versions"]
            except ValueError:  # its writer died
                continue
        return 0, []

    def _commit(self, after: int, versions: list[str]) -> None:
        number = after + 1
        while True:
            fs, where = self._fs(f"{self.path}/manifests/{number:08d}.json")
            try:
                out = fs.create(where, False)
            except Exception as error:
                if self._manifest()[0] > after or number > after + 1:
                    raise Conflict(where.toString()) from error
                number += 1  # an incomplete one of a writer that died
                continue
            out.write(bytearray((json.dumps({"versions": versions}) + "\n").encode()))
            out.close()
            return

    def _write(self, rows: DataFrame) -> str:
        version = uuid.uuid4().hex
        made = rows.withColumns({"bucket": self._bucket(F.col("ns"), F.col("key")), "day": F.to_date("t")})
        made.repartition("bucket", "day", F.pmod(F.xxhash64("key", "t"), F.lit(8))).write.partitionBy("bucket", "day").parquet(f"{self.path}/data/version={version}")
        return version

    def _rows(self, versions: list[str]) -> DataFrame:
        kinds = f"{self.columns}, version string, bucket int, day date"
        if not versions:
            return self.spark.createDataFrame([], kinds)
        return self.spark.read.schema(kinds).option("basePath", f"{self.path}/data").parquet(*(f"{self.path}/data/version={v}" for v in versions))

    def _latest(self, versions: list[str], rows: DataFrame) -> DataFrame:
        """The newest row of each key; of one time the one written last."""
        at = F.array_position(F.array(*map(F.lit, versions)), F.col("version")) if versions else F.lit(0)
        return latest(rows.withColumn("_version", at).drop("version", "bucket", "day"), ["ns", "key"], "t", "_version").drop("_version")

    def upsert(self, rows: DataFrame) -> None:
        """Adds a batch; reads take the newest row of each key."""
        after, versions = self._manifest()
        self._commit(after, [*versions, self._write(rows)])

    def read(self) -> DataFrame:
        _, versions = self._manifest()
        return self._latest(versions, self._rows(versions))

    def get(self, ns: str, key: str, now: str, hours: dict[str, int] | None = None) -> DataFrame:
        """The row of one key if it is still good: one bucket is read, and of it the days within the time to live."""
        _, versions = self._manifest()
        known = HOURS if hours is None else hours
        bucket = self.spark.range(1).select(self._bucket(F.lit(ns), F.lit(key))).first()[0]
        since = F.to_date(F.to_timestamp(F.lit(now)) - F.make_interval(hours=F.lit(known.get(ns, DEFAULT_HOURS))))
        rows = self._rows(versions).where((F.col("bucket") == bucket) & (F.col("ns") == ns) & (F.col("key") == key) & (F.col("day") >= since))
        return fresh(self._latest(versions, rows), now, hours)

    def compact(self, now: str | None = None, days: int = PRUNE_DAYS) -> None:
        """One version of the newest rows in place of all; with now, rows of days before the last ``days`` go, by their folders."""
        after, versions = self._manifest()
        rows = self._rows(versions)
        if now is not None:
            since = F.to_timestamp(F.lit(now)) - F.make_interval(days=F.lit(days))
            rows = rows.where((F.col("day") >= F.to_date(since)) & (F.col("t") >= since))
        self._commit(after, [self._write(self._latest(versions, rows))])

    def vacuum(self) -> int:
        """Deletes versions that the newest manifest doesn't name, and older manifests; for a time without writers. How many versions went."""
        number, versions = self._manifest()
        fs, where = self._fs(f"{self.path}/data")
        gone = [s.getPath() for s in fs.listStatus(where) if s.getPath().getName().removeprefix("version=") not in versions] if fs.exists(where) else []
        for old in gone:
            fs.delete(old, True)
        fs, where = self._fs(f"{self.path}/manifests")
        for s in fs.listStatus(where) if fs.exists(where) else []:
            if int(s.getPath().getName()[:-5]) < number:
                fs.delete(s.getPath(), False)
        return len(gone)
