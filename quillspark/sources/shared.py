"""Tables that are computed once and read many times, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a single process makes one of its own where it is unset, a cluster raises."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path is None:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="briefing-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is written there goes when the driver ends."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is not None and not sc._jsc.sc().isStopped():
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def kept(rows: DataFrame, name: str, used: Iterable[DataFrame] = ()) -> DataFrame:
    """rows, written as Parquet and read back. Then the files of used, kept before and not read any more, go; the others when the driver ends."""
    spark = rows.sparkSession
    path = new_folder(spark, name)
    rows.write.parquet(path)
    for old in used:
        delete(spark, old._kept_path)
    out = spark.read.schema(rows.schema).parquet(path)
    out._kept_path = path
    return out
