"""Reading tables and cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a single process makes one of its own, and a cluster is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quillspark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh shared path, deleted when the driver ends."""
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session or its JVM has gone already
        pass


def written(df: DataFrame, what: str, used: Iterable[DataFrame] = ()) -> DataFrame:
    """df, computed once: written as Parquet to the shared folder and read back. Then the folders of used, written before, are deleted."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.parquet(path)
    for old in used:
        _delete(spark, old._shared_path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def sweep(spark: SparkSession) -> None:
    """Has the driver drop what finished steps leave: their plans, and the shuffles and broadcasts that executors hold as long as these live."""
    spark.sparkContext._jvm.System.gc()
