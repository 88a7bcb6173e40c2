"""Shared-folder tables that cut lineage, and row keys that survive recomputation.

Every intermediate result that is used twice is written as Parquet to the folder
named by ``spark.checkpoint.dir``.  All executors and the driver see that folder,
so a lost executor costs the tasks it was running and nothing that was finished.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a folder of our own only in a local session that sets none.

    On a cluster the administrator names one, because nothing else is visible to every machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        path = "file://" + os.path.join(tempfile.gettempdir(), f"fluxtape-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and return the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(df: DataFrame) -> None:
    """Delete a table made by :func:`materialize`; nothing may read it afterwards."""
    spark = df.sparkSession
    for parent in {os.path.dirname(f) for f in df.inputFiles()}:
        for made in list(_made):
            if parent.rstrip("/").endswith(made[1].rsplit("/", 1)[1]):
                drop_path(spark, made[1])
                _made.remove(made)


def _clean() -> None:
    for spark, path in _made:
        try:
            drop_path(spark, path)
        except Exception:  # the session is gone: the folder goes with the cluster's own cleaning
            return


def text_key():
    """128-bit identity of a text, equal for equal texts: two longs, null text as empty."""
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    half = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint")
    return half(1).alias("k1"), half(16).alias("k2")
