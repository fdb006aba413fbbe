"""Scratch tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT = "spark.checkpoint.dir"
_removed_at_exit: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, which all executors share.

    Where that setting is absent a local folder stands in on one machine (a local
    master); on a cluster it is an error, as executors share no such folder.
    The folder is removed when the driver's Python ends.
    """
    base = spark.conf.get(CHECKPOINT, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT} has to name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "lumasift-shared")
    path = f"{base.rstrip('/')}/lumasift-{spark.sparkContext.applicationId}"
    if path not in _removed_at_exit:
        _removed_at_exit.add(path)
        atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may be gone already
        pass


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    It cuts the lineage in a way that survives lost executors, and fixes
    values that later steps read more than once.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
