"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_paths: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under spark.checkpoint.dir. Only a local master may do without: it gets a temporary folder, removed at exit."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="spark-scratch-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        root = "file://" + _local[0]
    _paths.append(f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _paths[-1]


def release(spark: SparkSession) -> None:
    """Remove all scratch tables made so far. What reads them must have been written or collected."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _paths:
        where = jvm.org.apache.hadoop.fs.Path(_paths.pop())
        where.getFileSystem(conf).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read again: what runs later sees these very rows, and a lost executor costs nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
