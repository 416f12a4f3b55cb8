"""Shared pieces: tables, scratch storage that all executors see, folds and graph components."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read lazily through Spark's own file systems."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local: list[str] = []
_tables: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local master may do without: it gets a temporary folder, removed at exit."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="spark-shared-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return "file://" + _local[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, which ``release`` removes."""
    _tables.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _tables[-1]


def held() -> int:
    """How many scratch tables there are: a mark for ``release``."""
    return len(_tables)


def scratch_tables(since: int = 0) -> list[str]:
    """Paths of the scratch tables made since a mark."""
    return _tables[since:]


def release(spark: SparkSession, since: int = 0, keep: Sequence[str] = ()) -> None:
    """Remove the scratch tables made since a mark, but those in ``keep``. What reads them must have been written or collected."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in [p for p in _tables[since:] if p not in keep]:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
        _tables.remove(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a shared table and read again: lineage ends there, and a lost executor costs nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(key: Column, folds: int = 5) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key is in fold 0, so nothing learns from it."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % F.lit(folds), F.lit(0)).cast("int")


def hash_share(key: Column, share: float, seed: int) -> Column:
    """True for the stated share of keys, the same ones in every run."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a long, b long)``; root is the least node of the component.

    Alternates the large-star and small-star steps until the star forest no longer changes; each
    round is three joins on the edge table alone, written to shared storage to end its lineage.
    """
    star = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    star, before = materialise(star, "edges"), None
    while True:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = materialise(small.unionByName(low.withColumnRenamed("m", "v")).distinct(), "star")
        now = star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = star.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
