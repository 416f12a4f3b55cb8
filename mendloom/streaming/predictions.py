"""Predictions merged as shard files arrive: the batch merge's last-wins rule, kept up by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendloom.sources.io import json_object, shard_number, truthy


def stream_predictions(spark: SparkSession, root: str) -> DataFrame:
    """Lines of new prediction files with file, line_no, instance_id and line; lines that the batch reader rejects are left out.

    A file is one value, for a stream can't number the lines of a file that is read in blocks.
    """
    files = spark.readStream.schema("value string").option("recursiveFileLookup", "true").text(root, wholetext=True)
    lines = files.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    good = lines.where(json_object(F.col("line")) & truthy(F.col("line"), "$.instance_id"))
    return good.withColumn("instance_id", F.get_json_object("line", "$.instance_id"))


def latest(predictions: DataFrame) -> DataFrame:
    """The last line of each instance by shard number, file and line number, as in the batch merge: complete-mode state, one row an instance."""
    place = F.struct(shard_number(F.col("file")), F.col("file"), F.col("line_no"))
    return predictions.groupBy("instance_id").agg(F.max_by("line", place).alias("line"))
