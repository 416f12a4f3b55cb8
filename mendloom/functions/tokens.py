"""Token counts by a tokenizer file."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


@lru_cache(1)
def _tokenizer(file: bytes):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(file.decode("utf-8"))


def id_counter(spark: SparkSession, path: str) -> Callable[[Column], Column]:
    """Function from texts to their number of ids by a file of the ``tokenizers`` library; 0 for null. The file is read on the driver."""
    with open(path, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())

    @F.arrow_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array([len(e.ids) for e in _tokenizer(sent.value).encode_batch([t.as_py() or "" for t in texts], add_special_tokens=False)], pa.int32())

    return count
