"""URL lists: a blocked Bloom filter passes possible hits on to an exact join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longs in a block: 512 bits, one cache line.
BLOCK = 8
#: Largest filter in bytes. A longer list only raises the share of false positives, which the join removes.
MOST_BYTES = 32 << 20
BITS_PER_KEY, PROBES = 16, 6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url) -> F.Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; else empty."""
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), _UPPER, _LOWER)).otherwise(F.lit(""))


def path(url) -> F.Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def _bits(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each key and its bits there: ``PROBES`` of 512, from other bits of the same hash."""
    h = keys.view(np.uint64)
    block = (h >> np.uint64(32)) % np.uint64(blocks)
    a, b = h & np.uint64(0x1FF), (h >> np.uint64(9)) & np.uint64(0x1FF) | np.uint64(1)
    return block.astype(np.int64), (a[:, None] + b[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(0x1FF)


def bloom_filter(keys: DataFrame, column: str, most_bytes: int = MOST_BYTES) -> np.ndarray:
    """Filter of a column of 64-bit hashes, built where the keys are: tasks send the blocks they touch, or-ed together.

    What reaches the driver is the filter itself, ``most_bytes`` at most.
    """
    blocks = max(1, min(most_bytes // (8 * BLOCK), math.ceil(keys.count() * BITS_PER_KEY / (64 * BLOCK))))

    def fill(frames):
        for frame in frames:
            block, bit = _bits(frame[column].to_numpy(np.int64), blocks)
            words = np.zeros((len(block), BLOCK), np.uint64)
            for i in range(PROBES):
                words[np.arange(len(block)), (bit[:, i] >> np.uint64(6)).astype(int)] |= np.uint64(1) << (bit[:, i] & np.uint64(63))
            yield pd.DataFrame({"block": block} | {f"w{i}": words[:, i].view(np.int64) for i in range(BLOCK)})

    touched = keys.select(column).mapInPandas(fill, ", ".join(["block long", *(f"w{i} long" for i in range(BLOCK))])).groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(BLOCK)))
    out = np.zeros((blocks, BLOCK), np.uint64)
    for row in touched.toLocalIterator():
        out[row.block] = np.array(row[1:], np.int64).view(np.uint64)
    return out


def possible_hits(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each 64-bit hash may be in the filter: false is certain."""
    block, bit = _bits(keys, len(bits))
    hit = np.ones(len(keys), bool)
    for i in range(PROBES):
        hit &= (bits[block, (bit[:, i] >> np.uint64(6)).astype(int)] >> (bit[:, i] & np.uint64(63)) & np.uint64(1)).astype(bool)
    return hit


def judge_urls(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", url: str = "url", most_bytes: int = MOST_BYTES) -> DataFrame:
    """``pages`` with host, path, rule and verdict of every row; a url that no rule fits gets ``otherwise``.

    ``rules`` has rule_host, rule_path and verdict. A rule fits its host and all subdomains if the path
    starts with its path; of several the longest (host and path together) wins, then the least.
    Each url is looked up under the suffixes and prefixes of the shapes that occur in the list; the
    Bloom filter drops almost all, and a join on (host, path) of the listed rules decides the rest.
    Null urls and urls without ``://`` have empty host and path and fit no rule. Rules are distinct
    by host and path; an empty list fits nothing. Columns of the same names are replaced.
    """
    pages = pages.withColumns({"host": host(F.col(url)), "path": path(F.col(url))})
    rules = rules.groupBy("rule_host", "rule_path").agg(F.min("verdict").alias("verdict")).withColumn("listed", F.xxhash64("rule_host", "rule_path"))
    shapes = rules.agg(F.collect_set(F.size(F.split("rule_host", r"\.", -1))).alias("labels"), F.collect_set(F.length("rule_path")).alias("lengths")).first()
    bits = bloom_filter(rules, "listed", most_bytes)
    sent = pages.sparkSession.sparkContext.broadcast(bits)

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            keys = batch.column("asked")
            flat = keys.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(batch.num_rows), keys.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            hit = possible_hits(bits, flat)
            rows = pa.array(owner[hit])
            yield pa.RecordBatch.from_arrays([batch.column("host").take(rows), batch.column("path").take(rows), pa.array(flat[hit])], names=["host", "path", "listed"])

    labels, lengths = sorted(shapes.labels), sorted(shapes.lengths)
    parts = F.split("host", r"\.", -1)
    suffixes = F.filter(F.array(*(F.when(F.size(parts) >= n, F.substring_index("host", ".", -n)) for n in labels)), lambda x: x.isNotNull())
    prefixes = F.filter(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths)), lambda x: x.isNotNull())
    asked = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.xxhash64(h, p)))) if labels and lengths else F.array().cast("array<long>")

    urls = pages.select("host", "path").where("host <> ''").distinct()
    hits = urls.select("host", "path", asked.alias("asked")).mapInArrow(possible, "host string, path string, listed long")
    exact = hits.join(rules.withColumnRenamed("verdict", "said"), "listed").where("(host = rule_host or endswith(host, concat('.', rule_host))) and startswith(path, rule_path)")
    best = exact.groupBy(F.col("host").alias("hit_host_"), F.col("path").alias("hit_path_")).agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "said"), F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), "rule_host")).alias("hit_won_"))
    return pages.join(best, (F.col("host") == F.col("hit_host_")) & (F.col("path") == F.col("hit_path_")), "left").withColumns({"rule": F.col("hit_won_.rule"), "verdict": F.coalesce("hit_won_.said", F.lit(otherwise))}).drop("hit_host_", "hit_path_", "hit_won_")
