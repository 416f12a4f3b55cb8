"""Token windows packed by best-fit decreasing.

Lengths are whole numbers up to the window, so equal lengths are placed in one step: a segment tree
indexed by remaining capacity finds the tightest open windows, and the plan depends on the histogram
of lengths alone. Spark counts, ranks and places the pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mendloom.llm.common import materialise

WINDOW, END = 2048, 1


class CapacityTree:
    """Segment tree over capacities: whether open windows of a capacity exist, and the least such capacity at or above a length."""

    def __init__(self, window: int):
        self.leaves = 1 << (window + 1).bit_length()
        self.any = np.zeros(2 * self.leaves, np.int64)

    def set(self, capacity: int, windows: int) -> None:
        at = capacity + self.leaves
        self.any[at] = windows
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] + self.any[2 * at + 1]

    def tightest(self, length: int) -> int | None:
        at = length + self.leaves
        if self.any[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit_decreasing(histogram: dict[int, int], window: int = WINDOW) -> tuple[np.ndarray, int]:
    """Placements (length, first rank, first window, items a window, offset) and the number of windows.

    The same packing as placing items one by one, longest first, each into the tightest window with
    room: an item that goes to a window makes it the tightest one for the next of its length.
    """
    tree, open_ = CapacityTree(window), {}
    out, windows = [], 0

    def add(first: int, many: int, left: int) -> None:
        if many and left:
            open_.setdefault(left, []).append((first, many))
            tree.set(left, sum(n for _, n in open_[left]))

    for length in sorted(histogram, reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            left = tree.tightest(length)
            if left is None:
                left, first, many = window, windows, -(-todo // (window // length))
                windows += many
            else:
                first, many = open_[left].pop()
                tree.set(left, sum(n for _, n in open_[left]))
            each = left // length
            full = min(many, todo // each)
            for start, n, items in ((first, full, each), (first + full, 1, min(each, todo - full * each))):
                if n and items and start < first + many:
                    out.append((length, rank, start, items, window - left))
                    rank, todo = rank + n * items, todo - n * items
                    add(start, n, left - items * length)
                    used = start + n - first
            add(first + used, many - used, left)
    return np.array(out, np.int64).reshape(-1, 5), windows


#: Runs of one kind of character beyond which a text goes to ``tokenizers`` itself: they overflow tiktoken's pattern matcher.
LONG_RUN = 4000
_RUN = re.compile(rf"\s{{{LONG_RUN}}}|\S{{{LONG_RUN}}}")


@lru_cache(1)
def encoder(file: bytes) -> Callable[[str], list[int]]:
    """Function from texts to the ids of a byte-level BPE file of the ``tokenizers`` library, without added special tokens.

    Strings of the file's added tokens are these tokens wherever they stand. Most texts take tiktoken's
    faster form of the same vocabulary; those with very long runs take the library, whose ids are the same.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    whole, library = json.loads(file), Tokenizer.from_str(file.decode("utf-8"))
    vocabulary, added = whole["model"]["vocab"], whole.get("added_tokens") or []
    odd = [t["content"] for t in added if t.get("lstrip") or t.get("rstrip") or t.get("single_word")]
    if odd:
        raise ValueError(f"added tokens that take in or look at their surroundings: {odd}")
    special = {t["content"]: t["id"] for t in added}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
    ranks = {bytes(shown[c] for c in word): i for word, i in vocabulary.items() if word not in special and all(c in shown for c in word)}
    fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        if len(text) >= LONG_RUN and _RUN.search(text):
            return library.encode(text, add_special_tokens=False).ids
        return fast.encode(text, allowed_special="all")

    return encode


def tokenizer_file(path: str) -> bytes:
    """The file, read on the driver: it is a few megabytes, and tasks get its bytes."""
    with open(path, "rb") as f:
        return f.read()


def id_counter(spark: SparkSession, tokenizer_path: str) -> Callable[[Column], Column]:
    """Function from a text column to how many ids it has, the end id included; a null text has that alone."""
    sent = spark.sparkContext.broadcast(tokenizer_file(tokenizer_path))

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        encode = encoder(sent.value)
        return pa.array([len(encode(t.as_py() or "")) + 1 for t in texts], pa.int64())

    return count


def pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """Every document's token ids and its end id, cut into full windows and a rest.

    (doc_id, start, length, ids_crc32, doc_tokens, part, nth): nth counts the pieces of that length in
    the task ``part``. The table is written before it is used, so both stay as they are.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int64()), ("nth", pa.int64())])

    sent = docs.sparkSession.sparkContext.broadcast(tokenizer_file(tokenizer_path))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(sent.value), TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end], "<u4")
                for start in range(0, len(ids), window):
                    own = ids[start : start + window]
                    rows.append((key, start, len(own), zlib.crc32(own.tobytes()), len(ids), part, seen[len(own)]))
                    seen[len(own)] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, nth long")


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The driver gets the histogram of lengths (``window`` rows) and makes the placements, whose number
    is bounded by lengths times capacities. A piece's rank among those of its length is its rank in
    its task plus the count of earlier tasks. Null text is an empty document (its end id alone);
    null ids and repeated rows are packed as they come; an empty table gives no rows.
    """
    cut = materialise(pieces(docs, tokenizer_path, window, end), "pieces")
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan, _ = best_fit_decreasing(histogram, window)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    span = max([1, *histogram.values()]) + 1
    placed = docs.sparkSession.sparkContext.broadcast((plan, plan[:, 0] * span + plan[:, 1]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, keys = placed.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length * span + rank, side="right") - 1
            nth = rank - plan[at, 1]
            sequence, offset = plan[at, 2] + nth // plan[at, 3], plan[at, 4] + nth % plan[at, 3] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    ranked = cut.join(before, ["length", "part"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("nth") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
