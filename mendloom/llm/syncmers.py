"""Document fingerprints from closed syncmers.

A k-mer is a closed syncmer if the least of its inner s-mers (by hash) is its first or its last.
That depends on the k-mer alone, so an edit changes only the anchors that overlap it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendloom.llm.words import mix

#: Length of an anchor and of its inner pieces; anchors kept of any text, and one in how many beyond those.
K, S, KEPT, SAMPLED = 16, 6, 128, 8
_LIMIT = (1 << 32) // SAMPLED
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _grams(points: np.ndarray, width: int) -> np.ndarray:
    n, out = len(points) - width + 1, np.zeros(max(0, len(points) - width + 1), np.uint64)
    for i in range(width):
        out = out * _ODD + points[i : n + i]
    return mix(out)


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions (code points) and 32-bit hashes of the closed syncmers of the whole text.

    A text shorter than ``k`` is one anchor at 0; an empty text has none.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(points) < k:
        whole = _grams(points, len(points)) if len(points) else np.zeros(0, np.uint64)
        return np.zeros(len(whole), np.int64), (whole >> np.uint64(32)).astype(np.uint32)
    inner, w = _grams(points, s), k - s + 1
    least, have = inner, 1
    while have < w:  # minimum over a sliding window, by doubling
        step = min(have, w - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    n = len(points) - k + 1
    at = np.flatnonzero((inner[:n] == least) | (inner[w - 1 : w - 1 + n] == least))
    found = np.zeros(len(at), np.uint64)
    for i in range(k):
        found = found * _ODD + points[at + i]
    return at, (mix(found) >> np.uint64(32)).astype(np.uint32)


def sketch(text: str, kept: int = KEPT, k: int = K, s: int = S) -> np.ndarray:
    """Anchor hashes that stand for a text, in text order, each where it comes first.

    Kept are the hashes under one in ``SAMPLED`` of their range, and the ``kept`` least in any case: all
    of a short text, an eighth of a long one, the same ones wherever an anchor occurs.
    """
    at, found = anchors(text, k, s)
    found, first = np.unique(found, return_index=True)
    many = max(kept, int(np.searchsorted(found, _LIMIT)))
    return found[:many][np.argsort(at[first[:many]], kind="stable")]


def _complete_to(a: np.ndarray, kept: int) -> int:
    """The sketch has every anchor of its text up to this hash."""
    return (1 << 32) - 1 if len(a) < kept else max(int(a.max()), _LIMIT - 1)


def _rising(places: np.ndarray) -> int:
    """Length of the longest rising run of places, others left out."""
    tails: list[int] = []
    for x in places.tolist():
        i = bisect_left(tails, x)
        tails[i : i + 1] = [x]
    return len(tails)


def likeness(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """Share of anchors that both texts have in one order, among the anchors of either; 1 for two empty sketches.

    Only hashes up to which both sketches are complete count, so it is an unbiased estimate of the share over
    all anchors: exact under ``kept`` anchors, else with a standard error of 0.5 / sqrt(kept) = 0.044 at most,
    less for longer texts.
    """
    upto = min(_complete_to(a, kept), _complete_to(b, kept))
    a, b = a[a <= upto], b[b <= upto]
    if not len(a) and not len(b):
        return 1.0
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return _rising(j[np.argsort(i)]) / (len(a) + len(b) - len(common))


def render(fingerprint: np.ndarray) -> str:
    """Hexadecimal, eight digits an anchor, in text order."""
    return fingerprint.astype(">u4").tobytes().hex()


def syncmer_anchors(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """(doc_id, position, anchor) of every closed syncmer, for joins on anchor and position."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, found = anchors(text or "", k, s)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(at), pa.int64()), pa.array(at, pa.int64()), pa.array(found, pa.int64())], names=["doc_id", "position", "anchor"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(emit, "doc_id long, position long, anchor long")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _order(key: np.ndarray, digests: list[bytes]) -> np.ndarray:
    """24 bytes a row that sort as descending ids, then digests of the text."""
    out = np.empty((len(key), 24), np.uint8)
    out[:, :8] = (~key.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 8:] = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 16)
    return out.view("S24").ravel()


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key, digest): null ids last in descending order, null texts empty, a digest that orders equal ids."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.withColumns({"key": F.coalesce("doc_id", F.lit(-(1 << 63))), "digest": F.unhex(F.md5(F.encode("text", "UTF-8")))})


def range_starts(rows: DataFrame, buckets: int) -> np.ndarray:
    """First rows, as sortable bytes, of ranges of about equal size in the order of ``_order``.

    Spark draws the ranges over (key, digest) without texts, equal rows counted once; each start is the
    least row of a range, so it is a row that occurs. ``buckets`` of them reach the driver.
    """
    light = rows.select("key", "digest").distinct().repartitionByRange(buckets, F.desc("key"), F.asc("digest"))
    least = light.withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.min(F.struct(F.bitwise_not("key").alias("down"), "digest")).alias("least"))
    found = [(-r.least.down - 1, bytes(r.least.digest)) for r in least.select("least").collect()]
    return np.sort(_order(np.array([k for k, _ in found], np.int64), [d for _, d in found])) if found else np.zeros(0, "S24")


#: What a row is in its range: one of it, the first row of the next range, or a repeat of a row that the task sent already.
OWN, TAIL, REPEAT = 0, 1, 2


def dealt(rows: DataFrame, starts: np.ndarray) -> DataFrame:
    """Rows with the range they belong to, each start also at the end of the range before it.

    Of rows that are equal in id and text each task sends one to its range; the others follow one of their
    like, need no neighbour, and are dealt over all ranges.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            order = _order(batch.column("key").to_numpy(), batch.column("digest").to_pylist())
            bucket = np.maximum(np.searchsorted(starts, order, side="right") - 1, 0)
            first = starts[bucket] == order
            take, where, what = [], [], []
            for i, (o, at, is_first) in enumerate(zip(order.tolist(), bucket.tolist(), first.tolist(), strict=True)):
                if o in seen:
                    sent = [((at + len(seen) + i) % len(starts), REPEAT)]
                else:
                    seen.add(o)
                    sent = [(at, OWN)] + ([((at - 1) % len(starts), TAIL)] if is_first else [])
                for place, kind in sent:
                    take.append(i)
                    where.append(place)
                    what.append(kind)
            picked = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(where, pa.int32()), pa.array(what, pa.int32())], names=[*picked.schema.names, "bucket", "kind"])

    return rows.mapInArrow(deal, "doc_id long, text string, key long, digest binary, bucket int, kind int")


def fingerprint_edits(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next document.

    The edited text has its last third replaced by as much of the head of the next document in
    descending doc_id; the last is followed by the first, a lone document by itself. Null texts are
    empty. Null ids come last; rows of equal id follow one another by the md5 of their text, so a hot id
    is cut into ranges like any other. Repeated rows are kept. Further columns are ignored. An empty
    table gives an empty result. A range without the row that follows it is an error: no row is lost unseen.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = keyed(docs)
    starts = range_starts(rows, min(50_000, buckets or 8 * n))
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    if not len(starts):
        return spark.createDataFrame([], RESULT)
    whole = dealt(rows, starts).repartition(n, "bucket").sortWithinPartitions("bucket", "kind", F.desc("key"), "digest").select("bucket", "kind", "doc_id", "text")

    def pairs(batches: Iterator[pa.RecordBatch]):
        held = None
        for batch in batches:
            for bucket, kind, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = (bucket, kind, key, text, sketch(text))
                if held and (held[0] != bucket or kind == REPEAT):
                    raise RuntimeError(f"range {held[0]} has no following row")
                if held:
                    yield held, row
                if kind == REPEAT:
                    yield row, row
                held = row if kind == OWN else None
        if held:
            raise RuntimeError(f"range {held[0]} has no following row")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for (_, _, key, text, own), (_, _, _, other, following) in pairs(batches):
            cut = len(text) // 3
            edited = text[: len(text) - cut] + other[:cut]
            changed = sketch(edited) if edited != text else own
            rows.append((key, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), render(own), render(changed), likeness(own, changed), likeness(own, following)))
            size += len(own) + len(changed)
            if len(rows) >= 1000 or size > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return whole.mapInArrow(judge, RESULT)
