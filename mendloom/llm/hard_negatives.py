"""Hard negatives: rows of another label that score in a window below an anchor's positives.

Rows are quantised, put in order of label and Hilbert index, and packed into blocks, a Parquet row and
page each, with the least and greatest value of every dimension (zone maps). Interval arithmetic on the
zone maps bounds an anchor's scores in a block; a block is read where these bounds meet a window.
Scores are whole numbers, so bounds and results are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendloom.llm.common import materialise, scratch_path

#: Rows of a block, and Hilbert bits of a dimension.
BLOCK, BITS = 512, 4
#: Anchors of a round: as many as this many bytes hold, and 16,384 at most. They and their windows are broadcast.
ROUND_BYTES, ROUND = 16 << 20, 16_384
#: Runs of wanted blocks in the filter that is pushed to the scan; the nearest ones are joined beyond that.
RUNS = 64
#: Candidates held before they are cut to the best of each window.
HELD = 1 << 20
_NONE = np.iinfo(np.int64).min

BLOCKS = "block long, n int, label_lo long, label_hi long, lo array<long>, hi array<long>, vec_ids array<long>, labels array<long>, vectors array<long>, floors array<long>"


def quantised(vectors: DataFrame, vec_id: Column, label: Column, vector: Column, dims: int, scale: int = 256) -> DataFrame:
    """(vec_id, label, q array<long>): components x as floor(scale * x), shorter vectors ended with zeros.

    Left out: rows with a null id, label or vector, a null or non-finite component, or a norm beyond
    2^31 after scaling (so that every score fits a long).
    """

    @F.arrow_udf("array<long>")
    def whole(each: pa.Array) -> pa.Array:
        out = []
        for x in each:
            v = None if not x.is_valid else np.array(x.values.to_numpy(zero_copy_only=False), np.float64)
            q = None if v is None or not np.isfinite(v).all() else np.floor(scale * v)
            ok = q is not None and float((q * q).sum()) <= 2.0**62
            out.append(np.pad(q.astype(np.int64), (0, dims - len(q))) if ok else None)
        return pa.array(out, pa.list_(pa.int64()))

    rows = vectors.select(vec_id.cast("long").alias("vec_id"), label.cast("long").alias("label"), vector.cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    return rows.select("vec_id", "label", whole("v").alias("q")).where("q IS NOT NULL")


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of grid cells (rows of whole numbers under 2^bits) on the Hilbert curve, as rows of big-endian bytes.

    Skilling's transform ("Programming the Hilbert curve", 2004) on all rows at once.
    """
    x = cells.astype(np.uint32).T.copy()
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        low = np.uint32((1 << bit) - 1)
        for i in range(n):
            up = (x[i] >> np.uint32(bit)) & np.uint32(1) == 1
            swap = np.where(up, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] ^= np.where(up, low, swap).astype(np.uint32)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> np.uint32(bit)) & np.uint32(1) == 1, np.uint32((1 << bit) - 1), np.uint32(0))
    x ^= turn
    planes = [(x >> np.uint32(bit)) & np.uint32(1) for bit in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)


def extent(rows: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of every dimension: one row a task, then one for each dimension."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = np.full(dims, np.iinfo(np.int64).max), np.full(dims, _NONE)
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(0), dims)
                lo, hi = np.minimum(lo, m.min(0)), np.maximum(hi, m.max(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(lo), pa.array(hi)], names=["d", "lo", "hi"])

    found = rows.select("q").mapInArrow(own, "d long, lo long, hi long").groupBy("d").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("d").collect()
    return np.array([r.lo for r in found], np.int64), np.array([r.hi for r in found], np.int64)


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _top(anchor: np.ndarray, window: np.ndarray, score: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each (anchor, window): greatest scores, then least ids."""
    order = np.lexsort((other, -score, window, anchor))
    a, w = anchor[order], window[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (w[1:] != w[:-1])]
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - start < k]


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, exact: in doubles where all sums are under 2^53, else in longs."""
    small = np.sqrt((a.astype(np.float64) ** 2).sum(1).max(initial=0) * (b.astype(np.float64) ** 2).sum(1).max(initial=0)) < 2.0**52
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if small else a @ b.T


def bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that each row of ``a`` can have with a vector in each box, by interval arithmetic.

    In doubles; widened by what rounding can amount to.
    """
    up, down = np.maximum(a, 0).astype(np.float64), np.minimum(a, 0).astype(np.float64)
    lo, hi = lo.astype(np.float64).T, hi.astype(np.float64).T
    slack = (np.abs(a).astype(np.float64) @ np.maximum(np.abs(lo), np.abs(hi))) * (1e-15 * (len(lo) + 2))
    return up @ lo + down @ hi - slack, up @ hi + down @ lo + slack


def pack(rows: DataFrame, dims: int, is_anchor: Callable[[np.ndarray], np.ndarray], k: int, size: int = BLOCK) -> DataFrame:
    """Blocks of ``rows(vec_id, label, q)`` as a written table, in order of label, Hilbert index and id; equal rows become one.

    Ranges are drawn on all three, so a label or vector with a third of all rows is cut too. ``floors``
    holds for each anchor of a block the k-th best score of its own label within the block: no worse
    row can be among its positives.
    """
    lo, hi = extent(rows, dims)
    # a dimension of greater spread turns first
    turn, low, wide = np.argsort(-(hi.astype(np.float64) - lo), kind="stable"), lo.astype(np.float64), np.maximum(hi.astype(np.float64) - lo, 1)

    @F.arrow_udf("binary")
    def place(q: pa.Array) -> pa.Array:
        grid = np.minimum((_matrix(q, dims) - low) / wide * (1 << BITS), (1 << BITS) - 1)[:, turn]
        return pa.array([x.tobytes() for x in hilbert_index(grid)], pa.binary())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, nth, held, last = TaskContext.get().partitionId() << 33, 0, [], None

        def block(ids: np.ndarray, labels: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
            nonlocal nth
            mine = np.flatnonzero(is_anchor(ids))
            floors = np.full(len(mine), _NONE)
            s = scores(m[mine], m)
            for i, a in enumerate(mine):
                own = s[i][(labels == labels[a]) & (ids != ids[a])]
                if len(own) >= k:
                    floors[i] = np.partition(own, -k)[-k]
            row = [base + nth, len(ids), labels.min(), labels.max(), m.min(0), m.max(0), ids, labels, m.ravel(), floors]
            nth += 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

        def whole() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return tuple(np.concatenate(x) for x in zip(*held, strict=True))

        for b in batches:
            if not b.num_rows:
                continue
            ids, labels, m = b.column("vec_id").to_numpy(), b.column("label").to_numpy(), _matrix(b.column("q"), dims)
            all_ = np.column_stack([ids, labels, m])
            before = np.vstack([all_[:1] if last is None else last, all_[:-1]])
            new = (all_ != before).any(1)
            new[0] |= last is None
            last = all_[-1:]
            held.append((ids[new], labels[new], m[new]))
            if sum(len(h[0]) for h in held) >= size:
                ids, labels, m = whole()
                full = len(ids) // size * size
                for i in range(0, full, size):
                    yield block(ids[i : i + size], labels[i : i + size], m[i : i + size])
                held = [(ids[full:], labels[full:], m[full:])]
        if held and sum(len(h[0]) for h in held):
            yield block(*whole())

    long, longs = pa.int64(), pa.list_(pa.int64())
    types = [long, pa.int32(), long, long, longs, longs, longs, longs, longs, longs]
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    keyed = rows.withColumn("place", place("q"))
    ordered = keyed.repartitionByRange("label", "place", "vec_id").sortWithinPartitions("label", "place", "vec_id", "q")
    return ordered.select("vec_id", "label", "q").mapInArrow(cut, BLOCKS)


class Round:
    """Anchors of one round with the windows of scores that each looks for: (anchors, windows) arrays of bounds."""

    def __init__(self, label: np.ndarray, vec_id: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool):
        self.label, self.vec_id, self.q, self.low, self.high, self.same = label, vec_id, q, low, high, same

    def wanting(self, label_lo: np.ndarray, label_hi: np.ndarray, lo: np.ndarray, hi: np.ndarray, low: np.ndarray | None = None) -> np.ndarray:
        """Which anchors (rows) must read which boxes (columns): the labels there and the bounds of the scores meet a window."""
        least, most = bounds(self.q, lo, hi)
        if self.same:
            fits = (self.label[:, None] >= label_lo) & (self.label[:, None] <= label_hi)
        else:
            fits = (self.label[:, None] != label_lo) | (self.label[:, None] != label_hi)
        meets = np.zeros_like(fits)
        for w in range(self.low.shape[1]):
            meets |= (most >= (self.low if low is None else low)[:, w, None]) & (least <= self.high[:, w, None])
        return fits & meets


def wanted_blocks(blocks: DataFrame, sent: Broadcast) -> DataFrame:
    """(block, anchors) of the blocks that some anchor must read. Only the zone maps are scanned."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        dims = own.q.shape[1]
        for b in batches:
            for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                n = np.zeros(part.num_rows, np.int64)
                boxes = [part.column("label_lo").to_numpy(), part.column("label_hi").to_numpy(), _matrix(part.column("lo"), dims), _matrix(part.column("hi"), dims)]
                for i in range(0, len(own.q), 2048):
                    few = Round(*(x[i : i + 2048] for x in (own.label, own.vec_id, own.q, own.low, own.high)), own.same)
                    n += few.wanting(*boxes).sum(0)
                yield pa.RecordBatch.from_arrays([part.column("block"), pa.array(n)], names=["block", "anchors"])

    return blocks.select("block", "label_lo", "label_hi", "lo", "hi").mapInArrow(judge, "block long, anchors long").where("anchors > 0")


def runs(wanted: DataFrame, most: int = RUNS) -> list[tuple[int, int]]:
    """Runs of block numbers that hold all wanted ones, ``most`` for the whole table at most.

    Numbers are put in at most 4,096 spans of ranges and positions, so the driver gets as many rows at most.
    """
    ends = wanted.agg(F.min("block"), F.max("block"), F.max(F.col("block") % (1 << 33))).first()
    if ends[0] is None:
        return []
    parts, longest = (ends[1] >> 33) + 1, ends[2] + 1
    each = max(1, -(-longest * parts // 4096))
    step = -(-parts // 4096)
    p, s = F.shiftright("block", 33), F.floor(F.col("block") % (1 << 33) / each)
    spans = wanted.groupBy((p - p % step).alias("p"), (s if step == 1 else F.lit(0)).alias("s"))
    found = sorted((r.a, r.b) for r in spans.agg(F.min("block").alias("a"), F.max("block").alias("b")).collect())
    while len(found) > most:
        gaps = sorted((found[i + 1][0] - found[i][1], i) for i in range(len(found) - 1))
        join = {i for _, i in gaps[: len(found) - most]}
        out = []
        for i, (a, b) in enumerate(found):
            if i and i - 1 in join:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
        found = out
    return found


def search(blocks: DataFrame, sent: Broadcast, k: int) -> DataFrame:
    """(anchor, win, score, other): the k best rows of every window of every anchor, from the blocks that it must read.

    A task keeps the k best so far of each window, and their least raises the floor for the blocks to come.
    """
    found = runs(wanted_blocks(blocks, sent))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        dims = own.q.shape[1]
        floor = own.low.copy()
        parts: list[list[np.ndarray]] = []

        def best() -> list[np.ndarray]:
            a, w, s, o = (np.concatenate([p[i] for p in parts]) for i in range(4))
            keep = _top(a, w, s, o, k)
            a, w, s, o = a[keep], w[keep], s[keep], o[keep]
            last = np.flatnonzero(np.r_[(a[1:] != a[:-1]) | (w[1:] != w[:-1]), True]) if len(a) else np.zeros(0, np.int64)
            full = last[np.diff(np.r_[-1, last]) == k]
            floor[a[full], w[full]] = np.maximum(floor[a[full], w[full]], s[full])
            return [a, w, s, o]

        for b in batches:
            for i in range(b.num_rows):
                zone = [np.array([b.column(c)[i].as_py()]) for c in ("label_lo", "label_hi")] + [b.column(c)[i].values.to_numpy()[None, :] for c in ("lo", "hi")]
                ids, labels, m = (b.column(c)[i].values.to_numpy() for c in ("vec_ids", "labels", "vectors"))
                m = m.reshape(-1, dims)
                for at in range(0, len(own.q), 2048):
                    few = Round(*(x[at : at + 2048] for x in (own.label, own.vec_id, own.q, own.low, own.high)), own.same)
                    who = np.flatnonzero(few.wanting(*zone, floor[at : at + 2048])[:, 0])
                    if not len(who):
                        continue
                    s = scores(few.q[who], m)
                    able = (few.label[who, None] == labels) if own.same else (few.label[who, None] != labels)
                    able &= few.vec_id[who, None] != ids
                    for w in range(own.low.shape[1]):
                        r, c = np.nonzero(able & (s >= floor[at + who, w, None]) & (s <= few.high[who, w, None]))
                        parts.append([at + who[r], np.full(len(r), w), s[r, c], ids[c]])
                if sum(len(p[0]) for p in parts) > HELD:
                    parts = [best()]
                    if len(parts[0][0]) > HELD // 2:  # all windows are full: compare with what is new only
                        yield out(parts.pop())
        if parts:
            yield out(best())

    def out(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor", "win", "score", "other"])

    names = ["label_lo", "label_hi", "lo", "hi", "vec_ids", "labels", "vectors"]
    in_runs = F.lit(False)
    for a, b in found:
        in_runs = in_runs | F.col("block").between(a, b)
    hits = blocks.where(in_runs).select(*names).mapInArrow(read, "anchor long, win long, score long, other long")
    rank = F.row_number().over(Window.partitionBy("anchor", "win").orderBy(F.desc("score"), "other"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def written_blocks(packed: DataFrame) -> DataFrame:
    """The blocks as a shared table, a page for each, so that a filter on their numbers skips the pages of others."""
    spark, path = packed.sparkSession, scratch_path(packed.sparkSession, "blocks")
    packed.write.option("parquet.page.row.count.limit", "1").parquet(path)
    return spark.read.schema(packed.schema).parquet(path)


def anchors_of(blocks: DataFrame, dims: int, is_anchor: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(nth, vec_id, label, q, floor) of all anchors, numbered gapless in the order of the blocks."""
    counts = blocks.select(F.shiftright("block", 33).alias("p"), "block", F.size("floors").alias("anchors"))
    at, before = 0, []
    for r in counts.groupBy("p").agg(F.sum("anchors").alias("n")).orderBy("p").collect():  # a row for each range
        before.append((r.p, at))
        at += r.n
    earlier = F.coalesce(F.sum("anchors").over(Window.partitionBy("p").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = counts.where("anchors > 0").withColumn("earlier", earlier).join(blocks.sparkSession.createDataFrame(before, "p long, base long"), "p").select("block", (F.col("base") + F.col("earlier")).alias("first"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, labels, m, floors = (b.column(c)[i].values.to_numpy() for c in ("vec_ids", "labels", "vectors", "floors"))
                mine = np.flatnonzero(is_anchor(ids))
                rows = [pa.array(b.column("first")[i].as_py() + np.arange(len(mine))), pa.array(ids[mine]), pa.array(labels[mine]), pa.array(list(m.reshape(-1, dims)[mine]), pa.list_(pa.int64())), pa.array(floors)]
                yield pa.RecordBatch.from_arrays(rows, names=["nth", "vec_id", "label", "q", "floor"])

    own = blocks.where(F.size("floors") > 0).select("block", "vec_ids", "labels", "vectors", "floors")
    return own.join(numbered, "block").mapInArrow(take, "nth long, vec_id long, label long, q array<long>, floor long")


def mine_round(blocks: DataFrame, anchors: pd.DataFrame, dims: int, positives: int, negatives: int, window: tuple[int, int]) -> DataFrame:
    """Results for the anchors of one round, whose number is bounded; so are their positives, which the driver turns into windows."""
    spark = blocks.sparkSession
    label, ids, q = anchors["label"].to_numpy(np.int64), anchors["vec_id"].to_numpy(np.int64), np.array(anchors["q"].tolist(), np.int64).reshape(-1, dims)
    most = np.iinfo(np.int64).max
    first = Round(label, ids, q, anchors["floor"].to_numpy(np.int64)[:, None], np.full((len(ids), 1), most), True)
    found = search(blocks, spark.sparkContext.broadcast(first), positives).select("anchor", (F.col("rank") - 1).alias("win"), "score", "other").toPandas()
    low, high = np.full((len(ids), positives), most), np.full((len(ids), positives), _NONE)
    for a, w, s in zip(found["anchor"], found["win"], map(int, found["score"]), strict=True):
        low[a, w], high[a, w] = -(-window[0] * s // 100), window[1] * s // 100
    second = Round(label, ids, q, low, high, False)
    hits = search(blocks, spark.sparkContext.broadcast(second), negatives).withColumnRenamed("score", "negative_score")
    found["anchor_id"] = ids[found["anchor"].to_numpy(np.int64)]
    of = spark.createDataFrame(found, "anchor long, win long, positive_score long, positive_id long, anchor_id long")
    return hits.join(of, ["anchor", "win"]).select("anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", "negative_score")


def mine(vectors: DataFrame, vec_id: Column, label: Column, vector: Column, every: int = 100, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), size: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are rows whose id is divisible by ``every``; positives the best other rows of the label;
    negatives, for each positive, the best rows of other labels that score from ``window[0]`` to
    ``window[1]`` hundredths of it. Scores are inner products of floor(256 x); ties go to the smaller id.
    "Other" rows have another id. Rows equal in id, label and vector count once; of rows that share an id
    only, each takes part. Rows left out: see ``quantised``. No anchors or an empty table give no rows.
    """
    spark = vectors.sparkSession
    dims = vectors.agg(F.max(F.size(vector))).first()[0] or 0
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if dims <= 0:
        return spark.createDataFrame([], schema)
    rows = materialise(quantised(vectors, vec_id, label, vector, dims), "quantised")
    is_anchor = lambda ids: ids % every == 0
    blocks = written_blocks(pack(rows, dims, is_anchor, positives, size))
    anchors = materialise(anchors_of(blocks, dims, is_anchor), "anchors")
    total, most = anchors.count(), max(64, min(ROUND, ROUND_BYTES // (8 * dims)))
    out = spark.createDataFrame([], schema)
    for start in range(0, total, most):
        own = anchors.where(F.col("nth").between(start, start + most - 1)).orderBy("nth").toPandas()
        out = out.unionByName(materialise(mine_round(blocks, own, dims, positives, negatives, window), "mined"))
    return out
