"""Nearest neighbours by largest inner product, through cross-polytope hashing.

Unit vectors pass through three rounds of random signs and a fast Hadamard transform. Groups of rotated
coordinates are polytopes: each hashes a vector to its nearest signed axis, and the axes of several
polytopes together are its cell in a table. The number of cells follows that of the rows. A query visits
the cells nearest to it in every table (multiprobe) and scores what it meets there exactly. How many it
visits is measured: some queries are scored against all rows, and the cells of their true neighbours are
ranked. The hash is of directions alone; vectors whose length few others have are scored by every query,
and so are all rows by a query that meets too few.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendloom.llm.common import materialise

TABLES = 2
#: (polytopes of a cell, coordinates of each), and the rows from which on they are used: at least 32 a cell, but in the first.
SHAPES = [((1, 8), 0), ((1, 32), 32 << 6), ((2, 8), 32 << 8), ((2, 16), 32 << 10), ((2, 32), 32 << 12), ((2, 64), 32 << 14), ((4, 8), 32 << 16)]
#: Share of the true neighbours that the visited cells have to hold, and the queries that it is measured on.
RECALL, MEASURED = 0.96, 128
#: Bands of length to a factor of two, and all.
BAND, BANDS = 8, 64
#: Components of the vectors that a task holds of one block, and how many times more of queries.
BLOCK, QUERIES = 1 << 20, 4


def rotations(points: np.ndarray, table: int, seed: int = 0) -> np.ndarray:
    """Pseudo-random rotation number ``table`` of the rows, padded to a power of two of 64 at least."""
    width = 1 << max(6, (points.shape[1] - 1).bit_length())
    y = np.zeros((len(points), width))
    y[:, : points.shape[1]] = points
    signs = np.random.default_rng([seed, table]).choice([-1.0, 1.0], (3, width))
    for s in signs:
        y = y * s
        half = 1
        while half < width:  # fast Hadamard transform over all rows
            z = y.reshape(len(y), -1, 2, half)
            y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], axis=2).reshape(len(y), width)
            half *= 2
        y /= np.sqrt(width)
    return y


@dataclass(frozen=True)
class Hashing:
    """How vectors become cells: tables of ``polytopes`` groups of ``width`` coordinates each."""

    polytopes: int
    width: int
    tables: int = TABLES
    seed: int = 0

    @property
    def cells(self) -> int:
        return (2 * self.width) ** self.polytopes

    def signed(self, points: np.ndarray) -> np.ndarray:
        """Nearness to every axis: (tables, polytopes, rows, 2 x width), + before -."""
        found: list[np.ndarray] = []
        while len(found) < self.tables * self.polytopes:
            y = rotations(points, len(found), self.seed)
            found += np.split(y, y.shape[1] // self.width, axis=1)
        y = np.stack(found[: self.tables * self.polytopes])
        return np.concatenate([y, -y], axis=2).reshape(self.tables, self.polytopes, len(points), 2 * self.width)

    def own(self, signed: np.ndarray) -> np.ndarray:
        """The cell of every row in every table."""
        nearest, cell = signed.argmax(axis=3), 0
        for p in range(self.polytopes):
            cell = cell * 2 * self.width + nearest[:, p]
        return cell

    def nearness(self, signed: np.ndarray, table: int, row: int) -> np.ndarray:
        """Nearness of one query to all cells of a table."""
        near = np.zeros(1)
        for p in range(self.polytopes):
            near = (near[:, None] + signed[table, p, row][None, :]).ravel()
        return near

    def of_cells(self, signed: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Nearness of the rows of one table (polytopes, rows, axes) to some cells: (rows, cells)."""
        near, axes = 0.0, 2 * self.width
        for p in range(self.polytopes):
            near = near + signed[p][:, cells // axes ** (self.polytopes - 1 - p) % axes]
        return near


def hashing_for(rows: int, tables: int = TABLES, seed: int = 0) -> Hashing:
    """The hashing for a number of rows."""
    return Hashing(*[shape for shape, least in SHAPES if rows >= least][-1], tables, seed)


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(id, vector, mark) without null ids and without vectors that are null, zero or hold null or non-finite components.

    ``mark`` is 128 bits that stand for equal vectors.
    """
    v = F.col(column).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    half = lambda seed: F.lpad(F.hex(F.xxhash64(F.lit(seed), "vector")), 16, "0")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).alias("vector")).where(F.col("id").isNotNull() & sound)
    return rows.withColumn("mark", F.unhex(F.concat(half(1), half(2))))


def _marks(column: pa.Array) -> np.ndarray:
    """Marks as rows of two longs."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, 2)


def _dense(column: pa.Array, dimension: int) -> np.ndarray:
    """A list column as rows of doubles, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.value_lengths().to_numpy()
    if len(flat) == dimension * len(sizes):
        return flat.reshape(-1, dimension)
    out = np.zeros((len(sizes), dimension))
    out[np.arange(dimension)[None, :] < sizes[:, None]] = flat
    return out


def _top(query: np.ndarray, score: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of every query."""
    order = np.lexsort((tie, -score, query))
    q = query[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    return order[np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)])) < k]


def measured(rows: DataFrame, asked: DataFrame, hashing: Hashing, k: int, dimension: int) -> int:
    """Cells that a query has to visit in each table to meet ``RECALL`` of its true ``k`` neighbours among ``rows``.

    ``MEASURED`` queries, the same ones in every run, are scored against all rows where these are; a
    neighbour's rank is that of its cell, in the table where it is nearer.
    """
    some = asked.orderBy(F.xxhash64("id", "mark"), "id", "mark").limit(MEASURED).select("id", "vector").toArrow()
    if not some.num_rows:
        return 1
    ids, points = some.column("id").to_numpy(), _dense(some.column("vector"), dimension)
    sent = rows.sparkSession.sparkContext.broadcast((ids, points))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points = sent.value
        signed = hashing.signed(points)
        sorted_ = {(t, q): np.sort(hashing.nearness(signed, t, q)) for t in range(hashing.tables) for q in range(len(ids))}
        held = [np.zeros(0, t) for t in (int, float, np.int64, int)]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                own, v = part.column(0).to_numpy(), _dense(part.column(1), dimension)
                s = points @ v.T
                s[ids[:, None] == own[None, :]] = -np.inf
                keep = min(k, len(own))
                q, r = np.nonzero(s >= -np.partition(-s, keep - 1, axis=1)[:, keep - 1 : keep])
                q, r = q[s[q, r] > -np.inf], r[s[q, r] > -np.inf]
                cells = hashing.own(hashing.signed(v))
                rank = np.full(len(q), hashing.cells)
                for t in range(hashing.tables):
                    near = sum(signed[t, p][q, cells[t][r] // (2 * hashing.width) ** (hashing.polytopes - 1 - p) % (2 * hashing.width)] for p in range(hashing.polytopes))
                    place = np.array([hashing.cells - np.searchsorted(sorted_[t, a], x - 1e-9) for a, x in zip(q.tolist(), near.tolist(), strict=True)], int)
                    rank = np.minimum(rank, place)
                held = [np.concatenate(x) for x in zip(held, (q, s[q, r], own[r], rank), strict=True)]
                held = [x[_top(held[0], held[1], held[2], k)] for x in held] if len(held[0]) else held
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["asked", "score", "id", "rank"])

    met = rows.select("id", "vector").mapInArrow(judge, "asked long, score double, id long, rank long")
    best = met.withColumn("nth", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "id"))).where(F.col("nth") <= k)
    ranks = [r["rank"] for r in best.select("rank").collect()]
    return int(np.quantile(ranks, RECALL, method="higher")) if ranks else 1


@dataclass(frozen=True)
class Blocks:
    """Where the rows of a cell are compared: runs of cells of one table, or a part of one cell, by its first block and their number."""

    first: np.ndarray
    many: np.ndarray

    def visited(self, cells: np.ndarray) -> np.ndarray:
        first, many = self.first[cells], self.many[cells]
        wide = np.flatnonzero(many > 1)
        return np.unique(np.concatenate([first[many == 1], *(np.arange(first[i], first[i] + many[i]) for i in wide)]))


def blocks_of(sizes: np.ndarray, most: int) -> Blocks:
    """Neighbouring cells together up to ``most`` rows; a larger cell alone, in several blocks. Empty cells have none."""
    first, many, at, filled = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0, 0
    for cell in np.flatnonzero(sizes).tolist():
        n = int(sizes[cell])
        if filled and filled + n > most:
            at, filled = at + 1, 0
        first[cell], many[cell] = at, max(1, -(-n // most))
        filled += n
        if n > most:
            at, filled = at + int(many[cell]), 0
    return Blocks(first, many)


def compared(both: DataFrame, hashing: Hashing | None, cells: int, dimension: int, kept: int) -> DataFrame:
    """(asked, met, score): marks of queries and of the ``kept`` best vectors that each meets in a block.

    ``both`` has id, vector, mark, and whether the row is searched (``is_v``) and whether it asks (``is_q``).
    Without a hashing all rows are one cell, which every query visits. A vector is sent once for each
    table, and once for each set of queries that fills a task; a query once for each block that it visits.
    """
    spark, most = both.sparkSession, max(256, BLOCK // dimension)
    queries, rows = both.agg(F.count_if("is_q"), F.count_if("is_v")).first()
    sizes = np.array([[rows]])
    if hashing:

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros((hashing.tables, hashing.cells), np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    own = hashing.own(hashing.signed(_dense(batch.column(0).slice(at, 4096), dimension)))
                    for t in range(hashing.tables):
                        seen[t] += np.bincount(own[t], minlength=hashing.cells)
            t, c = np.nonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(c), pa.array(seen[t, c])], names=["t", "cell", "n"])

        sizes = np.zeros((hashing.tables, hashing.cells), np.int64)
        for r in both.where("is_v").select("vector").mapInArrow(count, "t long, cell long, n long").groupBy("t", "cell").agg(F.sum("n").alias("n")).collect():
            sizes[r.t, r.cell] = r.n  # tables x cells rows at most
    sent = spark.sparkContext.broadcast([blocks_of(s, most) for s in sizes])
    parts = max(1, -(-queries // (QUERIES * most)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, seen = sent.value, set()
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                marks = _marks(part.column(2))
                signed = hashing.signed(_dense(part.column(1), dimension)) if hashing else None
                own = hashing.own(signed) if hashing else np.zeros((1, len(marks)), int)
                out: list[tuple] = []
                for i, (m, mark, is_v, is_q) in enumerate(zip(marks[:, 0].tolist(), part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)):
                    if is_v and (mark, 0) not in seen:
                        seen.add((mark, 0))
                        for t, b in enumerate(blocks):
                            at = int(b.first[own[t, i]] + m % b.many[own[t, i]])
                            out += [(t, at, p, i, False, -np.inf) for p in range(parts)]
                    if is_q and (mark, 1) not in seen:
                        seen.add((mark, 1))
                        for t, b in enumerate(blocks):
                            near = hashing.nearness(signed, t, i) if hashing else np.zeros(1)
                            last = len(near) - min(cells, len(near))
                            cut = float(np.partition(near, last)[last]) - 1e-9
                            out += [(t, at, m % parts, i, True, cut) for at in b.visited(np.flatnonzero((near >= cut) & (b.many > 0))).tolist()]
                cols = list(zip(*out, strict=True)) or [()] * 6
                rows = pa.array(cols[3], pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[4], pa.bool_()), pa.array(cols[5], pa.float64()), *(part.column(i).take(rows) for i in (0, 1, 2))], names=["t", "block", "part", "asks", "cut", "id", "vector", "mark"])

    def best(found: list[list[np.ndarray]], tie: np.ndarray, n: int):
        a, b, c = (np.concatenate(x) for x in found)
        top = _top(a, c, tie[b], kept)
        a, b, c = a[top], b[top], c[top]
        floor, many = np.full(n, -np.inf), np.bincount(a, minlength=n)
        full = many == kept
        floor[full] = c[(np.cumsum(many) - 1)[full]]
        return [[a], [b], [c]], floor

    def score(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        table, asks, ids, marks = group.column("t")[0].as_py(), group.column("asks").to_numpy(), group.column("id").to_numpy(), _marks(group.column("mark"))

        def side(which: np.ndarray) -> np.ndarray:
            """Rows of one side, one of each mark: that of least id."""
            at = np.flatnonzero(which)
            at = at[np.lexsort((ids[at], marks[at, 1], marks[at, 0]))]
            return at[np.r_[True, (marks[at][1:] != marks[at][:-1]).any(axis=1)]] if len(at) else at

        v, q = side(~asks), side(asks)
        found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if len(v) and len(q):
            vectors, asked = (_dense(group.column("vector").take(pa.array(x)), dimension) for x in (v, q))
            cell = hashing.own(hashing.signed(vectors))[table] if hashing else np.zeros(len(v), int)
            order = np.lexsort((ids[v], cell))
            v, vectors, cell = v[order], vectors[order], cell[order]
            names, first = np.unique(cell, return_index=True)
            visits = hashing.of_cells(hashing.signed(asked)[table], names) >= group.column("cut").to_numpy()[q][:, None] if hashing else np.ones((len(q), 1), bool)
            floor, size = np.full(len(q), -np.inf), 0
            for c, (low, high) in enumerate(zip(first, [*first[1:], len(v)], strict=True)):
                visitors = np.flatnonzero(visits[:, c])
                step = max(1, (1 << 21) // (high - low))
                for at in range(0, len(visitors), step):
                    who = visitors[at : at + step]
                    s = asked[who] @ vectors[low:high].T
                    x, y = np.nonzero(s >= floor[who][:, None])
                    for column, values in zip(found, (who[x], low + y, s[x, y]), strict=True):
                        column.append(values)
                    size += len(x)
                    if size > 1 << 21:
                        found, floor = best(found, ids[v], len(q))
                        size = len(found[0][0])
            found, _ = best(found, ids[v], len(q))
        a, b = (pa.array(side_[x[0]]) for side_, x in ((q, found[0]), (v, found[1])))
        return pa.table({"asked": group.column("mark").take(a), "met": group.column("mark").take(b), "score": pa.array(found[2][0])})

    kind = dict(both.dtypes)["vector"]
    dealt = both.select("id", "vector", "mark", "is_v", "is_q").mapInArrow(place, f"t long, block long, part long, asks boolean, cut double, id long, vector {kind}, mark binary")
    return dealt.groupBy("t", "block", "part").applyInArrow(score, "asked binary, met binary, score double")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", column: str = "embedding", tables: int = TABLES, seed: int = 0, scanned: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products found for each id divisible by ``every``.

    Ties go to the smaller id. Of equal vectors each task sends one to its block, and their ids are put in at
    the end, the ``k + 1`` least of them, which is all that a result can hold. A cell of any size is scored in
    blocks. Bands of ``scanned`` rows at most (as a rule ``k``: no more than an answer holds) are scored by every query. Vectors of unequal dimension are
    compared as if the shorter ones went on with zeros. Repeated rows count once, an id with several vectors
    counts with each; further columns are ignored.
    """
    square = F.aggregate(F.col("vector"), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    base = usable(vectors, key, column).withColumn("is_q", F.col("id") % every == 0)
    longest, dimension = base.agg(F.max(square), F.max(F.size("vector"))).first()
    longest, dimension, kept, scanned = longest or 1.0, dimension or 1, k + 1, k if scanned is None else scanned
    band = F.least(F.floor(F.log2(F.lit(longest) / F.greatest(square, F.lit(1e-300))) * (BAND / 2)), F.lit(BANDS - 1)).cast("int")
    counts = {r.band: r.n for r in base.groupBy(band.alias("band")).agg(F.count("*").alias("n")).collect()}
    dense = {b: n for b, n in counts.items() if n > scanned}
    hashed = band.isin(list(dense)) if dense else F.lit(False)

    ids = base.select("id", "mark").distinct()
    ids = ids.withColumn("nth", F.row_number().over(Window.partitionBy("mark").orderBy("id"))).where(F.col("nth") <= kept)
    groups = materialise(ids.groupBy("mark").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    queries = base.where("is_q").select(F.col("id").alias("query_id"), F.col("mark").alias("asked")).distinct()

    def ranked(met: DataFrame) -> DataFrame:
        """Results of the pairs of marks that were scored: the best of them, with the ids that have those marks."""
        met = met.groupBy("asked", "met").agg(F.max("score").alias("score")).join(groups.withColumnRenamed("mark", "met"), "met")
        best = met.withColumn("nth", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "rep"))).where(F.col("nth") <= kept)
        best = best.select("asked", F.explode("ids").alias("vec_id"), "score")
        best = best.withColumn("nth", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id"))).where(F.col("nth") <= kept)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return queries.join(best, "asked").where("query_id <> vec_id").select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)

    def met_in(searched: Column, hashing: Hashing | None, cells: int) -> DataFrame:
        return compared(base.withColumn("is_v", searched).where("is_v or is_q"), hashing, cells, dimension, kept)

    if not dense:
        return ranked(met_in(F.lit(True), None, 1))
    hashing = hashing_for(sum(dense.values()), tables, seed)
    met = met_in(hashed, hashing, measured(base.where(hashed), base.where("is_q"), hashing, k, dimension))
    if len(dense) < len(counts):
        met = met.unionByName(met_in(~hashed, None, 1))
    first = materialise(ranked(met), "neighbours")
    full = first.where(F.col("rank") == k).select("query_id")
    short = materialise(queries.join(full, "query_id", "left_anti"), "short")
    if short.isEmpty():
        return first
    again = base.drop("is_q").join(short.select(F.col("asked").alias("mark"), F.lit(True).alias("is_q")).distinct(), "mark", "left")
    again = again.withColumns({"is_q": F.coalesce("is_q", F.lit(False)), "is_v": F.lit(True)})
    ids = short.select("query_id").distinct()
    return first.join(ids, "query_id", "left_anti").unionByName(ranked(compared(again, None, 1, dimension, kept)).join(ids, "query_id", "left_semi"))
