"""Splits, slices, shards, reproducible orders, deduplication and other row operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from mendloom.sources.scratch import written


def in_holdout(key: Column, ratio: float) -> Column:
    """Whether the md5 of a key, read as a fraction, is under ``ratio``; a hex comparison, so it needs no shuffle."""
    if ratio >= 1:
        return F.lit(True)
    return F.md5(F.encode(key.cast("string"), "UTF-8")) < F.lit(f"{int(ratio * (1 << 128)):032x}")


def hash_split(df: DataFrame, key: str, ratio: float, holdout: bool) -> DataFrame:
    """The holdout, or the rest."""
    inside = in_holdout(F.col(key), ratio)
    return df.where(inside if holdout else ~inside)


def has_map(kind: DataType) -> bool:
    """Whether values of a type hold maps, which have no digest, or variants."""
    return any(t in kind.simpleString() for t in ("map<", "variant"))


def numbered(df: DataFrame, key: Sequence[str], name: str = "row_no") -> DataFrame:
    """Rows numbered from 0 in the order of ``key``, without one task for all of them.

    Rows are dealt into sorted ranges by one shuffle and numbered by their place there; the counts of
    earlier ranges are added. Rows of equal key are ordered, and cut into ranges, by a digest of all
    columns but maps. The ranges are drawn from a sample that no second run repeats, so they are
    written before they are counted.
    """
    apart = F.xxhash64(*(f.name for f in df.schema if not has_map(f.dataType)))
    order = [*key, "tie_"]
    ranged = df.withColumn("tie_", apart).repartitionByRange(*order).sortWithinPartitions(*order).drop("tie_").withColumn("at_", F.monotonically_increasing_id())
    local = written(ranged.select(*df.columns, F.shiftright("at_", 33).alias("range_"), F.col("at_").bitwiseAND((1 << 33) - 1).alias("nth_")), "ranges")
    sizes = local.groupBy("range_").agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return local.join(F.broadcast(sizes.select("range_", before.alias("before_"))), "range_").withColumn(name, (F.col("nth_") + F.col("before_")).cast("long")).drop("range_", "nth_", "before_")


def first_rows(df: DataFrame, key: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows by key, or all if there are fewer."""
    return df.orderBy(*key).limit(n)


def slice_bounds(spec: str) -> tuple[int, int | None]:
    """Start and end of ``"start:end"``, ``":n"`` or ``""``; negative or reversed bounds are an error."""
    if not spec:
        return 0, None
    start, _, end = spec.partition(":")
    bounds = int(start or 0), int(end) if end else None
    if bounds[0] < 0 or (bounds[1] is not None and bounds[1] < bounds[0]):
        raise ValueError(f"bad slice {spec!r}")
    return bounds


def sliced(df: DataFrame, key: Sequence[str], spec: str) -> DataFrame:
    """Rows of a half-open slice in the order of ``key``; the end is clamped. No task holds more than a range of the rows."""
    start, end = slice_bounds(spec)
    if not spec:
        return df
    inside = F.col("slice_no_") >= start
    return numbered(df, key, "slice_no_").where(inside if end is None else inside & (F.col("slice_no_") < end)).drop("slice_no_")


def task_slices(df: DataFrame, key: Sequence[str], size: int) -> DataFrame:
    """Rows with the task that works on them: ``size`` rows a task, in the order of ``key``."""
    return numbered(df, key).withColumn("task_id", F.floor(F.col("row_no") / size).cast("long"))


def shard_of(row_no: Column, rows: Column, shards: int) -> Column:
    """Contiguous shards, the first ones longer by one where the count doesn't divide."""
    small, extra = F.floor(rows / shards), rows % shards
    edge = extra * (small + 1)
    return F.when(row_no < edge, F.floor(row_no / (small + 1))).otherwise(extra + F.floor((row_no - edge) / F.greatest(small, F.lit(1)))).cast("long")


def sharded(df: DataFrame, key: Sequence[str], shards: int, contiguous: bool = True) -> DataFrame:
    """Rows with their shard, in the order of ``key``: a stretch of rows each, or every ``shards``-th row."""
    if not contiguous:
        return numbered(df, key).withColumn("shard", F.col("row_no") % shards)
    total = df.agg(F.count("*").alias("rows_"))
    return numbered(df, key).crossJoin(F.broadcast(total)).withColumn("shard", shard_of(F.col("row_no"), F.col("rows_"), shards)).drop("rows_")


def shuffle_key(key: Column, seed: int) -> Column:
    """What a seeded permutation sorts by."""
    return F.md5(F.encode(F.concat_ws("#", key.cast("string"), F.lit(str(seed))), "UTF-8"))


def seeded_shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows in an order that the seed fixes."""
    return df.orderBy(shuffle_key(F.col(key), seed), key)


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How many keys two tables share."""
    return a.select(key).intersect(b.select(key)).agg(F.count("*").alias("shared"))


def keep_one(df: DataFrame, key: str, order: Sequence[str], keep: str = "first") -> DataFrame:
    """The first or last row of each key, with first_seen: the order values of the key's first row."""
    rest = [c for c in df.columns if c != key]
    pick = F.min_by if keep == "first" else F.max_by
    return df.groupBy(key).agg(pick(F.struct(*rest), F.struct(*order)).alias("row_"), F.min(F.struct(*order)).alias("first_seen")).select(key, "row_.*", "first_seen")


def with_fallback(train: DataFrame, test: DataFrame) -> DataFrame:
    """The train split, or test if train is empty."""
    return test if train.isEmpty() else train


def recent(stamp: Column, as_of: Column, hours: int) -> Column:
    """Whether the first three dash-separated parts of a folder name are an ISO time within ``hours`` of ``as_of``; unreadable names aren't.

    The time may have dots for colons, which file systems of Hadoop don't take in names.
    """
    text = F.array_join(F.slice(F.split(stamp, "-"), 1, 3), "-")
    text = F.regexp_replace(text, r"T(\d\d)\.(\d\d)\.(\d\d)", "T$1:$2:$3")
    return F.coalesce(F.try_to_timestamp(text) > as_of - F.make_interval(hours=F.lit(hours)), F.lit(False))


def pairs_by_hash(df: DataFrame, key: str, flag: str) -> DataFrame:
    """Flagged and unflagged rows of equal key, as structs ``vulnerable`` and ``fixed``."""
    side = lambda want, name: df.where(F.col(flag) if want else ~F.col(flag)).select(key, F.struct(*df.columns).alias(name))
    return side(True, "vulnerable").join(side(False, "fixed"), key)


def rank_pairs(df: DataFrame, key: str, flag: str, order: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The n-th flagged row of a key with its n-th unflagged row, and the rows left over.

    Rows of a key are counted in the order given, then by a digest of all columns: m and n rows make
    the smaller number of pairs, not m times n. Numbers come from one order of the whole table, so no
    task holds a key. Rows without a key or flag are left over.
    """
    row = F.struct(*df.columns)
    placed = numbered(df.select(F.col(key).alias("key_"), F.col(flag).alias("flag_"), *(F.col(c).alias(f"by_{i}_") for i, c in enumerate(order)), row.alias("row_")), ["key_", "flag_", *(f"by_{i}_" for i in range(len(order)))], "no_")
    start = placed.groupBy(F.col("key_").alias("k_"), F.col("flag_").alias("f_")).agg(F.min("no_").alias("start_"))
    ranked = placed.join(start, F.col("key_").eqNullSafe(F.col("k_")) & F.col("flag_").eqNullSafe(F.col("f_"))).select("key_", "flag_", (F.col("no_") - F.col("start_")).alias("rank_"), "row_")
    side = lambda want, name: ranked.where(F.col("flag_") if want else ~F.col("flag_")).select("key_", "rank_", F.col("row_").alias(name))
    whole = side(True, "vulnerable").join(side(False, "fixed"), ["key_", "rank_"], "full_outer")
    odd = ranked.where("key_ IS NULL OR flag_ IS NULL").select("row_.*")
    met = whole.where("key_ IS NOT NULL AND vulnerable IS NOT NULL AND fixed IS NOT NULL").select(F.col("key_").alias(key), "vulnerable", "fixed")
    left = whole.where("key_ IS NOT NULL AND (vulnerable IS NULL OR fixed IS NULL)").select(F.coalesce("vulnerable", "fixed").alias("row_")).select("row_.*")
    return met, left.unionByName(odd)


def unpaired(df: DataFrame, key: str, flag: str) -> DataFrame:
    """Keys that lack a flagged or an unflagged row."""
    return df.groupBy(key).agg(F.bool_or(flag).alias("any_"), F.bool_and(flag).alias("all_")).where("not any_ or all_").select(key)


def expand(df: DataFrame, k: int, name: str = "rollout_no") -> DataFrame:
    """Every row ``k`` times, numbered from 0."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
