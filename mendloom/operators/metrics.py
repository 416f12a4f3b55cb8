"""Evaluation metrics over rollouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mendloom.sources.scratch import written


def solve_rate(df: DataFrame, solved: str) -> DataFrame:
    """Share of solved rows."""
    return df.agg(F.round(F.avg(F.col(solved).cast("int")), 6).alias("solve_rate"))


def pass_at(df: DataFrame, problem: str, order: str, solved: str, k: int) -> DataFrame:
    """Share of problems of which one of the first ``k`` candidates is solved."""
    nth = F.row_number().over(Window.partitionBy(problem).orderBy(order))
    best = df.withColumn("nth_", nth).where(F.col("nth_") <= k).groupBy(problem).agg(F.max(F.col(solved).cast("int")).alias("hit"))
    return best.agg(F.round(F.avg("hit"), 6).alias("pass_at_k"))


#: Cuts of a range of values at a time.
CUTS = 256


def order_statistics(df: DataFrame, column: str, ranks: Sequence[int]) -> list[float | None]:
    """The values at ranks from 0 in the order of ``column``, without nulls; exact, and no task sorts or holds all values.

    A range of values that holds a rank is cut at quantiles of a sketch, the rows under and at each cut
    are counted, and the part between two cuts takes its place, until a cut is the value itself.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    return [_at_rank(values, rank) for rank in ranks]


def _at_rank(values: DataFrame, rank: int) -> float | None:
    inside, before = F.lit(True), 0
    while True:
        part = values.where(inside)
        cuts = part.agg(F.percentile_approx("v", [i / CUTS for i in range(CUTS + 1)], 10_000).alias("cuts")).first().cuts
        if not cuts:
            return None
        cuts = sorted(set(cuts))
        # rows by the last cut at or under them, and whether they are that cut
        at = F.array_size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("v"))) - 1
        counts = {(r.cut, r.same): r.n for r in part.groupBy(at.alias("cut"), (F.get(F.array(*map(F.lit, cuts)), at) == F.col("v")).alias("same")).agg(F.count("*").alias("n")).collect()}
        for i in range(-1, len(cuts)):
            same, above = counts.get((i, True), 0), sum(counts.get((i, x), 0) for x in (False, None))
            if rank < before + same:
                return cuts[i]
            before += same
            if rank < before + above:
                inside = F.lit(True) if i < 0 else F.col("v") > cuts[i]
                if i + 1 < len(cuts):
                    inside = inside & (F.col("v") < cuts[i + 1])
                break
            before += above
        else:
            return None


def actions_per_solve(df: DataFrame, solved: str, actions: str) -> DataFrame:
    """Median count of tool calls of solved rows: the mean of the two middle values of an even count."""
    rows = df.where(F.col(solved)).select(F.col(actions).cast("double").alias("v"))
    n = rows.agg(F.count("v")).first()[0]
    middle = [v for v in order_statistics(rows, "v", sorted({(n - 1) // 2, n // 2})) if n and v is not None]
    median = sum(middle) / len(middle) if middle else None
    return df.sparkSession.createDataFrame([(median,)], "actions_per_solve double")


def shares_over_time(df: DataFrame, at: str, command: str, width: str = "1 hour") -> DataFrame:
    """(bucket, command, n, share): shares of commands in tumbling windows of time, zero rows included.

    The windows run without a gap from the first to the last that has a row; their spine is generated
    from its ends, and each kind of command of the table has a row in each. A share of an empty window is 0.
    """
    counts = df.where(F.col(at).isNotNull()).groupBy(F.window(at, width)["start"].alias("bucket"), F.col(command).alias("command_")).agg(F.count("*").alias("n"))
    counts = written(counts, "windows")
    ends = counts.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).where("a IS NOT NULL")
    spine = ends.select(F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {width}"))).alias("bucket"))
    names = counts.agg(F.collect_set(F.struct("command_")).alias("names"))  # one row: the kinds of command
    grid = spine.crossJoin(F.broadcast(names)).select("bucket", F.explode("names").alias("name")).select("bucket", F.col("name.command_").alias("name"))
    there = counts.select(F.col("bucket").alias("at_"), "command_", "n")
    met = grid.join(there, (F.col("bucket") == F.col("at_")) & F.col("name").eqNullSafe(F.col("command_")), "left").select("bucket", F.col("name").alias(command), F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("bucket"))
    return met.withColumn("share", F.round(F.when(total > 0, F.col("n") / total).otherwise(0.0), 6))


def command_shares(df: DataFrame, bucket: str, command: str) -> DataFrame:
    """Count and share of each command in each bucket."""
    counts = df.groupBy(bucket, command).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(bucket)), 6))


def advantages(df: DataFrame, group: str, reward: str, scale: bool = True) -> DataFrame:
    """Reward less its group's mean, over the standard deviation if ``scale``; groups of one have 0.

    The moments are aggregated and joined, so no group is sorted or held in one task.
    """
    moments = df.groupBy(group).agg(F.avg(reward).alias("mean_"), F.stddev_samp(reward).alias("std_"))
    centred = F.col(reward) - F.col("mean_")
    value = centred / (F.coalesce("std_", F.lit(0.0)) + 1e-4) if scale else centred
    return df.join(moments, group).withColumn("advantage", value).drop("mean_", "std_")
