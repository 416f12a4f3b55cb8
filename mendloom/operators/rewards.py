"""Reward operators: completions in, scores from 0 to 1 out; their registry and weights."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendloom.functions import diffs, text
from mendloom.functions.text import col


def categorical(completion: Column | str, answer: Column | str) -> Column:
    """1 if the tagged answer is the expected one, else 0."""
    return (text.answer_tag(completion) == col(answer)).cast("double")


def diff_format(completion: Column | str, mode: str = "intended") -> Column:
    """Format quality of the block inside the answer."""
    return diffs.format_quality(text.fenced(text.answer_tag(completion)), mode)


def block_pairs(df: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """Blocks of two lists side by side, the shorter list filled up with empty blocks."""
    zipped = F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b"))
    pair = df.select(key, F.posexplode(zipped).alias("block_no", "p"))
    side = lambda s, f: F.coalesce(F.col(f"p.{s}.{f}"), F.lit("")).alias(f"{s}_{f}")
    return pair.select(key, "block_no", side("a", "search"), side("b", "search"), side("a", "replace"), side("b", "replace"))


def block_similarity(df: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """(key, similarity): mean over blocks of the mean line ratio of both sides; 1 for two empty lists, 0 for one."""
    scored = diffs.with_ratios(block_pairs(df, a, b, key), searched=("a_search", "b_search", True), replaced=("a_replace", "b_replace", True))
    mean = scored.groupBy(key).agg(F.avg((F.col("searched") + F.col("replaced")) / 2).alias("mean"))
    one = F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.col("mean"))
    return df.join(mean, key, "left").select(key, F.round(one, 6).alias("similarity"))


def diff_similarity(df: DataFrame, key: str, completion: str = "completion", reference: str = "diffs", mode: str = "intended") -> DataFrame:
    """(key, similarity) of the blocks in an answer and those of the reference."""
    parsed = df.select(key, diffs.parse_blocks(text.fenced(text.answer_tag(completion)), mode).alias("a"), diffs.parse_blocks(reference, mode).alias("b"))
    return block_similarity(parsed, "a", "b", key)


def last_by_name(df: DataFrame, patch: str, key: str) -> DataFrame:
    """(key, filename, part): the files of a unified diff, the last of those of one name."""
    parts = df.select(key, F.posexplode(text.file_diffs(F.coalesce(F.col(patch), F.lit("")))).alias("pos", "part"))
    return parts.groupBy(key, text.diff_filename("part").alias("filename")).agg(F.max_by("part", "pos").alias("part"))


def patch_similarity(df: DataFrame, key: str, oracle: str = "patch", generated: str = "generated_diff") -> DataFrame:
    """(key, similarity): character ratios of files of one name, summed, over the larger count of files; 0 without files."""
    o, g = last_by_name(df, oracle, key).withColumnRenamed("part", "o"), last_by_name(df, generated, key).withColumnRenamed("part", "g")
    both = diffs.with_ratios(o.join(g, [key, "filename"], "full_outer"), ratio=("o", "g", False))
    met = F.when(F.col("o").isNotNull() & F.col("g").isNotNull(), F.col("ratio")).otherwise(0.0)
    scored = both.groupBy(key).agg((F.sum(met) / F.greatest(F.count("o"), F.count("g"), F.lit(1))).alias("similarity"))
    return df.select(key).join(scored, key, "left").select(key, F.round(F.coalesce("similarity", F.lit(0.0)), 6).alias("similarity"))


def file_match(oracle: Column | str, generated: Column | str) -> Column:
    """Shared file names over the larger count; 1 if neither patch has files, 0 if one has none."""
    names = lambda p: F.array_distinct(F.transform(text.file_diffs(F.coalesce(col(p), F.lit(""))), text.diff_filename))
    o, g = names(oracle), names(generated)
    most = F.greatest(F.size(o), F.size(g))
    return F.when(most == 0, 1.0).otherwise(F.round(F.size(F.array_intersect(o, g)) / most, 6))


Scorer = Callable[[DataFrame], DataFrame]
_REGISTRY: dict[str, tuple[Callable[..., Column], float]] = {}


def register_reward(name: str, score: Callable[..., Column], weight: float = 1.0) -> None:
    """Name a reward: a function from columns to a score column."""
    _REGISTRY[name] = score, weight


def registered(df: DataFrame, **columns: tuple[str, ...]) -> DataFrame:
    """``df`` with each named reward over the named columns, and their weighted sum as ``reward``."""
    out = df.withColumns({name: _REGISTRY[name][0](*of) for name, of in columns.items()})
    return out.withColumn("reward", F.round(sum((F.col(n) * _REGISTRY[n][1] for n in columns), F.lit(0.0)), 6))


for _name, _score, _weight in (("reasoning", text.reasoning_tags, 0.1), ("strict_reasoning", text.strict_reasoning, 0.2), ("categorical", categorical, 0.7), ("diff_format", diff_format, 0.3), ("file_match", file_match, 1.0)):
    register_reward(_name, _score, _weight)


def weighted(scores: DataFrame, weights: dict[str, float], key: str) -> DataFrame:
    """(key, reward) from long scores (key, name, score): each times its weight, summed."""
    table = scores.sparkSession.createDataFrame(list(weights.items()), "name string, weight double")
    return scores.join(F.broadcast(table), "name").groupBy(key).agg(F.round(F.sum(F.col("score") * F.col("weight")), 6).alias("reward"))


def curation_reward(files: Column | str, similarity: Column | str, tests: Column | str) -> Column:
    """A fifth file match, two fifths similarity, two fifths similarity of tests."""
    return F.round(0.2 * col(files) + 0.4 * col(similarity) + 0.4 * col(tests), 6)
